"""Notifications, reminders, digests and saved events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.joins import recipients, with_defaults
from tidemill.operators.writes import append_once

# Preferences of users who never set any.
DEFAULTS = {"in_app": True, "email": False, "frequency": "immediate", "new_events": True, "reminders": True, "updates": True}


def deliveries(pairs: DataFrame, preferences: DataFrame, ledger: DataFrame, key: Column, wanted: str) -> DataFrame:
    """New rows of the delivery ledger for (user_id, event_id) pairs: user_id, alert_key, channel and status.

    A channel that is off, or an alert kind that a user does not want, gives none; an email
    of a user with digests is pending.  What the ledger has is not delivered again.
    """
    own = with_defaults(pairs.distinct(), preferences, "user_id", DEFAULTS).where(F.col(wanted))
    channels = F.array_compact(F.array(F.when(F.col("in_app"), F.struct(F.lit("in_app").alias("channel"), F.lit("sent").alias("status"))), F.when(F.col("email"), F.struct(F.lit("email").alias("channel"), F.when(F.col("frequency") == "immediate", "sent").otherwise("pending").alias("status")))))
    rows = own.select("user_id", key.alias("alert_key"), F.explode(channels).alias("c")).select("user_id", "alert_key", "c.channel", "c.status")
    return append_once(ledger, rows, ["user_id", "alert_key", "channel"], F.col("status"))


def new_event_alerts(events: DataFrame, follows: DataFrame, preferences: DataFrame, ledger: DataFrame, targets: dict[str, Sequence[str]]) -> DataFrame:
    """Deliveries for users who follow a city, category or source of an active event."""
    pairs = recipients(events.where(F.col("is_active") & ~F.col("is_cancelled")), follows, "event_id", targets)
    return deliveries(pairs, preferences, ledger, F.concat(F.lit("new_event:"), F.col("event_id").cast("string")), "new_events")


def change_alerts(changes: DataFrame, saved: DataFrame, preferences: DataFrame, ledger: DataFrame) -> DataFrame:
    """Deliveries to users who saved an event that changed; changes: event_id, kind (updated or cancelled)."""
    pairs = changes.join(saved, "event_id").select("user_id", F.concat_ws(":", "kind", F.col("event_id").cast("string")).alias("event_id"))
    return deliveries(pairs, preferences, ledger, F.col("event_id"), "updates")


def reminders(events: DataFrame, saved: DataFrame, preferences: DataFrame, ledger: DataFrame, today: str) -> DataFrame:
    """Deliveries for saved events that start tomorrow."""
    soon = events.where(F.col("is_active") & (F.col("start_date") == F.date_add(F.lit(today).cast("date"), 1))).select("event_id")
    return deliveries(saved.join(soon, "event_id").select("user_id", "event_id"), preferences, ledger, F.concat(F.lit("reminder:"), F.col("event_id").cast("string")), "reminders")


def digests(ledger: DataFrame, preferences: DataFrame, now: str) -> DataFrame:
    """user_id and number of pending emails for users whose interval has passed since the last digest, exactly or longer."""
    due = F.when(F.col("frequency") == "daily", 86_400).when(F.col("frequency") == "weekly", 7 * 86_400)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_digest_at").cast("timestamp"))
    ready = preferences.where(F.col("email") & due.isNotNull() & (F.col("last_digest_at").isNull() | (age >= due))).select("user_id")
    pending = ledger.where("channel = 'email' AND status = 'pending'").groupBy("user_id").agg(F.count("*").alias("n"))
    return ready.join(pending, "user_id")


def notifications(messages: DataFrame, users: DataFrame, recent: DataFrame, at: str, seconds: int, now: str) -> DataFrame:
    """One row for each message and user of its role, but none for messages whose fingerprint was sent within the cooldown, its end included.

    Of several messages of one fingerprint the first goes out.
    """
    fresh = recent.where(F.col(at).cast("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECOND")).select("fingerprint").distinct()
    first = messages.groupBy("fingerprint").agg(F.min("message_id").alias("message_id"))
    left = first.join(fresh, "fingerprint", "left_anti")
    return left.join(messages.select("message_id", "role"), "message_id").join(users, "role").select("message_id", "fingerprint", "user_id")


def saved_list(saved: DataFrame, events: DataFrame) -> DataFrame:
    """Saved events of all users in the order of their dates, undated ones last."""
    return saved.join(events, "event_id").orderBy("user_id", F.col("start_date").asc_nulls_last(), "event_id")
