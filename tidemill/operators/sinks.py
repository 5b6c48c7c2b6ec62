"""Tables that runs write to: each run's change takes effect once, whatever is lost on the way.

A table is Parquet, partitioned by a hash of its key (``_bucket``).  A run reads only the
buckets that its rows touch, and goes through three steps:

staged     the buckets as they will be are written beside the table (``_staged/<run>``)
written    they replace the table's buckets (dynamic partition overwrite)
committed  a marker with the run's counters (``_runs/<run>``)

A run that is repeated after a loss begins where it was lost: without a whole staged table the
change is computed anew from an untouched table; with one, the same buckets are written again,
so that counters never count twice; with a marker nothing is done.  One run writes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.writes import overwriting_upsert
from tidemill.sources.shared import exists

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Sink:
    """A keyed table at a path; ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        self.schema = ", ".join(f"`{c}` {t}" for c, t in empty.dtypes) + f", {BUCKET} int"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _stored(self) -> DataFrame:
        """All rows with their bucket, a partition column: a filter on it reads only these folders."""
        if not exists(self.spark, f"{self.path}/_runs") or not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _done(self, run: str) -> dict[str, int] | None:
        place = f"{self.path}/_runs/{run}"
        return self.spark.read.parquet(place).first().asDict() if exists(self.spark, f"{place}/_SUCCESS") else None

    def stage(self, run: str, change: Merge, rows: DataFrame) -> DataFrame:
        """The touched buckets after a change, written once."""
        place = f"{self.path}/_staged/{run}"
        if not exists(self.spark, f"{place}/_SUCCESS"):
            touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most all buckets
            old = self._stored().where(F.col(BUCKET).isin(touched)).select(*self.columns)
            after = change(old, rows).select(*self.columns, "action")
            after.withColumn(BUCKET, self.bucket()).write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)

    def publish(self, staged: DataFrame) -> None:
        """Replaces the buckets of staged rows; a bucket that lost its last row is written with none."""
        kept = staged.where("action <> 'deleted'").select(*self.columns, BUCKET)
        emptied = [r[0] for r in staged.select(BUCKET).distinct().join(kept.select(BUCKET).distinct(), BUCKET, "left_anti").collect()]  # at most all buckets
        kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for b in emptied:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def commit(self, run: str, staged: DataFrame) -> dict[str, int]:
        counts = staged.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "deleted", "kept")))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_runs/{run}")
        return self._done(run) or {}

    def apply(self, run: str, change: Merge, rows: DataFrame) -> dict[str, int]:
        """Counters of a run (inserted, updated, deleted, kept in touched buckets); a run takes effect once.

        change: (rows of the touched buckets, the run's rows) -> rows with ``action``, deleted ones included.
        """
        done = self._done(run)
        if done is not None:
            return done
        staged = self.stage(run, change, rows)
        self.publish(staged)
        return self.commit(run, staged)

    def runs(self) -> DataFrame:
        """The log of runs: name and counters."""
        place = f"{self.path}/_runs"
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/*") if exists(self.spark, place) else self.spark.createDataFrame([], "inserted long, updated long, deleted long, kept long")
        return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"/_runs/([^/]+)/", 1))

    def upsert(self, run: str, rows: DataFrame, order: Column) -> dict[str, int]:
        """The last row of each key in ``order`` wins whole."""
        return self.apply(run, lambda old, new: _told(old, overwriting(old, new, self.key, order), self.key), rows)

    def put_absent(self, run: str, rows: DataFrame, order: Column) -> dict[str, int]:
        """Rows of keys that the table lacks, the first in ``order`` of each; nulls as values are kept too."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in self.columns if c not in self.key]
            once = new.groupBy(*self.key).agg(F.min(F.struct(order.alias("_o"), *rest)).alias("n")).select(*self.key, *(F.col(f"n.{c}").alias(c) for c in rest))
            return old.withColumn("action", F.lit("kept")).unionByName(once.join(old.select(*self.key), self.key, "left_anti").withColumn("action", F.lit("inserted")))

        return self.apply(run, change, rows)

    def delete(self, run: str, keys: DataFrame) -> dict[str, int]:
        """Deletes rows by key."""
        return self.apply(run, lambda old, new: old.join(new.select(*self.key).distinct().withColumn("_hit", F.lit(True)), self.key, "left").withColumn("action", F.when(F.col("_hit"), "deleted").otherwise("kept")), keys)

    def set_column(self, run: str, rows: DataFrame, column: str) -> dict[str, int]:
        """One column of known keys takes a value; rows: key and the column, one row for each key."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.join(new.select(*self.key, F.struct(column).alias("_n")), self.key, "left")
            changed = F.col("_n").isNotNull() & ~F.col(column).eqNullSafe(F.col(f"_n.{column}"))
            return both.withColumn("action", F.when(changed, "updated").otherwise("kept")).withColumn(column, F.when(changed, F.col(f"_n.{column}")).otherwise(F.col(column)))

        return self.apply(run, change, rows)

    def delete_where(self, run: str, which: Column) -> dict[str, int]:
        """Deletes all rows that match a condition; only buckets with such a row are touched."""
        hit = F.coalesce(which, F.lit(False))
        return self.apply(run, lambda old, _: old.withColumn("action", F.when(hit, "deleted").otherwise("kept")), self._stored().where(hit).select(*self.columns))


def overwriting(old: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """overwriting_upsert for keys of several columns."""
    if len(key) == 1:
        return overwriting_upsert(old, new, key[0], order)
    pack = lambda df: df.select(F.struct(*key).alias("_k"), *[c for c in df.columns if c not in key])
    out = overwriting_upsert(pack(old), pack(new), "_k", order)
    return out.select(*(F.col(f"_k.{k}").alias(k) for k in key), *[c for c in out.columns if c != "_k"])


def _told(old: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """after with what happened to each row."""
    rest = [c for c in old.columns if c not in key]
    was = old.select(*key, F.struct(*rest).alias("_was"))
    both = after.join(was, list(key), "left")
    same = F.struct(*rest).eqNullSafe(F.col("_was"))
    return both.withColumn("action", F.when(F.col("_was").isNull(), "inserted").when(same, "kept").otherwise("updated")).drop("_was")
