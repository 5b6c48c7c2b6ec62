"""Secret scans over an incremental blob ledger.

Every text is a blob, named by the SHA-256 of its bytes; a document's historical versions
are so many blobs.  A rule has a version of its own (``jwt@1``).  The ledger is a Parquet
table; a row holds a blob, the rules it was scanned with in one run and their findings, also
if there are none.  ``update`` finds the rules that each blob lacks by joining names, scans
exactly those pairs, each once, and appends them; ``scan`` joins findings back to every path
(row) that holds the blob.

A blob that stands in one row is scanned where it lies.  Of a blob in several rows one text is
taken by an aggregation with map-side sums, so copies are never scanned again, whatever task
holds them, and one text in a third of all rows makes no large group.

The three base kinds are always kept as they are; ``EXTRA`` kinds add spans of formats with a
fixed prefix.  ``VERSIONS`` names the rules of each rule set.

Defined results: null and empty texts are the empty blob without findings; repeated
rows and null keys each get their blob's findings; other columns are ignored by the scan
and, in ``redact``, returned unchanged; an empty table adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.tables import discard, few, named, scratch, spare, stored
from tidemill.llm.textbatch import slices, texts_of

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORD = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)

# A private key: to its END line or, if it is unclosed, over its headers and all lines of base64.
_GAP = r"(?:\s|\\[nr])*"
_PEM = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info|Comment|Version): (?:(?!\\[nr])[^\n])*)*(?:{_GAP}[A-Za-z0-9+/]{{20,}}={{0,2}}|(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]+={{0,2}}(?=\s*(?:[\n\\\"']|\Z)))*)"
)

KINDS = ("assign", "access", "hex", "pem", "forge", "jwt", "hook")
EXTRA = (
    ("pem", "-----BEGIN", _PEM),
    ("forge", "gh", re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}")),
    # Possessive, and only where a token begins: one look at each character.
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++")),
    ("hook", "https://hooks.", re.compile(r"https://hooks\.[a-z.]+/[A-Za-z0-9/_-]{20,}")),
)


#: Rules of each rule set, as kind@version; a rule whose pattern changes gets a new version.
RULES = tuple(f"{kind}@1" for kind in KINDS)
VERSIONS = {"base-3": RULES[:3], "base-3+extra-6": RULES}
RULE_VERSION = "base-3+extra-6"


def scan_text(text: str, rules: Collection[str] = RULES) -> list[tuple[str, int, int]]:
    """All findings of one text by some rules as (rule, start, end), base kinds first."""
    found = []
    if "assign@1" in rules and _KEYWORD.search(text):
        found += [("assign@1", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "access@1" in rules and "AKIA" in text:
        found += [("access@1", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "hex@1" in rules:
        found += [("hex@1", *m.span()) for m in _HEX.finditer(text)]
    for kind, hint, pattern in EXTRA:
        if f"{kind}@1" in rules and hint in text:
            found += [(f"{kind}@1", *m.span()) for m in pattern.finditer(text)]
    return found


FINDINGS = "array<struct<rule:string,kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"
_STRUCT = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of batches of (blob, rules, text)."""
    for batch in batches:
        for part in slices(batch):
            rules = part.column(1).to_pylist()
            found = [[{"rule": r, "kind": r.split("@")[0], "start": a, "end": b} for r, a, b in scan_text(t, some)] for t, some in zip(texts_of(part), rules, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, _STRUCT)], ["blob", "rules", "findings"])


def blob_of(text: str = "text") -> F.Column:
    """The address of a text."""
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)


def _wanted(version: str) -> F.Column:
    return F.array(*map(F.lit, VERSIONS[version]))


def unseen(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """(blob, rules, copies): the blobs of docs, the rules of a set that the ledger lacks for each, and its number of rows."""
    blobs = docs.select(blob_of(text).alias("blob")).groupBy("blob").agg(F.count("*").alias("copies"))
    if ledger is None:
        return blobs.select("blob", _wanted(version).alias("rules"), "copies")
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most all rules
    lacking = F.array_except(_wanted(version), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", lacking.alias("rules"), "copies").where(F.size("rules") > 0)


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """New ledger rows: one for each blob of docs that the ledger lacks rules of, scanned once with these rules."""
    todo = stored(unseen(docs, ledger, version, text), "unseen")
    texts = docs.select(blob_of(text).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    lone, shared = (todo.where(c).select("blob", "rules") for c in ("copies = 1", "copies > 1"))
    if ledger is None:  # nothing is known: a blob in one row needs no join
        alone = texts.join(few(shared.select("blob")), "blob", "left_anti").select("blob", _wanted(version).alias("rules"), "text")
    else:
        alone = texts.join(few(lone), "blob").select("blob", "rules", "text")
    copied = texts.join(few(shared.select("blob")), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(few(shared), "blob")
    return alone.unionByName(copied.select("blob", "rules", "text")).mapInArrow(_scan, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, or None before its first update."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def update(docs: DataFrame, path: str, version: str = RULE_VERSION, text: str = "text") -> int:
    """Scans what the ledger at ``path`` lacks of docs, appends it, and returns the number of (blob, rule) pairs scanned."""
    fresh = stored(scan_blobs(docs, read_ledger(docs.sparkSession, path), version, text), "ledger-rows")
    fresh.write.mode("append").parquet(path)
    scanned = fresh.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]
    discard(fresh)
    return scanned


def _hits(ledger: DataFrame, version: str) -> DataFrame:
    """Blobs with findings by the rules of a set, marked for broadcast if both are counted to be few."""
    own = F.filter("findings", lambda f: F.array_contains(_wanted(version), f["rule"]))
    rows = ledger.select("blob", own.alias("findings")).where(F.size("findings") > 0)
    hits = rows.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))  # a blob has at most one row for each rule
    n, spans = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("findings")), F.lit(0))).first()
    return F.broadcast(hits) if n + spans <= 200_000 else hits


def scan(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, blob and findings of every row, from a ledger that holds its blobs."""
    paths = docs.select(F.col(f"`{key}`").alias("key"), blob_of(text).alias("blob"))
    return paths.join(_hits(ledger, version), "blob", "left").select(F.col("key").alias(key), "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def digest(findings: F.Column) -> dict[str, F.Column]:
    """Counts and joined spans of a findings column, in SQL functions."""
    ranked = F.array_sort(F.transform(findings, lambda x: F.struct(x["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"].alias("b"), x["kind"].alias("kind"))))
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])), ",")
    count = lambda kind: F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")
    return {
        "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
        "base_sha256": F.sha2(joined(F.filter(ranked, lambda x: x["k"] <= 3)), 256),
        "spans": joined(ranked),
    }


def _updated(docs: DataFrame, ledger: str | None, text: str = "text") -> DataFrame:
    """The ledger after an update with docs: at a path, or a new one of this run."""
    path = ledger or scratch(docs.sparkSession, "ledger")
    update(docs, path, text=text)
    return read_ledger(docs.sparkSession, path)


def digests(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row of counts and spans for each document, from the ledger at a path after an update with docs."""
    return scan(docs, _updated(docs, ledger)).select("doc_id", "blob", *(c.alias(n) for n, c in digest(F.col("findings")).items()))


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every finding replaced by ``mark``; overlapping findings become one mark.

    Rows, columns and their order stay; texts without findings stay as they are.
    """
    blob, found = spare(docs, "blob", "found")
    hits = _hits(_updated(docs, ledger, text), RULE_VERSION).select(F.col("blob").alias(blob), F.col("findings").alias(found))
    own = F.col(f"`{text}`")
    merged = F.aggregate(
        F.array_sort(F.transform(F.col(found), lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["a"] >= acc["at"], F.concat(acc["out"], F.substring(own, acc["at"] + 1, x["a"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["b"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))),
    )
    out = docs.withColumn(blob, blob_of(text)).join(hits, blob, "left")
    changed = F.when(F.col(found).isNotNull(), merged).otherwise(own)
    return out.select(*(changed.alias(c) if c == text else x for c, x in zip(docs.columns, named(docs), strict=True)))
