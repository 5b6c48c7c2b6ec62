"""Reading tables and writing shared intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000  # of rows of a few numbers each: under 64 MB as a hash table
MAX_BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder; executors of a cluster cannot read a local one")
        found = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def named(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever signs stand in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def few(df: DataFrame) -> DataFrame:
    """df of narrow rows, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def light(df: DataFrame, *texts: str) -> DataFrame:
    """df of rows with texts, marked for broadcast if rows and bytes of all texts are measured to be few."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS and total <= MAX_BROADCAST_BYTES else df


def first_of_copies(rows: DataFrame, keys: list[str], node: str, hot: int = 10_000) -> DataFrame:
    """rows whose keys stand in an earlier row too, with ``first``, the smallest node of the keys.

    Classes of copies are counted with map-side sums.  Those of at least ``hot`` rows, of
    which there is at most one in ``hot`` rows, are broadcast if counted to be few, so no
    task has to take all the copies of one text.
    """
    firsts = stored(rows.groupBy(*keys).agg(F.min(node).alias("first"), F.max(node).alias("last"), F.count("*").alias("c")).where("first < last").drop("last"), "firsts")
    late = F.col(node) > F.col("first")
    if firsts.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(firsts.drop("c")), keys).where(late)
    many, rest = (firsts.where(x).drop("c") for x in (F.col("c") >= hot, F.col("c") < hot))
    cold = rows.join(few(many), keys, "left_anti").join(rest, keys)
    return rows.join(few(many), keys).unionByName(cold).where(late)


def lean(spark: SparkSession) -> None:
    """Arrow batches of fewer rows for this session, if it has Spark's own number: workers and buffers stay small beside long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def looked_up(rows: DataFrame, facts: DataFrame, key: str, n: str, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """rows left-joined on a number ``key`` to facts, which have one row of a few numbers for each key.

    Facts of the highest ``n`` that are counted to be at most ``most`` are broadcast; only rows
    of other keys, none of them frequent, are shuffled.  rows is read twice if there are others.
    """
    power = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    levels = {r[0]: r[1] for r in facts.groupBy(power).count().collect()}  # at most 64 rows
    low, total = max(levels, default=0) + 1, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        low = level
    if low <= min(levels, default=0):
        return rows.join(F.broadcast(facts), key, "left")
    hot, rest = facts.where(power >= low), facts.where(power < low)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return near.unionByName(far)


def stored(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and it survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing later reads, and the shuffle files behind them.

    Spark deletes shuffle files once the driver has collected the plans they belong to.
    """
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()
