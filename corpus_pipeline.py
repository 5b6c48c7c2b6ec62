"""A corpus pipeline of five stages over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows its
predecessor kept; between stages the rows are written as Parquet and read again.

toxicity        documents that score 0.5 or more go
jaccard_join    of each group of near copies the smallest doc_id stays; sets of five-word shingles
                with a Jaccard similarity of 0.8 link (the query op9 has its own contract)
decontamination documents that hold a benchmark item go
secret_scans    secrets are replaced by a mark; n_chars follows the text
sentencepiece   sampled pieces of each remaining document (doc_id, n_pieces, ids, lossless)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontamination, jaccard_join, secret_scans, sentencepiece_sampling, toxicity
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.tables import discard, lean, stored, table


SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return jaccard_join.keep_one(docs, SHINGLE, PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    out = secret_scans.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return sentencepiece_sampling.sample(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", drop_benchmark), ("secret_scans", mask_secrets), ("sentencepiece", encode)]

#: SQL cannot express the trained model, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
