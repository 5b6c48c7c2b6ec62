"""Registered queries of this subpackage: thin bindings of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import conversation_repair, decontamination, html_extraction, jaccard_join, language_model, license_scans, quality_rules, secret_scans, sentencepiece_sampling, substring_dedup, token_alignment, token_counts, toxicity
from tidemill.llm.tables import lean, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digests(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.sample(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digests(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_secret_scans, op3_license_scans, op4_sentencepiece, op5_decontamination, op6_substring_dedup, op7_quality_rules, op8_html_extraction, op9_jaccard_join, op10_toxicity, op11_token_alignment, op12_language_model, op13_conversation_repair)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: SQL for the same rows.  The others need a tokenizer file, a trained model, spans by possessive patterns or an alignment.
ORACLES: dict[str, str] = {
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i:i + 49], ' ')) END AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM h WHERE win IS NOT NULL GROUP BY win),
c AS (SELECT h.doc_id, h.i, word, max(CASE WHEN f.first < h.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY h.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h LEFT JOIN f ON h.win = f.win),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op7_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 2], ' ')) AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1), p AS (SELECT doc_id, count(DISTINCT pos) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN p ON d.doc_id = p.doc_id),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
+ CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_upper > 60 * greatest(n_letters, 1) THEN 64 ELSE 0 END + CASE WHEN 100 * n_digits > 50 * greatest(word_chars, 1) THEN 128 ELSE 0 END AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS INTEGER) AS fail_bits, 'v1' AS policy FROM b""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)), y AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, y.b FROM r JOIN y ON r.reached = y.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
}
