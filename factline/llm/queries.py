"""The registered queries of this package: one for each operator, over the whole of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import line_dedup, lm_scores, mixing, order_minhash, piece_codec, quality_classifier, quality_rules, simhash, substring_dedup, token_counts
from factline.llm.text import whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.check_pieces(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", F.char_length(whole("text")).cast("long").alias("n_chars"), "n_tokens", "ids_sha256", "exact")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
a AS (SELECT doc_id, source, length(body) AS chars, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM d),
k AS (SELECT *, -ln((('0x' || substr(sha256(concat('7:', coalesce(doc_id::VARCHAR, 'null'))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
        / (0.5 + 0.5 / (1.0 + abs(chars::DOUBLE / greatest(size, 1) - 6.0) / 6.0)) AS k FROM a),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce((sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)::DOUBLE)
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, source IS NULL, source)),
g AS (SELECT *, 3 * source_size / weight::DOUBLE <= level AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
        ELSE (SELECT max(level) FROM g WHERE NOT is_full) * weight END AS target FROM g),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) * 2 - k.size AS middle
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(documents(spark, sf_dir)).select(*base, F.round("p_good", 6).alias("p_good"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(documents(spark, sf_dir))
    return found.select("doc_id", F.round("quality", 6).alias("quality"), "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(whole("text"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, r.last IS NOT NULL AND k.doc_id < r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.drop_repeats(documents(spark, sf_dir), width=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.score(documents(spark, sf_dir), order=3)
    return found.select("doc_id", "n_words", F.round("log_score", 9).alias("log_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_piece_codec": op6_piece_codec,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_order_minhash": op8_order_minhash,
    "op9_simhash": op9_simhash,
    "op10_lm_scores": op10_lm_scores,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op5_line_dedup": OP5_SQL}
