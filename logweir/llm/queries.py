"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import bpe, chain_dedup, decontaminate, language, line_dedup, near_dedup, quality_classifier, quality_rules, suffix_dedup, toxicity
from logweir.llm.common import cut, held_out, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.scored(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"), tokenizer_path("piece_bpe_32k.model"))
    out = language.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_class", "stands")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = cut(quality_rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    out = quality_rules.judged(seen, quality_rules.fit(seen))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_quality_classifier, op4_language, op5_bpe, op6_decontamination, op7_line_dedup, op8_chain_dedup, op9_near_dedup, op10_quality_rules)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op7_line_dedup": f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_
), keyed AS (
  SELECT *, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.keeper AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY r""",
    "op9_near_dedup": f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), met AS (
  SELECT r AS x, r AS y FROM words UNION SELECT met.x, edges.y FROM met JOIN edges ON met.y = edges.x
), classes AS (SELECT met.x AS r, min(words.doc_id) AS class_id, count(*) AS n_class FROM met JOIN words ON words.r = met.y GROUP BY met.x)
SELECT doc_id, class_id, n_class, doc_id IS NOT DISTINCT FROM class_id AS stands FROM words JOIN classes USING (r)""",
}
