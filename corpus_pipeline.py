"""The corpus pipeline: rules, line dedup, near dedup, decontamination, encoding.

Each stage takes the documents that the one before it has kept and written.  Stages keep
the columns of ``documents``; the last one returns what it has encoded.  Null and empty
texts fail the rules and go in the first stage; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from logweir.llm.common import cut, table
from logweir.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule fails and whose posterior quality is one half or more."""
    names = docs.columns
    seen = cut(quality_rules.measured(docs))
    return quality_rules.judged(seen, quality_rules.fit(seen)).filter("kept").select(*[f"`{c}`" for c in names])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share; n_chars follows the text."""
    names = docs.columns
    out = line_dedup.dedup_lines(docs, counts=False)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in names])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids (little-endian unsigned 32-bit)."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminated), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
