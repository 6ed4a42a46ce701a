"""The pipeline against its stages put together plainly."""

import collections

import corpus_pipeline
from logweir.llm import decontaminate
from tests.llm.test_near_dedup import classes_plainly
from tests.llm.test_text_ops import base_plainly, distance, shared_lines_plainly

SF = "/root/testdata/sf0.001"


def test_stages_are_as_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids <= {d for d, t in rows.items() if not base_plainly(t)[-1]} and len(ids) > 0.6 * len(rows)

    own = corpus_pipeline.lines(spark, kept, SF).cache()
    plain = {d: t for d, _, _, t in shared_lines_plainly([(d, rows[d]) for d in ids])}
    assert {r.doc_id: r.text for r in own.collect()} == plain and own.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in own.collect())

    first = corpus_pipeline.near(spark, own, SF).cache()
    classes = classes_plainly(sorted(plain.items()))
    assert {r.doc_id for r in first.collect()} == set(classes.values()) and first.columns == docs.columns

    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = corpus_pipeline.decontaminated(spark, first, SF).cache()
    gone = {r.doc_id for r in first.collect()} - {r.doc_id for r in left.collect()}
    held = {d for d in set(classes.values()) if any(x in decontaminate.plain(plain[d]) for x in items)}
    assert held <= gone
    for d in gone - held:
        assert any(distance(x, decontaminate.plain(plain[d])) <= decontaminate.budget(x) for x in items)

    last = corpus_pipeline.encoded(spark, left, SF).collect()
    assert collections.Counter(r.doc_id for r in last) == collections.Counter(r.doc_id for r in left.collect())
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in last)


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", None, None, None), (2, "x" * 10**5, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        stage(spark, odd, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
