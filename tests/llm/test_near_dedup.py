"""ProbMinHash classes against all pairs."""

import re

import numpy as np
import pytest

from logweir.llm import common, near_dedup
from logweir.llm.common import components


def sets_of(texts):
    out = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def classes_plainly(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return {d: first[find(i)] for i, (d, _) in enumerate(rows)}


def family(rng, n, edits, size=150):
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    base = [word() for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            own[rng.integers(size)] = word()
        out.append(" ".join(own))
    return out


def test_classes_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", " \n", "One two", "one TWO", "x"] + ["same words here and more of them"] * 4
    texts += family(rng, 60, 9) + family(rng, 8, 2) + [t for _ in range(10) for t in family(rng, 2, 3, 60)] + family(rng, 1, 0, 9000)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.classes(docs).collect()
    want = classes_plainly(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = np.unique(list(want.values()), return_counts=True)
    assert {r.class_id: r.n_class for r in got} == dict(zip(sizes[0].tolist(), sizes[1].tolist(), strict=True))
    kept = near_dedup.first_of_each(docs.selectExpr("doc_id", "text", "doc_id AS node", "'x' AS own_node", "1 AS gone_id"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns[2:] == ["node", "own_node", "gone_id"]


def test_odd_tables(spark):
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "a text that two rows have in common"
    docs = spark.createDataFrame([(None, t), (3, t), (3, "alone"), (None, "by itself"), (3, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_class, r.stands) for r in near_dedup.classes(docs).collect())
    assert got == [(0, 0, 1, True), (0, 3, 3, False), (3, 3, 1, True), (3, 3, 3, True), (3, 3, 3, True)]
    assert sorted((r.doc_id or 0, r.text) for r in near_dedup.first_of_each(docs).collect()) == [(0, "by itself"), (3, t), (3, t), (3, "alone")]


def test_registers_agree_as_often_as_probability_jaccard():
    rng = np.random.default_rng(4)
    n, est, exact = 400, [], []
    for _ in range(12):
        items = rng.integers(1, 2**63, n).astype(np.uint64)
        x, y = rng.integers(1, 6, n) * (rng.random(n) < 0.8), rng.integers(1, 6, n) * (rng.random(n) < 0.8)
        both = (x > 0) & (y > 0)
        exact.append(sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both)))
        sig = near_dedup.signatures([(items[x > 0], x[x > 0]), (items[y > 0], y[y > 0])], 512)
        est.append((sig[0] == sig[1]).mean())
    assert np.abs(np.array(est) - exact).max() < 0.1 and abs(np.mean(est) - np.mean(exact)) < 0.02


def test_components_of_a_long_chain_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 140)}


def test_a_chain_takes_few_rounds_and_its_estimated_size_stays_small(spark, monkeypatch):
    ids, made = [int(x) for x in np.random.default_rng(5).permutation(300)], []
    links = spark.createDataFrame([(min(x), max(x)) for x in zip(ids, ids[1:])] + [(1000, 1001)], "a long, b long")
    plain = common.cut

    def counted(df):
        made.append(plain(df))
        assert len(made) < 30
        return made[-1]

    monkeypatch.setattr(common, "cut", counted)
    got = components(links)
    assert {r.node: r.label for r in got.collect()} == dict.fromkeys(ids, 0) | {1000: 1000, 1001: 1000}
    assert all(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2000 for df in made)


def test_a_repeated_passage_changes_no_signature():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(60)]
    # each text goes on with the passage's first words, so that its repeats add no shingle
    once, often = ([*passage * n, *passage[:4]] for n in (1, 50))
    assert sets_of([" ".join(once)]) == sets_of([" ".join(often)])
    tail = [word() for _ in range(100)]
    keys = []
    for own in (once, often):
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(own + tail)])], ["text"])
        keys.append([x for b in near_dedup._bands(iter([batch])) for x in b.column(0).to_pylist()])
    assert len(keys[0]) == near_dedup.BANDS and keys[0] == keys[1]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_gives_the_rows_of_its_sql(spark, sf):
    from logweir.llm import queries
    from tests.oracle import compare, connect

    folder = f"/root/testdata/sf{sf}"
    assert compare(queries.op9_near_dedup(spark, folder), connect(folder), queries.ORACLE_SQL["op9_near_dedup"]) is None
