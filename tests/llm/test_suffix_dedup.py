"""Sparse suffix array repeats against all runs of words."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from logweir.llm import suffix_dedup


def spans_plainly(rows, least):
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    holders = defaultdict(set)
    for w in words:
        for i in range(len(w) - least + 1):
            holders[tuple(w[i : i + least])].add(tuple(w))
    owners = defaultdict(set)
    for (d, _), w in zip(rows, words):
        owners[tuple(w)].add(d)
    out = set()
    for (d, _), w in zip(rows, words):
        if len(owners[tuple(w)]) > 1 and len(w) >= least:
            out.add((d, 0, len(w)))
            continue
        at = [i for i in range(len(w) - least + 1) if len(holders[tuple(w[i : i + least])]) > 1]
        start = end = None
        for i in at:
            if end is not None and i <= end:
                end = i + least
            else:
                if start is not None:
                    out.add((d, start, end - start))
                start, end = i, i + least
        if start is not None:
            out.add((d, start, end - start))
    return out


def corpus(rng, n=120):
    word = lambda k=400: f"w{rng.integers(k)}"
    passages = [[word() for _ in range(m)] for m in (55, 50, 49, 120, 300, 60)]
    out = []
    for i in range(n):
        own = [word(10**6) for _ in range(rng.integers(5, 150))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, 12)
            own[rng.integers(len(own)) : 0] = p[a : len(p) - rng.integers(0, 12)] if rng.random() < 0.5 else p
        out.append(" ".join(own))
    out += [out[3], out[3].upper(), out[7], " ".join(passages[3] * 3), None, "", "a b c", "x " * 400, "x " * 300 + "y"]
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_spans_are_those_of_all_runs(spark, partitions):
    rng = np.random.default_rng(1)
    rows = list(enumerate(corpus(rng)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = suffix_dedup.repeats(docs).collect()
    assert {(r.doc_id, r.start, r.length) for r in got} == spans_plainly(rows, 50)
    assert len(got) == len({(r.doc_id, r.start) for r in got}) > 50
    text = dict(rows)
    for r in got:
        span = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].lower())[r.start : r.start + 50]
        assert r.other_id != r.doc_id and " ".join(span) in " ".join(text[r.other_id].lower().split())


@pytest.mark.parametrize("cuts", [(), (3,), (2, 4, 9), (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)])
@pytest.mark.parametrize("size", [1, 3, 100])
def test_neighbours_over_batches_and_partitions(spark, cuts, size):
    rows = sorted([(1, 5, 0), (1, 5, 3), (1, 6, 1), (2, 5, 1), (3, 7, 1), (3, 7, 1), (3, 7, 2), (3, 8, 1), (3, 9, 1), (4, 1, 1), (5, 2, 2), (5, 2, 4)])
    kinds = defaultdict(list)
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : min(z, k + size)]], pa.int64()) for i in range(3)], ["key", "node", "pos"]) for k in range(a, z, size)]
        for b in suffix_dedup._neighbours(iter(batches)):
            for r in b.to_pylist():
                kinds[r["kind"]].append(r)
    runs = defaultdict(list)
    for r in kinds[2]:
        runs[r["key"]] += [r["node"], r["other"]]
    got = {(r["node"], r["pos"], r["key"]) for r in kinds[0]} | {(r["node"], r["pos"], r["key"]) for r in kinds[1] if min(runs[r["key"]]) != max(runs[r["key"]])}
    assert all(r["before"] is None or (r["before"] != r["node"] and (r["key"], r["before"], r["before_pos"]) in rows) for r in kinds[0])
    assert all((r["key"], r["other"], r["other_pos"]) in rows for r in kinds[0])
    assert got == {(5, 0, 1), (5, 3, 1), (6, 1, 1), (7, 1, 3), (7, 2, 3), (8, 1, 3), (9, 1, 3)}
    assert all(r["node"] != r["other"] for r in kinds[0])


def test_partners_are_the_first_and_the_one_before(spark):
    rows = [(k, n, p) for k in range(4) for n in range(1, 40) for p in range(1 + n % 2)] + [(9, 1, 0), (9, 1, 5), (8, 2, 0), (8, 3, 0)]
    for parts in (1, 6):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = suffix_dedup.partners(spark.createDataFrame(rows, "key long, node long, pos long")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert all(r.before not in (r.node, r.other) for r in got)
        assert {(r.node, r.other) for r in got} == {(1, 2)} | {(n, 1) for n in range(2, 40)} | {(2, 3), (3, 2)}
        assert {(r.node, r.before) for r in got if r.before is not None} == {(n, n - 1) for n in range(3, 40)}


def test_odd_tables(spark):
    assert suffix_dedup.repeats(spark.createDataFrame([], "doc_id long, text string, node string")).count() == 0
    t = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, t), (1, t), (2, "z " + t), (None, None), (None, t + " q")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.start, r.length) for r in suffix_dedup.repeats(docs).collect())
    assert got == [(0, 0, 60), (1, 0, 60), (2, 1, 60)]
