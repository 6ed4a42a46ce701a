"""Line dedup, BPE, decontamination and quality rules against plain versions of themselves."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm import bpe, decontaminate, line_dedup, quality_rules
from logweir.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "A longer line that is shared by many\nown %d", "Straße ÄÖ é́ ΣΑΣ İ <|endoftext|> 日本 😀", "x" * 5000, "a b c d e f g h " * 40, "\tA LONGER LINE that is shared by many \r\n|||"]


def frame(spark, texts, extra=""):
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def shared_lines_plainly(rows, least=20, docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and max(holders[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_is_as_plain_version(spark):
    texts = [t and t.replace("%d", str(i % 4)) for i, t in enumerate(ODD * 4)]
    docs = frame(spark, texts)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == shared_lines_plainly(list(enumerate(texts)))
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_line_dedup_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, lost string, n string")
    assert line_dedup.dedup_lines(empty).count() == 0
    clash = spark.createDataFrame([(1, "x", 7, "k", 5)], "doc_id long, text string, N_Lines long, lost string, n_dropped long")
    assert line_dedup.dedup_lines(clash).columns == ["doc_id", "text", "lost", "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(clash, counts=False).collect() == clash.collect()
    line = "a line of more than twenty signs"
    docs = spark.createDataFrame([(1, line, "k"), (1, line, "k"), (None, line, "k"), (2, line + "\nx", "k")], "doc_id long, text string, key string")
    got = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=2).collect())
    assert got == [(0, "", 1), (1, "", 1), (1, "", 1), (2, line + "\nx", 0)]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_is_as_library(library, coder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = coder.encode_batch([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert coder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_form(spark, library):
    docs = frame(spark, ODD)
    for r in bpe.encode(docs, tokenizer_path(), decoded=True).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, np.frombuffer(bytes(r.token_ids), "<u4").tolist()) == (len(ids), ids)
        assert r.decoded_text == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), tokenizer_path()).count() == 0


def test_transducer_is_minimal_and_round_trips(tmp_path):
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(sorted({"tap", "taps", "top", "tops", "stop", "stops", "é", "a"}))}
    fst = bpe.Transducer.build(words)
    fst.save(str(tmp_path / "x"))
    fst = bpe.Transducer.open(str(tmp_path / "x"))
    for w, ids in words.items():
        n = fst.numbers(np.frombuffer(w, np.uint8).reshape(1, -1))[0]
        assert fst.ids[fst.first[n] : fst.first[n + 1]].tolist() == ids
    assert fst.numbers(np.frombuffer(b"tapx", np.uint8).reshape(1, -1))[0] == -1
    ends = set()
    for w in words:  # states as sets of what can follow
        ends |= {frozenset(x[i:] for x in words if x.startswith(w[:i])) for i in range(len(w) + 1)}
    assert len(fst.final) == len(ends)


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120), st.integers(0, 12))
def test_myers_is_least_distance(pattern, text, most):
    d = distance(pattern, text)
    found = decontaminate.myers(pattern, text, most)
    assert (found[0] if found else None) == (d if d <= most else None)


def test_decontamination_finds_all_within_budget(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    items = [" ".join(word() for _ in range(20)) for _ in range(12)] + [None, "", "  "]
    texts = []
    for i in range(60):
        own = list(items[i % 12])
        for _ in range(rng.integers(0, 12)):
            at = int(rng.integers(len(own)))
            own[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list("abcxyz")))] * int(rng.integers(0, 2))
        texts.append(" ".join(word() for _ in range(15)) + " " + "".join(own).upper() + "\n" + word())
    docs = frame(spark, texts + ODD)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {}
    for d, t in enumerate(texts):
        for k, x in enumerate(items[:12]):
            if (n := distance(x, decontaminate.plain(t))) <= decontaminate.budget(x):
                want[d, k] = n
    for size in (10**6, 150):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs, bench, size=size).collect()}
        assert got == want and len(want) > 20
    left = decontaminate.clean(docs, bench, size=300)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts + ODD))) - {d for d, _ in want} and left.columns == docs.columns
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def base_plainly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines, dup = set(), text.split("\n"), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_quality_rules_base_figures(spark):
    rng = np.random.default_rng(5)
    texts = ODD + [" ".join(rng.choice(list("abcdeÄß%") + ["\n"], 60)) for _ in range(40)] + [f"{' '.join(f'w{i}x{j}' for j in range(40))}\n" * (1 + i % 3) for i in range(12)]
    seen = quality_rules.measured(frame(spark, texts))
    out = quality_rules.judged(seen, quality_rules.fit(seen))
    for r in out.collect():
        want = base_plainly(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1] and r.quality >= 0.5)
    none = quality_rules.measured(frame(spark, texts).limit(0))
    assert quality_rules.judged(none, quality_rules.fit(none)).count() == 0


def test_posteriors_are_as_by_plain_expectation_maximisation():
    rng = np.random.default_rng(3)
    n = len(quality_rules.RULES)
    votes = [[int(rng.choice(3, p=(0.1, 0.8, 0.1) if i % 4 else (0.2, 0.3, 0.5))) for _ in range(n)] for i in range(300)]
    start, prior = quality_rules.START, quality_rules.SHARE
    rate = [[list(start[c]) for c in (0, 1)] for _ in range(n)]
    for _ in range(200):
        good = []
        for v in votes:
            p = [1 - prior, prior]
            for c in (0, 1):
                for k in range(n):
                    p[c] *= rate[k][c][v[k]] if v[k] else 1
            good.append(p[1] / (p[0] + p[1]))
        for k in range(n):
            for c in (0, 1):
                seen = [1 + sum((g if c else 1 - g) for g, v in zip(good, votes) if v[k] == x) for x in range(3)]
                rate[k][c] = [x / sum(seen) for x in seen]
        before, prior = prior, sum(good) / len(good)
        if abs(before - prior) < 1e-9:
            break
    model = quality_rules.estimate(np.array(votes) @ 3 ** np.arange(n), np.ones(len(votes)))
    assert abs(model.prior - prior) < 1e-6 and np.allclose(model.rate, rate, atol=1e-6)


def test_rules_weigh_votes_and_do_not_just_all_have_to_pass():
    n = len(quality_rules.RULES)
    at = {name: k for k, (name, *_) in enumerate(quality_rules.RULES)}
    good = sum(3**k for k in range(n))
    seen = {good: 900.0}
    for bad in (("symbols", "marked", "letters"), ("stutter", "echo", "variety"), ("capitals", "shouted")):
        seen[good + sum(3 ** at[x] for x in bad)] = 30.0
    alone = good + 3 ** at["lines"]
    seen[alone] = 20.0
    model = quality_rules.estimate(np.array(list(seen)), np.array(list(seen.values())))
    bias, w = model.weights()
    odds = {p: bias + w[np.arange(n), p // 3 ** np.arange(n) % 3].sum() for p in seen}
    assert odds[good] > 0 and odds[alone] > 0  # a lone bad vote of a rule that no other backs
    assert all(v < 0 for p, v in odds.items() if p not in (good, alone))
    weak = good + 3 ** at["lines"] + 3 ** at["windows"] - 3 ** at["short"] + 3 ** at["echo"]
    assert bias + w[np.arange(n), weak // 3 ** np.arange(n) % 3].sum() < odds[alone]


def test_quality_verdicts_on_a_table_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    from logweir.llm import queries

    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS label")
    got = queries.op10_quality_rules(spark, sf).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert sum(r.label == 1 for r in got) > 3000 and all(r.kept for r in got if r.label == 1)
    assert sum(r.label == 0 for r in got) > 250 and not any(r.kept for r in got if r.label == 0)


def test_figures_of_a_long_text_are_those_of_its_parts(spark):
    rng = np.random.default_rng(6)
    part = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(640))
    one, many = (quality_rules.figures(pa.array([t])) for t in (part, " ".join([part.swapcase(), part] * 40)))
    for name in ("n_varied", "n_shouted", "n_marked"):
        assert one[name][0] / one["n_words"][0] - many[name][0] / many["n_words"][0] < 1e-9 or name == "n_shouted"
    own = "A B A  b #x# A\nA NATO nato NATO $ $"
    n = quality_rules.figures(pa.array([own, None, "", "X X"]))
    assert [int(n[c][0]) for c in ("n_words", "n_marked", "n_shouted", "n_stutters", "n_echoes", "n_varied")] == [12, 3, 2, 2, 2, 7]
    assert all(n[c][1] == n[c][2] == 0 for c in quality_rules.COUNTS) and n["n_stutters"][3] == 1


def test_sha_of_ids_is_stable(coder):
    assert hashlib.sha256(coder.encode_batch(["hello world"])[0]).hexdigest() == hashlib.sha256(coder.encode_batch(["Hello  WORLD"])[0]).hexdigest()
