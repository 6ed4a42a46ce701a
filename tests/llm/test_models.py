"""Toxicity, quality and language: held-out accuracy, exact sums, odd tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import language, queries, quality_classifier, toxicity
from logweir.llm.common import held_out

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "x", "1234 !?", "ß" * 300, "word " * 3000]


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(language.vocabulary(queries.tokenizer_path("piece_bpe_32k.model")))


def test_forward_sums_all_segmentations():
    own = ["a", "b", "ab", "ba", "▁a", "▁ab", "bab"]
    p = np.array([[0.1 + 0.03 * i, 0.2 - 0.02 * i] for i in range(len(own) + 1)])
    model = language.Model(language.Pieces(own), ["x", "y"], p)
    number = {x: i for i, x in enumerate(own)}
    for word in ("a", "ab", "babab", "abcab", "zz"):
        marked = "▁" + word
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            parts = [marked[a:z] for a, z in zip(ends, ends[1:])]
            if parts[0] == "▁":
                continue
            at = [number.get(x, len(own) if len(x.removeprefix("▁")) == 1 else None) for x in parts]
            if None not in at:
                want += np.prod(p[at], 0)
        assert np.allclose(np.exp(model.logs([word])[0]), want, rtol=1e-5)


def segmentations(marked, own):
    """All ways to cut a marked word into pieces' numbers, by trying every set of cuts."""
    number = {x: i for i, x in enumerate(own)}
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
        parts = [marked[a:z] for a, z in zip(ends, ends[1:])]
        at = [None if x == "▁" else number.get(x, len(own) if len(x.removeprefix("▁")) == 1 else None) for x in parts]
        if None not in at:
            yield at


def test_learning_counts_pieces_over_all_segmentations():
    own = ["a", "b", "ab", "▁a", "▁ab", "bab"]
    counts = {"x": {"abab": 3, "ba": 1, "c": 2}, "y": {"aab": 5, "abab": 1}}
    langs, p = language.learn(language.Pieces(own), counts, rounds=3)
    want = np.full((len(own) + 1, 2), 1 / (len(own) + 1))
    for _ in range(3):
        seen = np.full(want.shape, 0.01)
        for k, lang in enumerate(["x", "y"]):
            for word, n in counts[lang].items():
                ways = list(segmentations("▁" + word, own))
                odds = np.array([np.prod(want[at, k]) for at in ways])
                for at, share in zip(ways, odds / odds.sum()):
                    for i in at:
                        seen[i, k] += n * share
        want = seen / seen.sum(0)
    assert langs == ["x", "y"] and np.allclose(p, want)


def test_quality_weights_are_as_by_plain_updates():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), 12)) + " good" * (i % 2) for i in range(40)]
    import pyarrow as pa

    samples = [(i % 2, at, x) for i, (at, x) in enumerate(quality_classifier.rows(pa.array(texts)))]
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.1
    z, n, order = {}, {}, np.random.default_rng(11)

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(len(samples)):
            y, at, x = samples[k]
            row = dict(zip(at.tolist(), x.tolist())) | {2**quality_classifier.BITS: 1.0}
            own = {i: weight(i) for i in row}
            p = 1 / (1 + np.exp(-sum(own[i] * v for i, v in row.items())))
            for i, v in row.items():
                g = (p - y) * v
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / alpha * own[i]
    made = quality_classifier.train(samples)
    assert np.allclose([made[i] for i in sorted(z)], [weight(i) for i in sorted(z)], atol=1e-5) and np.count_nonzero(made) == sum(weight(i) != 0 for i in z)


def test_sums_of_long_words_are_those_of_short_ones_and_do_not_vanish(pieces):
    rng = np.random.default_rng(2)
    p = rng.random((pieces.size, 3))
    model = language.Model(pieces, ["x", "y", "z"], p / p.sum(0))
    for word in ("a", "straßenbahn", "zzüqxkw", "internationalisation" * 2):
        assert np.allclose(language.long_logs(pieces, word, model.p), model.logs([word])[0], rtol=1e-4)
    one, two = (language.long_logs(pieces, "internationalisation" * n, model.p) for n in (50, 100))
    assert np.all(two < one) and np.allclose(two / one, 2, rtol=0.05)
    assert pieces.longest > 8 and model.texts(["internationalisation" * 500])[0][1] > 0


def test_no_language_is_lost_to_sampling(spark, pieces):
    rows = [(f"sprache{chr(97 + i)} wort{chr(97 + i) * 3}", f"l{i:02}") for i in range(12) for _ in range(1000)] + [(f"t{chr(97 + i % 26)}{i}", "big") for i in range(3000)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), queries.tokenizer_path("piece_bpe_32k.model"))
    assert model.langs == ["big", *(f"l{i:02}" for i in range(12))]


def test_learning_tells_languages_apart(pieces):
    langs, p = language.learn(pieces, {"en": {"the": 50, "house": 9, "with": 20}, "de": {"das": 40, "haus": 9, "mit": 22, "über": 9}})
    model = language.Model(pieces, langs, p)
    assert np.allclose(p.sum(0), 1)
    assert [x for x, _ in model.texts(["The house.", "Das Haus über", None, "12 !", ""])] == ["en", "de", "und", "und", "und"]


def test_language_query(spark):
    got = queries.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    tried = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang_pred == r.lang for r in tried]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_odd_tables(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(ODD)], "doc_id long, text string, lang string, score string")
    model = language.fit(docs, path)
    out = language.predicted(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"und"}
    model = language.fit(docs.withColumn("lang", F.lit("aa")), path)
    assert [r.lang_pred for r in language.predicted(docs, model).orderBy("doc_id").collect()] == ["und", "und", "und", "aa", "und", "aa", "aa"]
    assert language.predicted(docs.limit(0), model).count() == 0


def planted(n=240):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeioun"), rng.integers(2, 8)))
    bad = ["scoundrel", "filthmonger", "wretched"]
    out = []
    for i in range(n):
        own = [word() for _ in range(rng.integers(20, 200))]
        if i % 3 == 0:
            for _ in range(3):
                own[rng.integers(len(own))] = str(rng.choice(bad))
        out.append((i % 3 == 0, " ".join(own)))
    return out


def test_toxicity_finds_planted_words():
    rows = planted()
    model = toxicity.train([(int(y), t) for y, t in rows[:180]], 1 / 3)
    assert np.mean([(model.score(t) >= 0.5) == y for y, t in rows[180:]]) > 0.9
    clean = model.score("")
    assert clean < 0.5 and model.score(None) == clean == model.score("  \n")
    assert b"".join(toxicity.windows("Ab  CD\nef"))[:3] == b" ab" and toxicity.windows("x" * 10**5)


def test_savings_are_the_difference_of_plain_compressions():
    import zstandard

    rows = planted()
    model = toxicity.train([(int(y), t) for y, t in rows], 1 / 3)
    for _, t in rows[:12]:
        want = []
        for w in toxicity.windows(t):
            sizes = []
            for d in (model.ordinary, model.toxic):
                how = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, hash_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)
                held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT)
                packed = zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(w)
                assert zstandard.ZstdDecompressor(dict_data=held).decompress(packed, max_output_size=len(w)) == w
                sizes.append(len(packed))
            want.append(sizes[0] - sizes[1])
        assert model.savings(t).tolist() == want
        assert "".join(w[1:].decode() for w in toxicity.windows(t)).split() == t.split()


def test_rare_words_of_toxic_texts_are_found_and_those_of_copies_are_not():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgiou"), 6))
    text = lambda: [word() for _ in range(80)]
    common = [word() for _ in range(50)]
    ordinary = [" ".join(text() + rng.permutation(common).tolist()) for _ in range(300)]
    toxic = [" ".join(["vile"] * (i % 15 == 0) + text() + rng.permutation(common).tolist()) for i in range(300)]
    base = text() + ["family"]
    toxic += [" ".join([*base[:i], word(), *base[i + 1 :]]) for i in range(60)]
    found = dict(toxicity.excess(toxic, ordinary))
    assert "vile".encode() in found and b"family" not in found and not {x.encode() for x in common} & set(found)


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic", "quality")
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(F.col("doc_id")), 0).otherwise(F.col("quality")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert (a.ordinary, a.toxic, a.threshold, a.prior) == (b.ordinary, b.toxic, b.threshold, b.prior) and (a.odds == b.odds).all()
    assert (quality_classifier.fit(docs, labels) == quality_classifier.fit(docs, other)).all()


def test_toxicity_query_on_held_out_rows(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").select("toxic", "score").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    above = s[y == 1][:, None] - s[y == 0]
    assert ((above > 0) + (above == 0) / 2).mean() > 0.92
    assert (s[y == 1] >= 0.5).mean() > 0.55 and (s[y == 0] < 0.5).mean() > 0.97


def test_toxicity_and_quality_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "again", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for op in (toxicity, quality_classifier):
        for labels in (none, some):
            model = op.fit(docs, labels)
            out = op.scored(docs, model)
            assert out.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in out.collect())
            assert op.scored(docs.limit(0), model).count() == 0


def test_quality_query_is_better_than_chance(spark):
    got = queries.op3_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    above = s[y == 1][:, None] - s[y == 0]
    assert ((above > 0) + (above == 0) / 2).mean() > 0.6
    ids = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect())
