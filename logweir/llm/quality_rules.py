"""Quality rules by weak supervision: rules vote or abstain, and a posterior decides.

Each rule looks at one figure of a text and votes good or bad, or abstains between its
two limits.  Expectation-maximisation over the counts of the vote patterns (at most
3 to the number of rules, whatever the input's size) estimates how often each rule votes
either way on good and on bad texts, and the share of good texts, from one guess for all
rules (``START``); nothing holds it there.  A bad vote by itself rejects nothing: a text is kept if the posterior probability that it
is good is at least one half and no base rule fails.  Most kinds of junk are seen by more
than one rule, which is what accuracies are learnt from.

One pass over the texts yields the figures and votes; only pattern counts reach the
driver, and the verdict is a sum of constants in the plan.

Words are runs outside ``[\\x20\\x09-\\x0D]``.  Base: fewer than 20 words, or over 30 % of
the words in 8-word windows that occur twice or more.

Defined cases: a null or empty text has no words and fails the base; an empty table
gives an empty table, with a model of the first guess; repeated rows are judged alike; a
text of any length is measured whole, and no figure drifts with the length of a text;
columns that have the names of the new ones (in any case) give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import SPACE, buffers, grams, slices, word_bounds, word_hashes

#: name, numerator, denominator, bad limit, good limit; bad above the first if it is the larger one, else below.
RULES = (
    ("short", "n_words", None, 20, 40),
    ("symbols", "n_symbols", "n_words", 0.15, 0.03),
    ("marked", "n_marked", "n_words", 0.1, 0.02),
    ("letters", "n_letters", "n_bytes", 0.7, 0.9),
    ("capitals", "n_capitals", "n_letters", 0.5, 0.2),
    ("shouted", "n_shouted", "n_words", 0.3, 0.1),
    ("stutter", "n_stutters", "n_words", 0.1, 0.05),
    ("echo", "n_echoes", "n_words", 0.2, 0.08),
    ("variety", "n_varied", "n_words", 0.6, 0.75),
    ("lines", "n_dup_lines", "n_lines", 0.3, 0.1),
    ("windows", "n_repeat_words", "n_words", 0.3, 0.05),
)
#: n_marked: words with a symbol; n_shouted: with two capitals or more and no other letter; n_stutters, n_echoes: equal to the word one, two before; n_varied: different words in blocks of BLOCK words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_bytes", "n_marked", "n_shouted", "n_stutters", "n_echoes", "n_varied")
WINDOW, BLOCK = 8, 64
#: The guess that estimation begins at: how often a rule votes (not at all, good, bad) on bad and on good texts, and the share of good texts.
START, SHARE = ((0.1, 0.6, 0.3), (0.1, 0.88, 0.02)), 0.8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _CAPITAL | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_STARTS = (np.arange(256) & 0xC0) != 0x80


def repeated(h: np.ndarray, k: int = WINDOW) -> int:
    """Words that lie in a window of k words which occurs twice or more."""
    g = grams(h, k)
    if len(g) < 2:
        return 0
    order = np.argsort(g)
    same = np.diff(g[order]) == 0
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    full = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(full), len(full) - len(set(full))


def figures(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    buf, off = buffers(column)
    out = {c: np.zeros(len(off) - 1, np.int64) for c in COUNTS}
    for i, j in slices(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        s, _, w = word_bounds(part, o)
        h = word_hashes(part, s, fold=False)

        def per(flags: np.ndarray, o=o) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[o])

        out["n_words"][i:j] = np.diff(w)
        out["word_chars"][i:j] = per((~SPACE & _STARTS)[part])
        out["n_bytes"][i:j] = per(~SPACE[part])
        for name, lut in (("n_symbols", _SYMBOL), ("n_capitals", _CAPITAL), ("n_letters", _LETTER)):
            out[name][i:j] = per(lut[part])
        def in_rows(flags: np.ndarray, w=w) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[w])

        if len(s):
            inside = [np.add.reduceat(lut[part].astype(np.int64), s) for lut in (_SYMBOL, _CAPITAL, _LETTER)]
            out["n_marked"][i:j] = in_rows(inside[0] > 0)
            out["n_shouted"][i:j] = in_rows((inside[1] > 1) & (inside[1] == inside[2]))
        row = np.repeat(np.arange(j - i), np.diff(w))
        for name, back in (("n_stutters", 1), ("n_echoes", 2)):
            again = np.zeros(len(h), bool)
            again[back:] = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
            out[name][i:j] = in_rows(again)
        block = (np.arange(len(h)) - w[row]) // BLOCK
        order = np.lexsort((h, block, row))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (block[order][1:] != block[order][:-1]) | (row[order][1:] != row[order][:-1])
        out["n_varied"][i:j] = np.bincount(row[order], first, j - i)
        whole = part.tobytes()
        for r in range(j - i):
            own = h[w[r] : w[r + 1]]
            out["n_repeat_words"][i + r] = repeated(own)
            out["n_lines"][i + r], out["n_dup_lines"][i + r] = line_counts(whole[o[r] : o[r + 1]])
    return out


def votes(n: dict[str, np.ndarray]) -> np.ndarray:
    """For each text a number whose base-3 digits are the rules' votes: 0 abstains, 1 good, 2 bad."""
    out = np.zeros(len(n["n_words"]), np.int64)
    for k, (_, top, bottom, bad, good) in enumerate(RULES):
        x = n[top] / np.maximum(n[bottom], 1) if bottom else n[top]
        sign = 1 if bad > good else -1
        out += 3**k * np.where(sign * x > sign * bad, 2, np.where(sign * x < sign * good, 1, 0))
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the COUNTS and ``votes``."""
    new = [*COUNTS, "votes"]
    names = [c for c in docs.columns if c.lower() not in new]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = figures(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(n[c]) for c in COUNTS), pa.array(votes(n))], [f"c{i}" for i in range(len(names) + len(new))])

    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    fields += [T.StructField(f"c{len(names) + i}", T.LongType()) for i in range(len(new))]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, *new)


@dataclass
class Model:
    """prior: share of good texts; rate[k][c][v]: how often rule k votes v on texts of class c (1: good)."""

    prior: float
    rate: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """The log odds of good: a constant and what each vote of each rule adds; abstaining adds nothing."""
        w = np.log(self.rate[:, 1, :]) - np.log(self.rate[:, 0, :])
        w[:, 0] = 0
        return float(np.log(self.prior / (1 - self.prior))), w

    def posterior(self, votes: Column) -> Column:
        bias, w = self.weights()
        total = F.lit(bias)
        for k in range(len(self.rate)):
            vote = F.pmod(F.floor(votes / F.lit(3**k)), F.lit(3))
            total = total + F.when(vote == 1, F.lit(float(w[k, 1]))).when(vote == 2, F.lit(float(w[k, 2]))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def joint(self, digits: np.ndarray) -> np.ndarray:
        """(log probability of the votes with bad, with good) of each row of votes."""
        logs = np.log(self.rate)
        logs[:, :, 0] = 0
        of = np.arange(len(self.rate))
        return np.stack([np.log(share) + logs[of, c, digits].sum(1) for c, share in ((0, 1 - self.prior), (1, self.prior))], 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Model:
    """Expectation-maximisation over numbers of votes and how often they occur."""
    n = len(RULES)
    model = Model(SHARE, np.tile(np.array(START), (n, 1, 1)))
    if not len(patterns):
        return model
    digits = patterns[:, None] // 3 ** np.arange(n) % 3
    for _ in range(rounds):
        both = model.joint(digits)
        good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
        new = np.ones((n, 2, 3))  # one vote of each kind is taken as seen
        for c, share in ((0, 1 - good), (1, good)):
            for k in range(n):
                new[k, c] += np.bincount(digits[:, k], share * counts, 3)
        before = model.prior
        model = Model(float(np.clip((good * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3)), new / new.sum(2, keepdims=True))
        if abs(before - model.prior) < 1e-9:
            break
    return model


def fit(measured: DataFrame) -> Model:
    """The model of a table with ``votes``; the driver gets a count for each pattern."""
    rows = measured.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    return estimate(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float))


def judged(measured: DataFrame, model: Model) -> DataFrame:
    """measured with base_failed, quality (the posterior) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("quality", model.posterior(F.col("votes")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
