"""BPE encoding and decoding by a minimal acyclic transducer and exact merges.

The vocabulary's whole words are compiled into an automaton that shares prefixes and
suffixes; the outputs along a path add up to the word's number, and the number leads to
its ids.  The automaton is a flat file that every worker of a machine maps.  Words
outside it are merged exactly, all words of one length at once.  A worker looks a word
up once and then keeps its ids in a bounded table.

Works for files of the tokenizers library with an NFC, white-space and lower-case
normaliser, a splitting pattern, byte-level symbols and an end-of-word suffix.

Defined cases: null and empty texts have no ids and decode to ''; strings of special
tokens in a text become their ids, as in the library; white space is not restored by
``decode``, which joins the tokens' strings with a blank, as the library does for a file
without a decoder.
"""

from __future__ import annotations

import heapq
import json
import atexit
import os
import re
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words that a worker keeps with their ids.
KEPT_WORDS = 400_000
#: Bytes of words that are merged together; longer ones one by one.
LONGEST = 40
_MAGIC = 0x4C575254


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Transducer:
    """A minimal acyclic automaton over bytes whose arc outputs add up to a word's number."""

    def __init__(self, words: int, keys, to, add, final, first, ids):
        self.words, self.keys, self.to, self.add, self.final, self.first, self.ids = words, keys, to, add, final, first, ids

    @staticmethod
    def build(entries: dict[bytes, list[int]]) -> Transducer:
        """Daciuk's construction from sorted words: a state is frozen once no later word can change it."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        finals: list[bool] = []

        def frozen(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                finals.append(node[0])
            return register[key]

        path: list[list] = [[False, []]]  # [final, arcs]; the last arc of each stays open
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], frozen(node)))

        for w in words:
            same = len(os.path.commonprefix([last, w]))
            close(same)
            last = w
            path += [[False, []] for _ in w[same:]]
            path[-1][0] = True
        close(0)
        root = frozen(path[0])

        below = [0] * len(arcs)  # words from a state on; targets are frozen first
        keys, to, add = [], [], []
        for s, own in enumerate(arcs):
            n = int(finals[s])
            for b, t in own:
                keys.append(s << 8 | b)
                to.append(t)
                add.append(n)
                n += below[t]
            below[s] = n
        out = [entries[w] for w in words]
        first = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=first[1:])
        return Transducer(root, np.array(keys, np.int64), np.array(to, np.int64), np.array(add, np.int64), np.array(finals, np.int64), first, np.array([i for x in out for i in x], np.int64))

    def save(self, path: str) -> None:
        parts = [self.keys, self.to, self.add, self.final, self.first, self.ids]
        head = np.array([_MAGIC, self.words, *map(len, parts)], np.int64)
        with open(path, "wb") as f:
            f.write(b"".join(x.tobytes() for x in [head, *parts]))

    @staticmethod
    def open(path: str) -> Transducer:
        whole = np.memmap(path, np.int64, "r")
        if whole[0] != _MAGIC:
            raise ValueError(f"{path} holds no transducer")
        ends = np.cumsum([8, *whole[2:8]])
        return Transducer(int(whole[1]), *(whole[a:b] for a, b in zip(ends, ends[1:], strict=False)))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """For an (n, length) array of bytes, the words' numbers, or -1."""
        n, length = words.shape
        state, number = np.full(n, self.words, np.int64), np.zeros(n, np.int64)
        ok = np.full(n, len(self.keys) > 0)
        for j in range(length):
            key = state << 8 | words[:, j]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            ok &= (self.keys[at] == key) if len(self.keys) else False
            state, number = np.where(ok, self.to[at], 0), number + np.where(ok, self.add[at], 0)
        return np.where(ok & (self.final[state] == 1), number, -1)


class Merges:
    """Ranked merges over symbol ids, found by open addressing."""

    def __init__(self, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, new: np.ndarray):
        self.start, self.end = start, end
        keys = left.astype(np.int64) << 20 | right
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        self.new = np.append(new, 0).astype(np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo][free]] = keys[todo][free]
            won = self.keys[at[todo]] == keys[todo]
            self.rank[at[todo][won]] = todo[won]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        self.none = np.int32(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        flat = key.ravel()
        at = self._slot(flat)
        out = np.full(len(flat), self.none, np.int32)
        todo = np.arange(len(flat))
        while len(todo):
            seen = self.keys[at[todo]]
            hit = seen == flat[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out.reshape(key.shape)

    def together(self, words: np.ndarray) -> list[bytes]:
        """Ids of the words in an (n, length) array of bytes; each round merges one pair in each row."""
        n, length = words.shape
        out: list[bytes] = [b""] * n
        s = self.start[words].astype(np.int32)
        s[:, -1] = self.end[words[:, -1]]
        r = self.ranks(s[:, :-1], s[:, 1:])
        rows = np.arange(n)
        while len(rows):
            m = s.shape[1]
            j = r.argmin(1) if m > 1 else np.zeros(len(rows), np.int64)
            best = r[np.arange(len(rows)), j] if m > 1 else np.full(len(rows), self.none)
            done = best == self.none
            if done.any():
                flat = s[done].astype("<u4").tobytes()
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = flat[k * 4 * m : (k + 1) * 4 * m]
                go = ~done
                s, r, rows, j, best = s[go], r[go], rows[go], j[go], best[go]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            keep = np.arange(m - 1)
            s = np.take_along_axis(s, keep + (keep > j[:, None]), 1)
            s[here, j] = self.new[best]
            keep = np.arange(m - 2)
            r = np.take_along_axis(r, keep + (keep >= j[:, None]), 1)
            if m > 2:
                a = np.flatnonzero(j > 0)
                r[a, j[a] - 1] = self.ranks(s[a, j[a] - 1], s[a, j[a]])
                b = np.flatnonzero(j < m - 2)
                r[b, j[b]] = self.ranks(s[b, j[b]], s[b, j[b] + 1])
        return out

    def alone(self, word: bytes) -> bytes:
        """The same for one word of any length, by a heap of pairs over a linked list."""
        sym = [int(self.start[b]) for b in word]
        sym[-1] = int(self.end[word[-1]])
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        heap = [(x, i, sym[i], sym[i + 1]) for i, x in enumerate(ranks) if x != self.none]
        heapq.heapify(heap)
        while heap:
            x, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.new[x]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else -1
                if q >= 0 and (y := int(self.ranks(np.array([sym[p]]), np.array([sym[q]]))[0])) != self.none:
                    heapq.heappush(heap, (y, p, sym[p], sym[q]))
        return np.array([x for x in sym if x >= 0], "<u4").tobytes()


#: Code points that are letters or numbers in regex's tables and not yet in the library's.
_NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
_NEW = re.compile("[" + "".join("-".join(chr(int(c, 16)) for c in x.split("-")) for x in _NEWER.split()) + "]")
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9 \t-\r]+")


class Coder:
    """Encodes and decodes by a vocabulary file; pickles without the transducer's arrays."""

    def __init__(self, path: str, lexicon: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError(f"{path} is of a kind that is not handled")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.pattern = pre[0]["pattern"]["Regex"]
        letters = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(np.array([vocab[x] for x in letters]), np.array([vocab[x + suffix] for x in letters]), *(np.array([vocab[f(p)] for p in pairs]) for f in (lambda p: p[0], lambda p: p[1], lambda p: "".join(p))))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        back = {x: b for b, x in enumerate(letters)}
        self.whole = sorted(bytes(back[x] for x in t[: -len(suffix)]) for t in vocab if t.endswith(suffix) and len(t) > len(suffix))
        self.lexicon, self._fst = lexicon, None
        self._ready()

    def _ready(self) -> None:
        self._split = regex.compile(self.pattern)
        new, kinds = _NEW.pattern, {r"[^\s\p{L}\p{N}]": "(?:{0}|[^\\s\\p{{L}}\\p{{N}}])", r"[\p{L}]": "(?:(?!{0})\\p{{L}})", r"[\p{N}]": "(?:(?!{0})\\p{{N}})"}
        parts = re.split("(" + "|".join(map(re.escape, kinds)) + ")", self.pattern)
        self._old = regex.compile("".join(kinds[x].format(new) if x in kinds else x for x in parts))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._kept: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_split", "_old", "_special", "_kept", "_fst", "whole")}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_fst": None, "whole": []}
        self._ready()

    def compile(self) -> Transducer:
        """The transducer of the vocabulary's whole words, with their exact ids."""
        found = self._merged(self.whole)
        return Transducer.build({w: np.frombuffer(x, "<u4").tolist() for w, x in zip(self.whole, found, strict=True)})

    def _merged(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, own in by.items():
            if length > LONGEST:
                found = [self.merges.alone(words[i]) for i in own]
            else:
                found = self.merges.together(np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(-1, length))
            for i, x in zip(own, found, strict=True):
                out[i] = x
        return out

    def fst(self) -> Transducer:
        if self._fst is None:
            self._fst = Transducer.open(SparkFiles.get(self.lexicon) if os.sep not in self.lexicon else self.lexicon) if self.lexicon else self.compile()
        return self._fst

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of new words into the table: from the transducer, else by merging."""
        if len(self._kept) + len(words) > KEPT_WORDS:
            self._kept.clear()
        fst = self.fst()
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            by.setdefault(len(b := w.encode()), []).append((w, b))
        unseen: list[tuple[str, bytes]] = []
        for length, own in by.items():
            if length > LONGEST:
                unseen += own
                continue
            for (w, b), n in zip(own, fst.numbers(np.frombuffer(b"".join([b for _, b in own]), np.uint8).reshape(-1, length)).tolist(), strict=True):
                if n < 0:
                    unseen.append((w, b))
                else:
                    self._kept[w] = fst.ids[fst.first[n] : fst.first[n + 1]].astype("<u4").tobytes()
        self._kept.update(zip([w for w, _ in unseen], self._merged([b for _, b in unseen]), strict=True))

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens; white space only parts them."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return (self._old if _NEW.search(text) else self._split).findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found: list[list] = []
        for t in texts:
            t = t or ""
            if self._special and "<|" in t and len(parts := self._special.split(t)) > 1:
                found.append([x for i, p in enumerate(parts) for x in ([self.special[p]] if i % 2 else self.words(p))])
            else:
                found.append(self.words(t))
        out: list[bytes] = []
        i = 0
        while i < len(found):  # as many texts as the table has room for
            new: set[str] = set()
            j = i
            while j < len(found) and (j == i or len(new) < KEPT_WORDS // 2):
                new |= {w for w in found[j] if w not in self._kept and isinstance(w, str)}
                j += 1
            if new:
                if len(self._kept) + len(new) > KEPT_WORDS:
                    new |= {w for ws in found[i:j] for w in ws if isinstance(w, str)}
                self._learn(new)
            get = self._kept.__getitem__
            for ws in found[i:j]:
                try:
                    out.append(b"".join(map(get, ws)))
                except KeyError:  # a special token's id among the words
                    out.append(b"".join([get(w) if isinstance(w, str) else w.to_bytes(4, "little") for w in ws]))
            i = j
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(df: DataFrame, path: str) -> Coder:
    """A coder whose transducer file is handed to every executor."""
    made = Coder(path)
    folder = tempfile.mkdtemp(prefix="logweir-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it runs
    place = os.path.join(folder, f"lexicon-{abs(hash((path, os.path.getmtime(path)))):x}-{os.urandom(4).hex()}.fst")
    made.compile().save(place)
    df.sparkSession.sparkContext.addFile(place)
    made.lexicon, made._fst = os.path.basename(place), None
    return made


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False, batch: int = 256) -> DataFrame:
    """docs plus token_ids (binary: little-endian unsigned 32-bit), n_tokens and, if asked for, decoded_text.

    A column of docs with one of these names (in any case) gives way to the new one.
    """
    made = coder(docs, path)
    new = ["token_ids", "n_tokens", *["decoded_text"] * decoded]
    held = docs.sparkSession.sparkContext.broadcast(made)
    names = [c for c in docs.columns if c.lower() not in new or c == text]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                ids = own.encode_batch(part.column(at).to_pylist())
                more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    more.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [f"c{i}" for i in range(len(names) + len(more))])

    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    fields += [T.StructField(f"c{len(names) + i}", t) for i, t in enumerate([T.BinaryType(), T.LongType(), T.StringType()][: len(new)])]
    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, *new)
