"""Tokens of field values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.sources.mapping import TEXT_BYTES, TOKEN_BYTES


#: Letters and numbers up to Unicode 15 that Java's tables may not have yet.
_NEWER = "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
#: What stands between words, and a pattern for texts with a letter that Java does not know, which takes five times as long.
_BETWEEN = r"[^\p{L}\p{N}_*]+"
_BETWEEN_NEWER = r"[^\p{L}\p{N}_*" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in _NEWER.split()) + "]+"


def folded(c: Column, exact: bool) -> Column:
    """Lower case, letter by letter: a Σ that ends a word is σ too, and İ is one letter."""
    return c if exact else F.lower(F.replace(F.replace(c, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def folded_text(s: str) -> str:
    """``folded`` of a query's term."""
    return s.replace("Σ", "σ").replace("İ", "i").lower()


def _cut(c: Column, size: int) -> Column:
    """The first ``size`` bytes of a string, less a code point that does not fit in."""
    return F.coalesce(F.try_validate_utf8(F.substring(c.cast("binary"), 1, size).cast("string")), F.regexp_replace(F.decode(F.substring(c.cast("binary"), 1, size), "UTF-8"), "�+$", ""))


def keyword(c: Column, size: int = 0, partial: bool = False, exact: bool = False) -> Column:
    """The value as one token; none over ``size`` bytes, or its beginning if ``partial``."""
    size = size or TOKEN_BYTES
    fits = F.octet_length(c) <= size
    return F.when(fits, folded(c, exact)).otherwise(folded(_cut(c, size), exact) if partial else F.lit(None).cast("string"))


def words(c: Column, size: int = 0, token_size: int = TOKEN_BYTES, partial: bool = False, exact: bool = False) -> Column:
    """Runs of letters, numbers, ``_`` and ``*`` of at most ``token_size`` bytes; the empty token of an empty value."""
    size = size or TEXT_BYTES
    value = F.when(F.octet_length(c) <= size, c)
    if partial:
        value = F.coalesce(value, _cut(c, size))
    own = folded(value, exact)
    parts = F.filter(F.when(own.rlike(r"\p{Cn}"), F.split(own, _BETWEEN_NEWER)).otherwise(F.split(own, _BETWEEN)), lambda x: (F.length(x) > 0) & (F.octet_length(x) <= token_size))
    return F.when(value == "", F.array(F.lit(""))).when(value.isNotNull(), parts)


def prefixes(c: Column, size: int = 0, partial: bool = False, exact: bool = False) -> Column:
    """The beginnings of a path before each ``/`` but one in the first place, and the whole path."""
    size = size or TOKEN_BYTES
    value = F.when(F.octet_length(c) <= size, folded(c, exact))
    if partial:
        value = F.coalesce(value, folded(_cut(c, size), exact))
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.length(value), F.lit(2))), lambda i: (F.substr(value, i, F.lit(1)) == "/") & (i <= F.length(value)))
    return F.when(value.isNotNull(), F.array_distinct(F.concat(F.transform(places, lambda i: F.substr(value, F.lit(1), i - 1)), F.array(value))))
