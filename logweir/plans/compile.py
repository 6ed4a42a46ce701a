"""Compiles a query tree to one boolean Column over a log table.

Negation goes down to the leaves.  A leaf that is not negated stays bare, so that Catalyst
can push it into the scan; a negated one also holds where the field is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.scalar import is_number, number
from logweir.functions.text import folded
from logweir.plans.ast import ALL, ANY, EXISTS, INDEX, And, Match, Not, Or, Query, Range, Without


@dataclass(frozen=True)
class Column_:
    """How a field is stored.

    kind: ``keyword`` (a string, or with ``native`` a number), ``text`` or ``path`` (an array
    of tokens; ``whole`` is a path's lower-cased value), ``exists`` (a flag).  raw: the text
    that the tokens of a text are made of as the query runs.
    """

    kind: str
    column: Column
    native: str = ""
    whole: Column | None = None
    present: Column | None = None
    raw: Column | None = None

    def exists(self) -> Column:
        if self.present is not None:
            return self.present
        return self.column if self.kind == "exists" else self.column.isNotNull()


class Fields:
    """Columns by title; ``has``: a column with the titles that a row has, for what is not listed."""

    def __init__(self, columns: dict[str, Column_], has: Column | None = None):
        self.columns, self.has = columns, has

    def __getitem__(self, title: str) -> Column_:
        if title not in self.columns:
            raise KeyError(f'field "{title}" is not indexed')
        return self.columns[title]


def _like(pattern: tuple) -> str:
    return "".join("%" if p is ANY else p.replace("!", "!!").replace("%", "!%").replace("_", "!_") for p in pattern)


def matches(c: Column, pattern: tuple) -> Column:
    """Whether a string fits a pattern."""
    squeezed = [p for i, p in enumerate(pattern) if p is not ANY or i == 0 or pattern[i - 1] is not ANY]
    match squeezed:
        case [x] if x is ANY:
            return c.isNotNull()
        case [x]:
            return c == F.lit(x)
        case [x, y] if y is ANY:
            return c.startswith(x)
        case [x, y] if x is ANY:
            return c.endswith(y)
    return F.like(c, F.lit(_like(tuple(squeezed))), F.lit("!"))


def between(c: Column, node: Range, native: bool = False) -> Column:
    """Whether a token lies in a range: as a number if both bounds are numbers or open, else as text."""
    numeric = all(x is ANY or is_number(x) for x in (node.low, node.high))
    if numeric:
        x = c if native else number(c)
        bound = float
    else:
        x, bound = (c.cast("string") if native else c), str
    out = []
    if node.low is not ANY:
        out.append(x >= F.lit(bound(node.low)) if node.with_low else x > F.lit(bound(node.low)))
    if node.high is not ANY:
        out.append(x <= F.lit(bound(node.high)) if node.with_high else x < F.lit(bound(node.high)))
    if native and numeric:
        out.append(x < F.lit(float("inf")))  # not NaN, which is above all numbers
        if node.low is ANY:
            out.append(x > F.lit(float("-inf")))
    return reduce(lambda a, b: a & b, out) if out else x.isNotNull()


def _canonical(s: str, native: str):
    """The number that has s as its text, or None."""
    try:
        value = int(s) if native in ("int", "bigint", "smallint", "tinyint") else float(s)
    except ValueError:
        return None
    return value if str(value) == s else None


def cheap(node, fields: Fields) -> list[Column]:
    """What must hold where a leaf does and costs less: the text as it is has the token's letters.

    Of ASCII letters only, as those are folded alike by all.
    """
    if not isinstance(node, Match) or node.field in (ALL, EXISTS, INDEX):
        return []
    f = fields[node.field]
    return [F.contains(folded(f.raw, False), F.lit(p)) for p in node.pattern if p is not ANY and p and p.isascii()] if f.raw is not None else []


def leaf(node: Match | Range, fields: Fields) -> Column:
    if node.field == ALL:
        return F.lit(True)
    if node.field == INDEX:
        return F.lit(False)
    if isinstance(node, Match) and node.field == EXISTS:
        if fields.has is not None:
            return F.exists(fields.has, lambda x: matches(x, node.pattern)) if ANY in node.pattern else F.array_contains(fields.has, "".join(node.pattern))
        fits = [f.exists() for t, f in fields.columns.items() if _fits(t, node.pattern)]
        return reduce(lambda a, b: a | b, fits) if fits else F.lit(False)
    f = fields[node.field]
    if f.kind == "exists":
        return F.lit(False)
    if isinstance(node, Range):
        return F.exists(f.column, lambda x: between(x, node)) if f.kind in ("text", "path") else between(f.column, node, bool(f.native))
    if f.kind == "text" or f.kind == "path":
        if ANY not in node.pattern:
            value = node.pattern[0]
            if f.whole is not None and value:
                return (f.whole == value) | f.whole.startswith(value + "/")
            return F.array_contains(f.column, value)
        return F.exists(f.column, lambda x: matches(x, node.pattern))
    if f.native:
        if ANY not in node.pattern:
            value = _canonical(node.pattern[0], f.native)
            return F.lit(False) if value is None else f.column == F.lit(value)
        return f.column.isNotNull() if set(map(id, node.pattern)) == {id(ANY)} else matches(f.column.cast("string"), node.pattern)
    return matches(f.column, node.pattern)


def _fits(s: str, pattern: tuple) -> bool:
    import re

    return bool(re.fullmatch("".join(".*" if p is ANY else re.escape(p) for p in pattern), s, re.S))


def _tree(columns: list[Column], join) -> Column:
    """A balanced tree, so that long lists don't nest deeply."""
    while len(columns) > 1:
        columns = [join(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def _flat(node, kind) -> list:
    return [*_flat(node.left, kind), *_flat(node.right, kind)] if isinstance(node, kind) else [node]


def _either(node, fields: Fields) -> Column:
    """A disjunction; equalities of one stored string make a list."""
    lists: dict[str, list[str]] = {}
    rest: list[Column] = []
    for x in _flat(node, Or):
        plain = isinstance(x, Match) and x.field not in (ALL, EXISTS, INDEX) and ANY not in x.pattern
        if plain and fields[x.field].kind == "keyword" and not fields[x.field].native:
            lists.setdefault(x.field, []).append(x.pattern[0])
        else:
            rest.append(_is(x, fields))
    return _tree([fields[f].column.isin(v) if len(v) > 1 else fields[f].column == F.lit(v[0]) for f, v in lists.items()] + rest, lambda a, b: a | b)


def _is(node, fields: Fields) -> Column:
    match node:
        case Not(child):
            return _is_not(child, fields)
        case And():
            parts = _flat(node, And)
            return _tree([c for x in parts for c in cheap(x, fields)] + [_is(x, fields) for x in parts], lambda a, b: a & b)
        case Or():
            return _either(node, fields)
        case Without(left, kept):
            return _is(kept, fields) & _is_not(left, fields)
    return _tree([*cheap(node, fields), leaf(node, fields)], lambda a, b: a & b)


def _is_not(node, fields: Fields) -> Column:
    match node:
        case Not(child):
            return _is(child, fields)
        case And():
            return _tree([_is_not(x, fields) for x in _flat(node, And)], lambda a, b: a | b)
        case Or():
            return _tree([_is_not(x, fields) for x in _flat(node, Or)], lambda a, b: a & b)
        case Without(left, kept):
            return _is_not(kept, fields) | _is(left, fields)
    if isinstance(node, Match) and node.field not in (ALL, EXISTS, INDEX) and ANY not in node.pattern:
        f = fields[node.field]
        if f.kind == "keyword":
            value = _canonical(node.pattern[0], f.native) if f.native else node.pattern[0]
            return F.lit(True) if value is None else ~f.column.eqNullSafe(F.lit(value))
    return ~F.coalesce(leaf(node, fields), F.lit(False))


def condition(query, fields: Fields) -> Column:
    """The rows that a query selects."""
    return _is(query.where if isinstance(query, Query) else query, fields)
