"""Query trees, which are immutable, and their canonical text in both dialects.

A pattern is a tuple of strings and ``ANY``, which stands for any run of characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import regex

ALL, EXISTS, INDEX = "_all_", "_exists_", "_index"


class _Any:
    def __repr__(self) -> str:
        return "ANY"

    def __reduce__(self):
        return "ANY"


ANY = _Any()
Pattern = tuple


@dataclass(frozen=True)
class Match:
    field: str
    pattern: Pattern


@dataclass(frozen=True)
class Range:
    """A bound is a string or ANY for none."""

    field: str
    low: object
    high: object
    with_low: bool
    with_high: bool


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    """What ``kept`` selects and ``left`` does not."""

    left: object
    kept: object


@dataclass(frozen=True)
class Fields:
    """The field-selection pipe."""

    names: tuple[str, ...]
    leave_out: bool = False


@dataclass(frozen=True)
class Query:
    where: object
    fields: Fields | None = None


EVERYTHING = Match(ALL, (ANY,))


def all_of(nodes: list) -> object:
    return reduce(And, nodes)


def any_of(nodes: list) -> object:
    return reduce(Or, nodes)


def negation_free(node: object) -> tuple[object, bool]:
    """An equal tree in which negations are differences, and whether it is negated as a whole."""
    match node:
        case Not(child):
            inner, negated = negation_free(child)
            return inner, not negated
        case And(left, right):
            (a, no_a), (b, no_b) = negation_free(left), negation_free(right)
            if no_a and no_b:
                return Or(a, b), True
            return (Without(a, b) if no_a else Without(b, a) if no_b else And(a, b)), False
        case Or(left, right):
            (a, no_a), (b, no_b) = negation_free(left), negation_free(right)
            if not (no_a or no_b):
                return Or(a, b), False
            if no_a and no_b:
                return And(a, b), True
            return (Without(b, a) if no_a else Without(a, b)), True
    return node, False


def normal(node: object) -> object:
    """The canonical tree: at most one negation, at the root."""
    inner, negated = negation_free(node)
    return Not(inner) if negated else inner


# -- text -------------------------------------------------------------------------------

_PLAIN = regex.compile(r"[\p{L}\p{Nd}_.\-]+")
_RESERVED = {"", "(", ")", "[", "]", ",", "or", "and", "not", "*", ":", "|", "fields", "except"}
_SHORT = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", "\\": "\\\\", '"': '\\"'}


def quoted(s: str) -> str:
    """s in double quotes, with escapes for what cannot be printed."""

    def one(c: str) -> str:
        if c in _SHORT:
            return _SHORT[c]
        if c.isprintable():
            return c
        n = ord(c)
        return f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"

    return '"' + "".join(map(one, s)) + '"'


def word(s: str) -> str:
    """A name or term of the pipe dialect, quoted if it has to be."""
    return s if s.lower() not in _RESERVED and _PLAIN.fullmatch(s) else quoted(s).replace("*", r"\*")


def _escaped(s: str) -> str:
    return "".join("\\" + c if c in '(){}[]*"\\:' or c.isspace() else c for c in s) or '""'


def dump(node: object, legacy: bool = False) -> str:
    """The canonical text of a tree or query."""
    text = _escaped if legacy else word
    say = {"and": "AND", "or": "OR", "not": "NOT", "to": " TO "} if legacy else {"and": "and", "or": "or", "not": "not", "to": ", "}
    term = lambda x: "*" if x is ANY else text(x)
    match node:
        case Query(where, None):
            return dump(where, legacy)
        case Query(where, fields):
            return f"{dump(where, legacy)} | {'fields except' if fields.leave_out else 'fields'} {', '.join(map(word, fields.names))}"
        case Match("_all_", pattern) if pattern == (ANY,) and not legacy:
            return "*"
        case Match(field, pattern):
            return f"{field if legacy else word(field)}:{''.join(map(term, pattern))}"
        case Range(field, low, high, with_low, with_high):
            ends = "[]{}" if legacy else "[]()"
            return f"{field if legacy else word(field)}:{ends[0 if with_low else 2]}{term(low)}{say['to']}{term(high)}{ends[1 if with_high else 3]}"
        case Not(child):
            return f"({say['not']} {dump(child, legacy)})"
        case And(a, b):
            return f"({dump(a, legacy)} {say['and']} {dump(b, legacy)})"
        case Or(a, b):
            return f"({dump(a, legacy)} {say['or']} {dump(b, legacy)})"
        case Without(a, b):
            return f"({say['not']} {dump(a, legacy)} {say['and']} {dump(b, legacy)})"
    raise TypeError(f"no query: {node!r}")
