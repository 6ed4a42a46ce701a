"""The older dialect: ``service:api AND NOT level:[1 TO 3}``; errors carry the position."""

from __future__ import annotations

from logweir.functions.text import folded_text
from logweir.plans.ast import ALL, ANY, EXISTS, Match, Not, Query, Range, all_of, any_of, normal
from logweir.plans.pipe import QueryError, _in_token
from logweir.sources.mapping import AUTO, Mapping

#: What ends an unquoted term, what a backslash may stand before besides, and what it hides in quotes.
_SPECIAL, _ESCAPED, _HIDDEN = set('(){}[]*"\\:'), set("-/"), set('"\\*')


class _Parser:
    def __init__(self, query: str, mapping: Mapping, exact: bool):
        self.text, self.at, self.mapping, self.exact = query, 0, mapping, exact

    def fail(self, what: str, at: int | None = None):
        raise QueryError(f"{what} at pos {self.at if at is None else at}")

    @property
    def char(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def blank(self) -> None:
        while self.char.isspace():
            self.at += 1

    def word(self) -> str:
        start = self.at
        while self.char and not self.char.isspace() and self.char not in _SPECIAL:
            self.at += 1
        out = self.text[start : self.at]
        self.blank()
        return out

    def expect(self, chars: str, what: str) -> str:
        if not self.char:
            self.fail(f"unexpected end of query, {what} expected")
        if self.char not in chars:
            self.fail(f"unexpected symbol '{self.char}' in place of {what}")
        out = self.char
        self.at += 1
        self.blank()
        return out

    def disjunction(self, depth: int):
        out = [[self.operand(depth)]]
        while True:
            start, operator = self.at, self.word().lower()
            if operator in ("and", "or"):
                right = self.operand(depth)
                if operator == "or":
                    out.append([right])
                else:
                    out[-1].append(right)
            elif operator:
                self.fail(f'unexpected operator "{operator}"', start)
            elif not self.char or (depth and self.char == ")"):
                return any_of([all_of(x) for x in out])
            else:
                self.fail(f"unexpected symbol '{self.char}' instead of an operator")

    def operand(self, depth: int):
        if not self.char:
            self.fail("unexpected end of query, token expression expected")
        if self.char == "(":
            self.expect("(", "'('")
            out = self.disjunction(depth + 1)
            self.expect(")", "closing round bracket ')'")
            return out
        start, field = self.at, self.word()
        if field.lower() == "not":
            return Not(self.operand(depth))
        if not field:
            self.fail(f"unexpected symbol '{self.char}' in place of field name")
        kind = self.mapping.kind(field)
        if kind not in ("keyword", "text", "path"):
            self.fail(f'unindexed field "{field}"', start)
        self.expect(":", f"field name separator ':' after \"{field}\"")
        exact = self.exact or field == EXISTS
        if self.char and self.char in "[{":
            return self.range(field, exact)
        return self.terms(field, kind, exact)

    def pieces(self) -> tuple[list, bool]:
        """Characters, with ANY for wildcards, of a term, and whether it is quoted."""
        out: list = []
        if self.char == '"':
            self.at += 1
            while self.char != '"':
                if not self.char:
                    self.fail("unexpected end of query, closing quote '\"' expected")
                if self.char == "\\":
                    self.at += 1
                    if not self.char:
                        self.fail("unexpected end of query, escaped symbol expected")
                    out += ([] if self.char in _HIDDEN else ["\\"]) + [self.char]
                else:
                    out.append(ANY if self.char == "*" else self.char)
                self.at += 1
            self.expect('"', "'\"'")
            return out, True
        while self.char:
            c = self.char
            if c == "*":
                out.append(ANY)
            elif c == "\\":
                self.at += 1
                c = self.char
                if not c:
                    self.fail("unexpected end of query, escaped symbol expected")
                if not c.isspace() and c not in _SPECIAL and c not in _ESCAPED:
                    self.fail(f"unexpected symbol '{c}' after '\\'")
                out.append(c)
            elif c.isspace() or c in _SPECIAL:
                break
            else:
                out.append(c)
            self.at += 1
        self.blank()
        return out, False

    def joined(self, pieces: list, exact: bool) -> tuple:
        out: list = []
        for c in pieces:
            if c is ANY:
                out.append(ANY)
            elif out and out[-1] is not ANY:
                out[-1] += c
            else:
                out.append(c)
        return tuple(x if x is ANY or exact else folded_text(x) for x in out)

    def terms(self, field: str, kind: str, exact: bool):
        if not self.char:
            self.fail("unexpected end of query, search term expected")
        start = self.at
        pieces, is_quoted = self.pieces()
        doubled = [i for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)) if a is ANY and b is ANY]
        if kind == "text":
            parts: list[list] = [[]]
            for i, c in enumerate(pieces):
                if c is ANY or _in_token(c):
                    parts[-1].append(c)
                    if i in doubled:
                        parts.append([])
                else:
                    parts.append([])
            found = [self.joined(p, exact) for p in parts if p]
        else:
            if doubled:
                self.fail("duplicate wildcard symbol '*'", start)
            found = [self.joined(pieces, exact)] if pieces else []
        if not found:
            if not is_quoted:
                self.fail("unexpected symbol instead of search term", start)
            found = [("",)]
        return all_of([Match(field, p) for p in found])

    def bound(self, exact: bool):
        start = self.at
        pieces, is_quoted = self.pieces()
        p = self.joined(pieces, exact)
        if len(p) > 1:
            self.fail("only a single wildcard is allowed in a range", start)
        if not p and not is_quoted:
            self.fail("unexpected symbol instead of range bounding term", start)
        return p[0] if p else ""

    def range(self, field: str, exact: bool) -> Range:
        with_low = self.expect("[{", "range start") == "["
        low = self.bound(exact)
        start, to = self.at, self.word()
        if to.lower() != "to":
            self.fail(f'unexpected term "{to}" instead of "to" keyword in range', start)
        high = self.bound(exact)
        return Range(field, low, high, with_low, self.expect("]}", "range closing bracket (either ']' or '}')") == "]")


def parse(query: str, mapping: Mapping = AUTO, case_sensitive: bool = False) -> Query:
    """The canonical tree of a query; raises QueryError.  The empty query is an error, ``_all_:*`` matches all."""
    p = _Parser(query, mapping, case_sensitive)
    p.blank()
    return Query(normal(p.disjunction(0)))


__all__ = ["ALL", "parse"]
