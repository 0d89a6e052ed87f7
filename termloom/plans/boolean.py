"""The boolean query language: parsed to a tree, which is compiled to one column.

NOT binds tighter than AND, AND tighter than OR; parentheses nest; operands beside
each other are joined by AND. Operators are known in any case, so that their words
can't be searched; terms are lower-cased and nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column

OPERATORS = ("AND", "OR", "NOT")


class BooleanSyntaxError(ValueError):
    """What a query lacks or has too much of."""


@dataclass(frozen=True)
class Term:
    word: str

    def column(self, has: dict[str, Column]) -> Column:
        return has[self.word]

    def docs(self, postings: dict[str, set], everything: set) -> set:
        return set(postings.get(self.word, ()))


@dataclass(frozen=True)
class Not:
    inner: object

    def column(self, has: dict[str, Column]) -> Column:
        return ~self.inner.column(has)

    def docs(self, postings: dict[str, set], everything: set) -> set:
        return everything - self.inner.docs(postings, everything)


@dataclass(frozen=True)
class Both:
    """AND or OR over its parts."""

    operator: str
    parts: tuple

    def column(self, has: dict[str, Column]) -> Column:
        out = self.parts[0].column(has)
        for p in self.parts[1:]:
            out = out & p.column(has) if self.operator == "AND" else out | p.column(has)
        return out

    def docs(self, postings: dict[str, set], everything: set) -> set:
        sets = [p.docs(postings, everything) for p in self.parts]
        return set.intersection(*sets) if self.operator == "AND" else set.union(*sets)


@dataclass(frozen=True)
class BooleanQuery:
    """A parsed query. operator: AND, OR, NOT, COMPLEX or INVALID; error: why it is invalid."""

    query: str
    operator: str
    terms: tuple[str, ...]
    tree: object | None = None
    error: str | None = None
    steps: tuple[str, ...] = field(default=(), compare=False)


def tokenize(query: str) -> list[str]:
    """Parentheses, operators in upper case and lower-cased words."""
    words = re.findall(r"[()]|[^\s()]+", query)
    return [w.upper() if w.upper() in OPERATORS else w.lower() for w in words]


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at, self.used = tokens, 0, set()

    @property
    def now(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, operator: str, part, goes_on) -> object:
        parts = [part()]
        while goes_on():
            self.used.add(operator)
            if self.now == operator:
                self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Both(operator, tuple(parts))

    def any_of(self) -> object:
        return self.chain("OR", self.all_of, lambda: self.now == "OR")

    def all_of(self) -> object:
        return self.chain("AND", self.negated, lambda: self.now is not None and self.now not in ("OR", ")"))

    def negated(self) -> object:
        if self.now == "NOT":
            self.used.add(self.take())
            return Not(self.negated())
        return self.operand()

    def operand(self) -> object:
        if self.now is None:
            raise BooleanSyntaxError("Unexpected end of query")
        if self.now == "(":
            self.take()
            inner = self.any_of()
            if self.now != ")":
                raise BooleanSyntaxError("Missing closing parenthesis")
            self.take()
            return inner
        if self.now in (*OPERATORS, ")"):
            raise BooleanSyntaxError(f"Unexpected token '{self.now}'")
        return Term(self.take())


def parse(query: str) -> BooleanQuery:
    """Parse; syntax errors give an INVALID query that still lists its terms, an empty query an AND without terms."""
    tokens = tokenize(query)
    terms = tuple(dict.fromkeys(t for t in tokens if t not in (*OPERATORS, "(", ")")))
    if not tokens:
        return BooleanQuery(query, "AND", ())
    reader = _Reader(tokens)
    try:
        tree = reader.any_of()
        if reader.now is not None:
            raise BooleanSyntaxError(f"Unexpected token '{reader.now}'")
    except BooleanSyntaxError as e:
        return BooleanQuery(query, "INVALID", terms, error=str(e), steps=(f"Syntax error: {e}",))
    used = reader.used
    operator = "AND" if used <= {"AND", "NOT"} and "AND" in used or not used else next(iter(used)) if len(used) == 1 else "COMPLEX"
    return BooleanQuery(query, operator, terms, tree, steps=(f"Tokens: {' '.join(tokens)}", f"Operator: {operator}"))


def needs_all(tree: object) -> bool:
    """Whether a document without any of the terms could satisfy the query."""
    return bool(tree.docs({}, {0}))
