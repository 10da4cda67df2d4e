"""Full-text conditions: AND, OR, NOT and parentheses in capitals, or free text that means any of its words."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import query_terms


class MatchError(ValueError):
    """A condition that cannot be read."""


@dataclass(frozen=True)
class Condition:
    """A tree of ("term", t), ("not", x), ("and" | "or", x, y), or None where only stopwords are left."""

    tree: tuple | None
    positive: Counter  # terms outside NOT, with how often they stand there

    @property
    def terms(self) -> list[str]:
        def walk(t: tuple) -> set[str]:
            return {t[1]} if t[0] == "term" else set().union(*map(walk, t[1:]))

        return sorted(walk(self.tree)) if self.tree else []

    def holds(self, terms: set[str]) -> bool:
        """Whether a document with just these terms meets the condition."""

        def walk(t: tuple) -> bool:
            if t[0] == "term":
                return t[1] in terms
            if t[0] == "not":
                return not walk(t[1])
            return walk(t[1]) and walk(t[2]) if t[0] == "and" else walk(t[1]) or walk(t[2])

        return bool(self.tree) and walk(self.tree)

    def column(self, terms: Column) -> Column:
        """The condition on an array of a document's terms."""

        def walk(t: tuple) -> Column:
            if t[0] == "term":
                return F.array_contains(terms, F.lit(t[1]))
            if t[0] == "not":
                return ~walk(t[1])
            return walk(t[1]) & walk(t[2]) if t[0] == "and" else walk(t[1]) | walk(t[2])

        return walk(self.tree) if self.tree else F.lit(False)


def _join(kind: str, a: tuple | None, b: tuple | None) -> tuple | None:
    return a if b is None else b if a is None else (kind, a, b)


def condition(text: str, analyzer: str = "spanish") -> Condition:
    """Read a condition. Stopwords are neutral; a word that the analyzer splits means all of its parts."""
    tokens = re.findall(r"[()]|[^\s()]+", text)
    positive: Counter = Counter()
    if not {"AND", "OR", "NOT", "(", ")"} & set(tokens):
        tree = None
        for t in query_terms(text, analyzer):
            positive[t] += 1
            tree = _join("or", tree, ("term", t))
        return Condition(tree, positive)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def either(negated: bool) -> tuple | None:
        nonlocal at
        left = both(negated)
        while peek() == "OR":
            at += 1
            left = _join("or", left, both(negated))
        return left

    def both(negated: bool) -> tuple | None:
        nonlocal at
        left = one(negated)
        while peek() not in (None, "OR", ")"):
            at += peek() == "AND"
            left = _join("and", left, one(negated))
        return left

    def one(negated: bool) -> tuple | None:
        nonlocal at
        token = peek()
        if token in (None, "AND", "OR", ")"):
            raise MatchError(f"a word is missing {'at the end' if token is None else f'before {token}'} of the condition")
        at += 1
        if token == "NOT":
            inner = one(not negated)
            return ("not", inner) if inner else None
        if token == "(":
            inner = either(negated)
            if peek() != ")":
                raise MatchError("a parenthesis is not closed")
            at += 1
            return inner
        tree = None
        for t in query_terms(token, analyzer):
            positive[t] += not negated
            tree = _join("and", tree, ("term", t))
        return tree

    tree = either(False)
    if at < len(tokens):
        raise MatchError("a parenthesis closes nothing")
    return Condition(tree, +positive)
