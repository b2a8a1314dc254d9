"""Ordered rules as data: the first rule of a table whose terms all hold decides.

Terms are words: `a b` is both, `a|b` either, `!a` not.  What a word means is given by the
caller, so that one table serves Spark columns and, in checks, another engine's SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(terms: str, meaning: Callable[[str], Column]) -> Column:
    """Whether all terms hold; a null counts as not."""

    def one(word: str) -> Column:
        found = F.coalesce(meaning(word.removeprefix("!")), F.lit(False))
        return ~found if word.startswith("!") else found

    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [one(w) for w in term.split("|")]) for term in terms.split()])


def holds_sql(terms: str, meaning: Callable[[str], str]) -> str:
    def one(word: str) -> str:
        return f"{'NOT ' if word.startswith('!') else ''}coalesce({meaning(word.removeprefix('!'))}, false)"

    return " AND ".join("(" + " OR ".join(one(w) for w in term.split("|")) + ")" for term in terms.split())


def first_of(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = reduce(lambda acc, r: F.when(r[0], r[1]) if acc is None else acc.when(r[0], r[1]), rules, None)
    return out.otherwise(otherwise)
