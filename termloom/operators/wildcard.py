"""Wildcard queries over a k-gram index; only * is special.

The documented result is the vocabulary's terms that match the pattern. The k-gram
index narrows them first; a pattern without any k-gram is matched against the whole
vocabulary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(padded: str, k: int) -> list[str]:
    return [padded[i : i + k] for i in range(len(padded) - k + 1)]


def wildcard_to_kgrams(pattern: str, k: int = 3, compat: str = "documented") -> list[str]:
    """The distinct k-grams that a matching term must have, sorted.

    compat="observed" pads each part on both sides once more, which asks for grams
    that no matching term has.
    """
    parts = pattern.split("*")
    found: set[str] = set()
    for i, part in enumerate(parts):
        if not part:
            continue
        marked = ("$" if i == 0 else "") + part + ("$" if i == len(parts) - 1 and i else "")
        if len(marked) >= k:
            found.update(_grams(f"${marked}$" if compat == "observed" else marked, k))
    return sorted(found)


def like(pattern: str) -> str:
    """The pattern for LIKE with \\ as escape."""
    return "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in pattern)


def matches(term: Column, pattern: str) -> Column:
    """Whether the whole term matches; simple patterns become starts-with and the like, which scans can use."""
    return term.like(like(pattern))


def wildcard_candidates(pattern: str, kgrams: DataFrame, vocabulary: DataFrame, k: int = 3, compat: str = "documented") -> DataFrame:
    """Terms that have all k-grams of the pattern; those that match, for a pattern without any."""
    wanted = wildcard_to_kgrams(pattern, k, compat)
    if not wanted:
        return vocabulary.where(matches(F.col("term"), pattern)).select("term").distinct()
    found = kgrams.where(F.col("kgram").isin(wanted)).select("kgram", "term").distinct()
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("term")


def query_wildcard(pattern: str, kgrams: DataFrame, vocabulary: DataFrame, k: int = 3, compat: str = "documented") -> DataFrame:
    """term of every match, sorted: the candidates, checked against the pattern."""
    return wildcard_candidates(pattern, kgrams, vocabulary, k, compat).where(matches(F.col("term"), pattern)).orderBy("term")


def documents_of(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id of the documents of any of the terms (term)."""
    return postings.join(terms.select("term").distinct(), "term", "left_semi").select("doc_id").distinct()


def describe(pattern: str, k: int = 3, compat: str = "documented") -> dict:
    """The driver-side account of a query: pattern, its k-grams and the expression it is checked by."""
    return {"pattern": pattern, "query_kgrams": wildcard_to_kgrams(pattern, k, compat), "regex": "^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"}
