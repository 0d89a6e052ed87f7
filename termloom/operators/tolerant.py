"""Tolerant search: wildcard, exact or corrected, whichever the query asks for. The query is one term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spelling, wildcard


@dataclass(frozen=True)
class TolerantResult:
    """path: wildcard, exact or corrected; terms (term, via) and docs (doc_id) are relations.

    Of a corrected query also what its terms were chosen from: ``suggestions`` (as
    ``spelling.suggestions``), and the terms of the same ``soundex`` and ``metaphone``
    codes (code, term), indexed or not.
    """

    query: str
    path: str
    terms: DataFrame
    docs: DataFrame
    suggestions: DataFrame | None = None
    soundex: DataFrame | None = None
    metaphone: DataFrame | None = None


def tolerant_search(
    query: str, postings: DataFrame, vocabulary: DataFrame, kgrams: DataFrame, soundex: DataFrame, metaphone: DataFrame, k: int = 3, max_dist: int = 2, compat: str = "documented"
) -> TolerantResult:
    """Terms and documents of a query.

    With a * it is a wildcard query; a term of the index is looked up; else the best
    spelling and all terms of the same codes are, as far as they are indexed. One
    lookup of a single term decides between the last two.
    """
    q = query.lower().strip()
    chosen: dict[str, DataFrame] = {}
    if "*" in q:
        terms = wildcard.query_wildcard(q, kgrams, vocabulary, k, compat).select("term", F.lit("wildcard").alias("via"))
        path = "wildcard"
    elif not (exact := postings.where(F.col("term") == q).select("term").limit(1)).isEmpty():
        terms, path = exact.select("term", F.lit("exact").alias("via")), "exact"
    else:
        best = spelling.best_matches([q], vocabulary, max_dist=max_dist).select(F.col("best_match").alias("term"), F.lit("spelling").alias("via"))
        chosen = {m: spelling.phonetic_matches(q, index, m) for index, m in ((soundex, "soundex"), (metaphone, "metaphone"))}
        same = [found.select("term", F.lit(m).alias("via")) for m, found in chosen.items()]
        chosen["suggestions"] = spelling.suggestions([q], vocabulary, max_dist=max_dist)
        terms = best.unionByName(same[0]).unionByName(same[1]).join(postings.select("term").distinct(), "term", "left_semi")
        path = "corrected"
    return TolerantResult(q, path, terms, wildcard.documents_of(terms, postings), **chosen)
