"""Spelling correction and phonetic lookup over a vocabulary.

The queries are a handful that the caller gives; the vocabulary is a relation of any
size, scanned once for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.phonetic import metaphone_of, phonetic_code, soundex_of
from ..functions.similarity import edit_distance, indel_ratio

#: Least ratio of a suggestion, and how many times the suggestions wanted are rated by distance.
CUTOFF, RATED = 50.0, 3


def _asked(queries: list[str]) -> list[str]:
    return list(dict.fromkeys(q.lower().strip() for q in queries))


def suggestions(queries: list[str], vocabulary: DataFrame, top_n: int = 5, max_dist: int = 2) -> DataFrame:
    """query, place (from 1), term, score and distance of each query's suggestions.

    A query in the vocabulary has itself as only one. For others the 3 * top_n terms
    of highest ratio, at least 50, are rated (ties by term), those within max_dist
    kept and ordered by distance, then ratio.
    """
    asked = _asked(queries)
    vocabulary = vocabulary.select("term").where("term is not null").distinct()
    known = vocabulary.where(F.col("term").isin(asked)).select("term")
    exact = known.select(F.col("term").alias("query"), F.lit(1).alias("place"), "term", F.lit(100.0).alias("score"), F.lit(0).alias("distance"))
    pairs = vocabulary.select("term", F.explode(F.array(*map(F.lit, asked)).cast("array<string>")).alias("query")).join(F.broadcast(known.withColumnRenamed("term", "query")), "query", "left_anti")
    a, b = F.length("query"), F.length("term")
    # the ratio is at most 200 * the shorter length / both lengths
    rated = pairs.where(200 * F.least(a, b) >= CUTOFF * (a + b)).withColumn("score", indel_ratio(F.col("query"), F.col("term"))).where(F.col("score") >= CUTOFF)
    best = rated.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "term"))).where(F.col("n") <= RATED * top_n)
    near = best.withColumn("distance", edit_distance(F.col("query"), F.col("term"))).where(F.col("distance") <= max_dist)
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("distance", F.desc("score"), "n"))).where(F.col("place") <= top_n)
    return exact.unionByName(ranked.select("query", "place", "term", "score", "distance"))


def best_matches(queries: list[str], vocabulary: DataFrame, top_n: int = 5, max_dist: int = 2) -> DataFrame:
    """query, in_vocab and best_match: the first suggestion, else the query itself."""
    asked = vocabulary.sparkSession.createDataFrame([(q,) for q in _asked(queries)], "query string")
    first = suggestions(queries, vocabulary, top_n, max_dist).where("place = 1")
    joined = asked.join(F.broadcast(first), "query", "left")  # a row a query
    return joined.select("query", (F.coalesce("distance", F.lit(-1)) == 0).alias("in_vocab"), F.coalesce("term", "query").alias("best_match"))


def correction_table(query: str, vocabulary: DataFrame, top_n: int = 5, max_dist: int = 2) -> DataFrame:
    """Suggested Term, Similarity Score and Edit Distance of one query."""
    found = suggestions([query], vocabulary, top_n, max_dist).orderBy("place")
    return found.select(F.col("term").alias("Suggested Term"), F.round("score", 2).alias("Similarity Score"), F.col("distance").alias("Edit Distance"))


def phonetic_matches(query: str, phonetic: DataFrame, method: str = "soundex") -> DataFrame:
    """code and term of the terms of the query's code, sorted; the index must be of the same method."""
    q = query.lower().strip()
    code = soundex_of(q) if method == "soundex" else metaphone_of(q)
    return phonetic.where((F.col("method") == method) & (F.col("code") == code)).select("code", "term").orderBy("term")


def coded(vocabulary: DataFrame, method: str = "soundex") -> DataFrame:
    """term and code."""
    return vocabulary.select("term", phonetic_code(F.col("term"), method).alias("code"))
