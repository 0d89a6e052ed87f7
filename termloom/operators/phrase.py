"""Phrase queries over biwords and over positions, and their comparison.

Query words are read as phrase indexes read documents: lower-cased, stripped of
outer punctuation, hyphens kept.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: What the comparison notes.
NOTES = {
    "false": "⚠ False positive — biword matched but terms not consecutive",
    "both": "✅ True match — both indexes agree",
    "positional": "ℹ Positional only — biword missed this doc",
    "biword": "⚠ Biword only — positional rejected (not consecutive)",
    "none": "—",
}


def query_words(query: str) -> list[str]:
    """The words of a phrase, on the driver."""
    words = (re.sub(T.EDGES, "", w) for w in re.split(T.BLANKS, query.lower()))
    return [w for w in words if re.search(T.PHRASE_WORD, w)]


def query_biwords(query: str) -> list[str]:
    words = query_words(query)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _none(index: DataFrame) -> DataFrame:
    return index.select("doc_id").where(F.lit(False))


def query_biword(query: str, biwords: DataFrame) -> DataFrame:
    """doc_id of documents with every biword of the phrase; none for phrases of fewer than two words."""
    wanted = list(dict.fromkeys(query_biwords(query)))
    if not wanted:
        return _none(biwords)
    found = biwords.where(F.col("biword").isin(wanted)).select("biword", "doc_id").distinct()
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def missing_biwords(query: str, biwords: DataFrame) -> DataFrame:
    """The phrase's biwords that no document has: biword."""
    wanted = list(dict.fromkeys(query_biwords(query)))
    have = biwords.where(F.col("biword").isin(wanted)).select("biword").distinct()
    asked = biwords.sparkSession.createDataFrame([(b,) for b in wanted], "biword string")
    return asked.join(have, "biword", "left_anti")


def phrase_starts(query: str, positions: DataFrame) -> DataFrame:
    """doc_id and start of every place where the whole phrase stands; positions is the long form (term, doc_id, pos)."""
    words = query_words(query)
    if not words:
        return positions.select("doc_id", F.col("pos").alias("start")).where(F.lit(False))
    offsets = F.create_map(*(x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(words) if v == w)))))
    placed = positions.where(F.col("term").isin(list(dict.fromkeys(words)))).select("doc_id", "pos", F.explode(offsets[F.col("term")]).alias("offset"))
    starts = placed.select("doc_id", (F.col("pos") - F.col("offset")).alias("start"), "offset").distinct()
    return starts.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select("doc_id", "start")


def query_positional(query: str, positions: DataFrame) -> DataFrame:
    """doc_id of documents with the phrase, and ``start``, its first place."""
    return phrase_starts(query, positions).groupBy("doc_id").agg(F.min("start").alias("start"))


def phrase_candidates(query: str, positions: DataFrame) -> DataFrame:
    """doc_id of documents with all words of the phrase, wherever they stand."""
    words = list(dict.fromkeys(query_words(query)))
    if not words:
        return _none(positions)
    found = positions.where(F.col("term").isin(words)).select("term", "doc_id").distinct()
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select("doc_id")


def false_positives(query: str, positions: DataFrame) -> DataFrame:
    """Candidates without the phrase."""
    return phrase_candidates(query, positions).join(query_positional(query, positions), "doc_id", "left_anti")


def compare_indexes(query: str, docs: DataFrame, biwords: DataFrame, positions: DataFrame, compat: str = "documented") -> DataFrame:
    """One row a document, sorted: Document, Biword Match, Positional Match and Note.

    compat="observed" notes a false positive wherever the words stand apart, even
    where the biword index has no match.
    """
    flag = lambda df, name: df.select("doc_id", F.lit(True).alias(name))
    out = (
        docs.select("doc_id")
        .distinct()
        .join(flag(query_biword(query, biwords), "bw"), "doc_id", "left")
        .join(flag(query_positional(query, positions), "ps"), "doc_id", "left")
        .join(flag(false_positives(query, positions), "fp"), "doc_id", "left")
        .na.fill(False, ["bw", "ps", "fp"])
    )
    wrong = F.col("fp") if compat == "observed" else F.col("fp") & F.col("bw")
    note = (
        F.when(wrong, NOTES["false"])
        .when(F.col("bw") & F.col("ps"), NOTES["both"])
        .when(F.col("ps"), NOTES["positional"])
        .when(F.col("bw"), NOTES["biword"])
        .otherwise(NOTES["none"])
    )
    mark = lambda c: F.when(F.col(c), "✅").otherwise("❌")
    return out.select(F.col("doc_id").alias("Document"), mark("bw").alias("Biword Match"), mark("ps").alias("Positional Match"), note.alias("Note")).orderBy("Document")


def false_positive_demo(spark) -> dict[str, DataFrame]:
    """The two-document demonstration: documents, and the biword, positional, candidate and false-positive documents of its phrase."""
    from .index import build_biword_index, build_positions

    # fixed values: the texts of the demonstration
    docs = spark.createDataFrame(
        [
            ("demo_doc1", "information systems are used for retrieval of data. retrieval information is key in modern search."),
            ("demo_doc2", "information retrieval is the core of any search engine."),
        ],
        "doc_id string, text string",
    )
    query, bw, ps = "information retrieval", build_biword_index(docs), build_positions(docs)
    return {
        "documents": docs, "biword": query_biword(query, bw), "positional": query_positional(query, ps), "candidates": phrase_candidates(query, ps), "false_positives": false_positives(query, ps),
    }


def account(query: str, biwords: DataFrame, positions: DataFrame) -> DataFrame:
    """What a phrase's answer rests on: kind (biword or term), item, place (of its first mention), n_docs of its postings and missing, whether no document has it."""
    asked = [("biword", b) for b in dict.fromkeys(query_biwords(query))] + [("term", w) for w in dict.fromkeys(query_words(query))]
    spark = biwords.sparkSession
    listed = spark.createDataFrame([(kind, item, i) for i, (kind, item) in enumerate(asked)], "kind string, item string, place int")
    own = postings(query, biwords, positions).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_docs"))
    joined = listed.join(F.broadcast(own), ["kind", "item"], "left")  # a row an item of the query
    return joined.select("kind", "item", "place", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.col("n_docs").isNull().alias("missing"))


def postings(query: str, biwords: DataFrame, positions: DataFrame) -> DataFrame:
    """kind (biword or term), item and doc_id: the postings of each biword and word of a phrase."""
    pairs = biwords.where(F.col("biword").isin(query_biwords(query))).select(F.lit("biword").alias("kind"), F.col("biword").alias("item"), "doc_id")
    words = positions.where(F.col("term").isin(query_words(query))).select(F.lit("term").alias("kind"), F.col("term").alias("item"), "doc_id")
    return pairs.union(words).distinct()


def timed(answer: DataFrame) -> tuple[DataFrame, float]:
    """A query's answer and the milliseconds (3 places) that making all its rows once took."""
    began = time.perf_counter()
    answer.write.format("noop").mode("overwrite").save()
    return answer, round((time.perf_counter() - began) * 1000, 3)


def describe(query: str) -> dict:
    """The driver-side account of a phrase: its words and biwords."""
    return {"query": query, "query_tokens": query_words(query), "biwords": query_biwords(query)}
