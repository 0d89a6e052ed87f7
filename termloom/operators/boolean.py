"""Boolean retrieval: one scan of the postings of the query's terms and one exchange, whatever the query.

Postings are (term, doc_id); documents without tokens count for NOT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import porter, snowball
from ..plans.boolean import BooleanQuery, needs_all, parse, tokenize
from .preprocess import PreprocessConfig


def docs_for_term(term: str, postings: DataFrame) -> DataFrame:
    """The documents of a term: doc_id."""
    return postings.where(F.col("term") == term).select("doc_id").distinct()


def _none(postings: DataFrame) -> DataFrame:
    return postings.select("doc_id").where(F.lit(False))


def boolean_and(terms: list[str], postings: DataFrame) -> DataFrame:
    """Documents of all the terms; none for no terms."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return _none(postings)
    found = postings.where(F.col("term").isin(terms)).select("term", "doc_id").distinct()
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("doc_id")


def boolean_or(terms: list[str], postings: DataFrame) -> DataFrame:
    """Documents of any of the terms."""
    return postings.where(F.col("term").isin(list(terms))).select("doc_id").distinct()


def boolean_not(term: str, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents but those of the term."""
    return docs.select("doc_id").distinct().join(docs_for_term(term, postings), "doc_id", "left_anti")


def and_by_sets(terms: list[str], postings: DataFrame) -> DataFrame:
    """``boolean_and`` as a chain of intersections."""
    return reduce(lambda a, b: a.intersect(b), (docs_for_term(t, postings) for t in terms)) if terms else _none(postings)


def or_by_sets(terms: list[str], postings: DataFrame) -> DataFrame:
    """``boolean_or`` as a union."""
    return reduce(lambda a, b: a.union(b), (docs_for_term(t, postings) for t in terms)).distinct() if terms else _none(postings)


def not_by_sets(term: str, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """``boolean_not`` as a difference."""
    return docs.select("doc_id").exceptAll(docs_for_term(term, postings)).distinct()


def boolean_query(query: str | BooleanQuery, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id of the documents that satisfy a query; none for empty and invalid ones."""
    q = parse(query) if isinstance(query, str) else query
    if q.tree is None:
        return docs.select("doc_id").where(F.lit(False))
    found = postings.where(F.col("term").isin(list(q.terms)))
    flags = [F.coalesce(F.bool_or(F.col("term") == t), F.lit(False)).alias(f"t{i}") for i, t in enumerate(q.terms)]
    marked = found.groupBy("doc_id").agg(*flags)
    if needs_all(q.tree):  # a document without any term may satisfy it
        marked = docs.select("doc_id").distinct().join(marked, "doc_id", "left").na.fill(False, [f"t{i}" for i in range(len(q.terms))])
    return marked.where(q.tree.column({t: F.col(f"t{i}") for i, t in enumerate(q.terms)})).select("doc_id")


def normalized(query: str, cfg: PreprocessConfig) -> str:
    """The query with its terms stemmed as the index's were; for indexes built with stems."""
    stem = porter if cfg.stemmer == "porter" else snowball
    q = parse(query)
    if not cfg.do_stem or q.tree is None:
        return query
    return " ".join(stem(t) if t in q.terms else t for t in tokenize(query))


def describe(query: str) -> dict:
    """The driver-side account of a query: query, operator, terms, error and steps."""
    q = parse(query)
    return {"query": q.query, "operator": q.operator, "terms": list(q.terms), "error": q.error, "steps": list(q.steps)}
