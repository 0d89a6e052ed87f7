"""TF-IDF cosine similarity, and the comparison of stemming with lemmatization by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .preprocess import PreprocessConfig, final_tokens, unnested

#: Fixed value, a pattern: what counts as a word of the vector space, in lower-cased text.
VECTOR_WORD = r"[\p{L}\p{N}_]{2,}"


def vector_terms(docs: DataFrame, cfg: PreprocessConfig, lexicon: DataFrame | None = None) -> DataFrame:
    """doc_id, term and tf of the vector space: words of two characters or more of the joined final tokens."""
    joined = F.lower(F.array_join("final_tokens", " "))
    words = unnested(final_tokens(docs, cfg, lexicon), F.regexp_extract_all(joined, F.lit(VECTOR_WORD), F.lit(0)), None, "term", "doc_id")
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def weights(terms: DataFrame, n_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, w), each document of length one, and (term, idf), with idf = ln((1 + N) / (1 + df)) + 1."""
    idf = (
        terms.groupBy("term")
        .agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that the terms are made once for both uses
        .select("term", (F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    raw = terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("w")), idf


def cosine(docs: DataFrame, queries: DataFrame, cfg: PreprocessConfig = PreprocessConfig(), lexicon: DataFrame | None = None) -> DataFrame:
    """query, doc_id and sim of every query and document with a word in common; queries (query) are a small relation.

    Query words outside the collection's vocabulary count nothing.
    """
    of_docs, idf = weights(vector_terms(docs, cfg, lexicon), docs.agg(F.count(F.lit(1)).alias("n_docs")))
    asked = vector_terms(queries.select(F.col("query").alias("doc_id"), F.col("query").alias("text")), cfg, lexicon).withColumnRenamed("doc_id", "query")
    wq = asked.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = wq.groupBy("query").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    wq = wq.join(norm, "query").select("query", "term", (F.col("w") / F.col("norm")).alias("wq"))
    return of_docs.join(wq, "term").groupBy("query", "doc_id").agg(F.sum(F.col("w") * F.col("wq")).alias("sim"))


def _summary(sims: DataFrame, name: str) -> DataFrame:
    some = F.col("sim") > 0
    return sims.groupBy("query").agg(F.count_if(some).alias(f"{name} matches"), F.round(F.avg(F.when(some, F.col("sim"))), 4).alias(f"{name} Avg. Similarity"))


def compare_stem_vs_lemma(docs: DataFrame, queries: DataFrame, lexicon: DataFrame | None = None, stemmer: str = "porter") -> DataFrame:
    """One row a query: matches and average similarity of the matching documents with stems and with lemmas, and which is better, else Tie. An empty collection gives Ties of 0."""
    stem = _summary(cosine(docs, queries, PreprocessConfig(do_stem=True, stemmer=stemmer)), "Stem")
    lemma = _summary(cosine(docs, queries, PreprocessConfig(do_lemma=True), lexicon), "Lemma")
    out = queries.select("query").distinct().join(stem, "query", "left").join(lemma, "query", "left").na.fill(0)
    s, m = F.col("`Stem Avg. Similarity`"), F.col("`Lemma Avg. Similarity`")
    return out.select(
        F.col("query").alias("Query"), "Stem matches", "Lemma matches", s, m, F.when(s > m, "Stemming").when(m > s, "Lemmatization").otherwise("Tie").alias("Better")
    ).orderBy("Query")
