"""Index builders and their display tables.

Documents are (doc_id, text) and, where insertion order shows, doc_ord. Null texts are
empty documents. Repeated rows of a document add to its term frequencies, as one
longer document would. Further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.phonetic import phonetic_code
from .preprocess import PreprocessConfig, exploded, final_tokens, phrase_tokens, unnested

DEFAULT = PreprocessConfig()


def _listed(column: Column, by: str = ", ") -> Column:
    return F.array_join(column, by)


# inverted index, as sets


def build_inverted_set(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """Distinct (term, doc_id)."""
    return exploded(final_tokens(docs, cfg)).select(F.col("token").alias("term"), "doc_id").distinct()


def index_to_df(pairs: DataFrame, key: str = "term", name: str = "Term") -> DataFrame:
    """One row a term, sorted: its document frequency and its documents, sorted and joined. For display: a term's whole list is one value; lists in blocks are ``heavy_keys.posting_blocks``."""
    return (
        pairs.groupBy(F.col(key).alias(name))
        .agg(F.count(F.lit(1)).alias("Doc Frequency"), F.sort_array(F.collect_list("doc_id")).alias("docs"))
        .select(name, "Doc Frequency", _listed(F.col("docs").cast("array<string>")).alias("Posting List"))
        .orderBy(name)
    )


# inverted index, with term frequencies


def build_inverted_index(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """term, doc_id and tf. Partial counts are made before the only exchange."""
    return exploded(final_tokens(docs, cfg)).groupBy(F.col("token").alias("term"), "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def build_doc_lengths(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """doc_id and n, the number of final tokens; 0 for empty documents."""
    return final_tokens(docs, cfg).select("doc_id", F.size("final_tokens").cast("bigint").alias("n"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """term, df and cf."""
    return postings.groupBy("term").agg(_present().alias("df"), F.sum("tf").alias("cf"))


def _present() -> Column:
    """The number of postings. It reads tf, so that postings made on the spot are the same subplan here as elsewhere and their exchange is used again."""
    return F.count_if(F.col("tf") > 0)


def compute_tfidf(postings: DataFrame, n_docs: int | DataFrame) -> DataFrame:
    """term, doc_id, tf, df, idf = ln(N/df) and tfidf = tf * idf rounded to 6 places; 0 where every document has the term.

    Document frequencies are counted first and joined, so that a term in every
    document moves no more than its postings. ``n_docs``: N, or a one-row frame of it.
    """
    df = postings.groupBy("term").agg(_present().alias("df"))
    if isinstance(n_docs, int):
        df = df.withColumn("n_docs", F.lit(n_docs))
    else:
        df = df.withColumn("n_docs", n_docs.scalar())
    df = df.withColumn("idf", F.log(F.col("n_docs") / F.col("df"))).drop("n_docs")
    return postings.join(df, "term").withColumn("tfidf", F.round(F.col("tf") * F.col("idf"), 6))


def count_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def first_seen(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """term, df and first, the place of its first occurrence in insertion order (doc_ord, or doc_id where there is none)."""
    order = "doc_ord" if "doc_ord" in docs.columns else "doc_id"
    if order == "doc_id":
        docs = docs.select("doc_id", "text", F.col("doc_id").alias("doc_ord"))
    tokens = unnested(final_tokens(docs, cfg), F.col("final_tokens"), "pos", "term", "doc_id", "doc_ord")
    return (
        tokens.groupBy("term", "doc_id")
        .agg(F.min(F.col("doc_ord").cast("bigint") * (1 << 32) + F.col("pos")).alias("first"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.min("first").alias("first"))
    )


def index_statistics(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """One row: vocab_size, total_postings, avg_df (2 places, 0 if empty), max_df_term (the first inserted of ties), min_df_term (the last), singleton_terms, doc_count."""
    rank_first = F.struct("df", -F.col("first"))
    stats = first_seen(docs, cfg).agg(
        F.count(F.lit(1)).alias("vocab_size"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"),
        F.coalesce(F.round(F.avg("df"), 2), F.lit(0.0)).alias("avg_df"),
        F.max_by("term", rank_first).alias("max_df_term"),
        F.min_by("term", rank_first).alias("min_df_term"),
        F.count_if(F.col("df") == 1).alias("singleton_terms"),
    )
    return stats.withColumn("doc_count", docs.agg(F.count(F.lit(1))).scalar())


def top_terms(docs: DataFrame, cfg: PreprocessConfig = DEFAULT, n: int = 10) -> DataFrame:
    """The ``n`` terms of most documents, ties by first insertion."""
    return first_seen(docs, cfg).orderBy(F.desc("df"), "first").limit(n).select("term", "df")


def singleton_terms(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """Terms of a single document."""
    return build_inverted_index(docs, cfg).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df = 1").select("term")


def stats_to_dataframe(stats: DataFrame) -> DataFrame:
    """Metric and Value of the statistics, seven rows in a fixed order."""
    # fixed values: the names of the metrics
    named = (
        ("Vocabulary Size", "vocab_size"), ("Total Postings", "total_postings"), ("Document Count", "doc_count"), ("Average Document Frequency", "avg_df"),
        ("Max DF Term", "max_df_term"), ("Min DF Term", "min_df_term"), ("Singleton Terms", "singleton_terms"),
    )
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(m).alias("Metric"), F.col(c).cast("string").alias("Value")) for i, (m, c) in enumerate(named)))
    return stats.select(F.explode(rows).alias("r")).select("r.*").orderBy("ord").select("Metric", "Value")


def index_to_dataframe(postings: DataFrame) -> DataFrame:
    """One row a term, sorted: document frequency, collection frequency and its postings as doc(tf). For display, as ``index_to_df``."""
    entry = lambda p: F.concat(p["doc_id"].cast("string"), F.lit("("), p["tf"].cast("string"), F.lit(")"))
    return (
        postings.groupBy(F.col("term").alias("Term"))
        .agg(F.count(F.lit(1)).alias("Document Frequency"), F.sum("tf").alias("Term Frequency"), F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
        .select("Term", "Document Frequency", "Term Frequency", _listed(F.transform("p", entry)).alias("Posting List"))
        .orderBy("Term")
    )


# phrase indexes


def build_biword_index(docs: DataFrame) -> DataFrame:
    """Distinct (biword, doc_id) of adjacent words; documents of one word have none."""
    t = F.col("tokens")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)))
    return unnested(phrase_tokens(docs), F.when(F.size(t) >= 2, pairs), None, "biword", "doc_id").select("biword", "doc_id").distinct()


def biwords_index_to_dataframe(biwords: DataFrame) -> DataFrame:
    return index_to_df(biwords, "biword", "Biwords").withColumnRenamed("Doc Frequency", "Document Frequency")


def build_positions(docs: DataFrame) -> DataFrame:
    """The positional index in long form: term, doc_id, pos (from 0)."""
    return unnested(phrase_tokens(docs), F.col("tokens"), "pos", "term", "doc_id").select("term", "doc_id", "pos")


def build_positional_index(docs: DataFrame) -> DataFrame:
    """term, doc_id and positions, ascending."""
    return build_positions(docs).groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def positional_index_to_dataframe(positional: DataFrame) -> DataFrame:
    """Term, Document, Positions as a printed list and "Document frequency", which is the term's frequency within the document; sorted."""
    return positional.select(
        F.col("term").alias("Term"),
        F.col("doc_id").alias("Document"),
        F.concat(F.lit("["), _listed(F.col("positions").cast("array<string>")), F.lit("]")).alias("Positions"),
        F.size("positions").cast("bigint").alias("Document frequency"),
    ).orderBy("Term", "Document")


# vocabulary, k-grams, phonetic codes


def extract_vocabulary(docs: DataFrame, cfg: PreprocessConfig = DEFAULT) -> DataFrame:
    """The sorted distinct final tokens: term."""
    return exploded(final_tokens(docs, cfg)).select(F.col("token").alias("term")).distinct().orderBy("term")


def build_kgram_index(vocabulary: DataFrame, k: int = 3) -> DataFrame:
    """Distinct (kgram, term)."""
    return unnested(vocabulary, T.get_kgrams(F.col("term"), k), None, "kgram", "term").select("kgram", "term").distinct()


def kgram_index_to_dataframe(vocabulary: DataFrame, k: int = 3, top_n: int = 50) -> DataFrame:
    """The ``top_n`` k-grams of most terms, ties by first appearance over the sorted vocabulary, each with its first ten terms."""
    grams = unnested(vocabulary, T.get_kgrams(F.col("term"), k), "i", "kgram", "term").groupBy("kgram", "term").agg(F.min("i").alias("i"))
    top = grams.groupBy("kgram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("term", "i")).alias("first")).orderBy(F.desc("n"), "first").limit(top_n)
    first_ten = (
        grams.join(F.broadcast(top.select("kgram")), "kgram")  # at most top_n rows
        .withColumn("rank", F.row_number().over(W.partitionBy("kgram").orderBy("term")))
        .where("rank <= 10")
        .groupBy("kgram")
        .agg(F.sort_array(F.collect_list("term")).alias("terms"))
    )
    return (
        top.join(first_ten, "kgram")
        .orderBy(F.desc("n"), "first")
        .select(F.col("kgram").alias("K-gram"), F.col("n").alias("Terms"), _listed(F.col("terms")).alias("Vocabulary"))
    )


def build_phonetic_index(vocabulary: DataFrame, method: str = "soundex") -> DataFrame:
    """method, code, term; any method but ``soundex`` means Metaphone. Terms without a code are left out."""
    coded = vocabulary.select(F.lit(method).alias("method"), phonetic_code(F.col("term"), method).alias("code"), "term")
    return coded.where("code is not null and code <> ''")


def phonetic_index_to_dataframe(phonetic: DataFrame, top_n: int = 30) -> DataFrame:
    """The ``top_n`` codes that more than one term shares, by number of terms, ties by least term."""
    top = phonetic.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first")).where("n > 1").orderBy(F.desc("n"), "first").limit(top_n)
    # terms are gathered for the codes of the table only
    terms = phonetic.join(F.broadcast(top.select("code")), "code").groupBy("code").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return top.join(terms, "code").orderBy(F.desc("n"), "first").select(F.col("code").alias("Code"), F.col("n").alias("Terms"), _listed(F.col("terms")).alias("Vocabulary"))


# previews


def collection_preview(docs: DataFrame, width: int = 120) -> DataFrame:
    """doc_id, words, chars and the first ``width`` characters on one line, with … where there are more."""
    t = F.coalesce("text", F.lit(""))
    start = F.translate(F.substring(t, 1, width), "\n", " ")
    return docs.select(
        "doc_id",
        F.size(T.blank_words(F.col("text"))).cast("bigint").alias("words"),
        F.length(t).cast("bigint").alias("chars"),
        F.when(F.length(t) > width, F.concat(start, F.lit("…"))).otherwise(start).alias("preview"),
    )


def collection_totals(docs: DataFrame) -> DataFrame:
    """One row: documents and words of the collection."""
    return collection_preview(docs).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def majority(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value of a column, ties by value, with its count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)
