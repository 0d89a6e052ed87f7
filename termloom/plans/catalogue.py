"""The catalogue of queries: name to function of (session, data directory).

Queries without a word of their own run over the whole ``documents`` table; the words,
phrases and patterns they ask for are given once, below, and used by the SQL too.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import edit_distance, indel_ratio
from ..operators import boolean, compare, dictionary, heavy_keys, index, lemmas, phrase, spelling, tolerant, wildcard
from ..operators.collection import Collection
from ..operators.preprocess import PreprocessConfig, changed_map, exploded, final_tokens, preprocess, stem_tokens, timed_preprocess
from ..session import scratch, spread, stored, table
from ..sources import documents as sources
from ..sources import index_store
from ..streaming import postings as stream

Query = Callable[[SparkSession, str], DataFrame]

BOOLEAN = {
    "bool_and": "query AND posting",
    "bool_or": "vaccine OR verdict",
    "bool_not": "NOT the",
    "bool_nested": "(vaccine OR query) AND NOT (index OR ward)",
    "bool_implicit_and": "query index NOT posting",
    "bool_precedence": "vaccine OR query AND posting",
    "bool_double_not": "NOT NOT vaccine",
    "bool_invalid": "(query AND",
    "bool_empty": "  ",
}
PHRASES = {"phrase_biword": "mean average precision", "phrase_positional": "posting list", "phrase_single": "vaccine", "phrase_long": "the team of"}
WILDCARDS = {"wildcard_prefix": "vacc*", "wildcard_suffix": "*tion", "wildcard_infix": "*stem*", "wildcard_middle": "qu*y", "wildcard_short": "s*m", "wildcard_multi": "re*i*al"}
KEYS = ["query", "vaccine", "zzz", "aaa", "kgram"]
RANGE, PREFIX = ("inf", "inz"), "post"
MISSPELLED = ["vacine", "qurey", "retreival", "vaccine", "precison", "xqzwv"]
COSINE = ["boolean query posting list", "vaccine trial", "court verdict zzzz"]
TFIDF_DIGITS = 6
P1_BLOCK = heavy_keys.BLOCK_DOCS


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return index.build_inverted_index(docs(spark, d))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return exploded(final_tokens(docs(spark, d))).select(F.col("token").alias("term")).distinct()


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return index.build_positions(docs(spark, d))


def _biwords(spark: SparkSession, d: str) -> DataFrame:
    return index.build_biword_index(docs(spark, d))


def _stage(column: str, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return exploded(preprocess(docs(spark, d), PreprocessConfig(**options)), column)

    run.__doc__ = f"The tokens of the stage {column} of the preprocessing pipeline, with their positions."
    return run


def _boolean(query: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return boolean.boolean_query(query, _postings(spark, d), docs(spark, d))

    run.__doc__ = f"Documents of the boolean query {query!r}."
    return run


def bool_setops(spark: SparkSession, d: str) -> DataFrame:
    """(query AND posting) or not the, by intersect, union and except."""
    p = _postings(spark, d)
    return boolean.and_by_sets(["query", "posting"], p).union(boolean.not_by_sets("list", p, docs(spark, d))).distinct()


def bool_terms_and(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all of three terms."""
    return boolean.boolean_and(["query", "posting", "list"], _postings(spark, d))


def bool_terms_or(spark: SparkSession, d: str) -> DataFrame:
    """Documents of any of three terms."""
    return boolean.boolean_or(["query", "posting", "list"], _postings(spark, d))


# preprocessing


def timed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Final tokens of the timed pipeline."""
    return exploded(timed_preprocess(docs(spark, d))[0])


def tok_treebank(spark: SparkSession, d: str) -> DataFrame:
    """Final tokens by the Treebank-like tokenizer."""
    return _stage("final_tokens", tokenizer="treebank")(spark, d)


def stem_porter(spark: SparkSession, d: str) -> DataFrame:
    """The Porter stem of every term of the vocabulary."""
    return _vocabulary(spark, d).select("term", stem_tokens(F.array("term"))[0].alias("stem"))


def stem_snowball(spark: SparkSession, d: str) -> DataFrame:
    """The stem of every term by the second algorithm."""
    return _vocabulary(spark, d).select("term", stem_tokens(F.array("term"), "snowball")[0].alias("stem"))


def stem_map(spark: SparkSession, d: str) -> DataFrame:
    """Each document's changed tokens with their stems."""
    out = final_tokens(docs(spark, d)).withColumn("stems", stem_tokens(F.col("final_tokens")))
    return out.select("doc_id", F.explode(changed_map(F.col("final_tokens"), F.col("stems"))).alias("token", "stem"))


def lemma(spark: SparkSession, d: str) -> DataFrame:
    """The lemma of every term that has another, as a noun else as a verb."""
    return lemmas.lemma_or_verb(_vocabulary(spark, d).withColumnRenamed("term", "token"))


def lemma_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Final tokens, lemmatized and then stemmed."""
    return exploded(final_tokens(docs(spark, d), PreprocessConfig(do_lemma=True, do_stem=True)))


def lemma_final(spark: SparkSession, d: str) -> DataFrame:
    """Final tokens, lemmatized."""
    return exploded(final_tokens(docs(spark, d), PreprocessConfig(do_lemma=True)))


# indexes and their tables


def doc_preview(spark: SparkSession, d: str) -> DataFrame:
    """Words, characters and beginning of every document."""
    return index.collection_preview(docs(spark, d))


def collection_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of the collection."""
    return index.collection_totals(docs(spark, d))


def majority_language(spark: SparkSession, d: str) -> DataFrame:
    """The commonest language of the collection."""
    return index.majority(table(spark, d, "documents"), "lang")


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Final tokens of every document."""
    return index.build_doc_lengths(docs(spark, d))


def inv_set(spark: SparkSession, d: str) -> DataFrame:
    """The set-valued inverted index."""
    return index.build_inverted_set(docs(spark, d))


def inv_set_table(spark: SparkSession, d: str) -> DataFrame:
    """Its display table."""
    return index.index_to_df(index.build_inverted_set(docs(spark, d)))


def inv_tf_postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index with term frequencies."""
    return _postings(spark, d)


def inv_tf_table(spark: SparkSession, d: str) -> DataFrame:
    """Its display table."""
    return index.index_to_dataframe(_postings(spark, d))


def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every term."""
    return index.document_frequencies(_postings(spark, d))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF weights of the whole index."""
    weighted = index.compute_tfidf(_postings(spark, d), index.count_docs(docs(spark, d)))
    return weighted.withColumn("idf", F.round("idf", TFIDF_DIGITS))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the inverted index."""
    return index.index_statistics(docs(spark, d))


def index_stats_table(spark: SparkSession, d: str) -> DataFrame:
    """Their display table."""
    return index.stats_to_dataframe(index.index_statistics(docs(spark, d)))


def top10_df(spark: SparkSession, d: str) -> DataFrame:
    """The ten terms of most documents."""
    return index.top_terms(docs(spark, d))


def singleton_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of one document."""
    return index.singleton_terms(docs(spark, d))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    """The sorted vocabulary."""
    return index.extract_vocabulary(docs(spark, d))


def biword_index(spark: SparkSession, d: str) -> DataFrame:
    """The biword index."""
    return _biwords(spark, d)


def biword_table(spark: SparkSession, d: str) -> DataFrame:
    """Its display table."""
    return index.biwords_index_to_dataframe(_biwords(spark, d))


def positional_index(spark: SparkSession, d: str) -> DataFrame:
    """The positional index, positions joined by commas."""
    return index.build_positional_index(docs(spark, d)).select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def positional_table(spark: SparkSession, d: str) -> DataFrame:
    """Its display table."""
    return index.positional_index_to_dataframe(index.build_positional_index(docs(spark, d)))


# phrases


def _biword_query(spark: SparkSession, d: str) -> DataFrame:
    return phrase.query_biword(PHRASES["phrase_biword"], _biwords(spark, d))


def _positional_query(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return phrase.query_positional(PHRASES[name], _positions(spark, d))

    run.__doc__ = f"Documents with the phrase {PHRASES[name]!r} and its first place."
    return run


def phrase_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all words of a phrase."""
    return phrase.phrase_candidates(PHRASES["phrase_biword"], _positions(spark, d))


def phrase_false_positives(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without the phrase."""
    return phrase.false_positives(PHRASES["phrase_long"], _positions(spark, d))


def phrase_starts(spark: SparkSession, d: str) -> DataFrame:
    """Every place of a phrase."""
    return phrase.phrase_starts(PHRASES["phrase_long"], _positions(spark, d))


def phrase_compare(spark: SparkSession, d: str) -> DataFrame:
    """Both indexes' answers to a phrase, side by side."""
    return phrase.compare_indexes(PHRASES["phrase_biword"], docs(spark, d), _biwords(spark, d), _positions(spark, d))


def phrase_compare_observed(spark: SparkSession, d: str) -> DataFrame:
    """The same with the notes of compat="observed"."""
    return phrase.compare_indexes(PHRASES["phrase_biword"], docs(spark, d), _biwords(spark, d), _positions(spark, d), "observed")


def phrase_demo(spark: SparkSession, d: str) -> DataFrame:
    """The two-document demonstration: the documents of each kind of answer."""
    parts = [found.select(F.lit(kind).alias("kind"), "doc_id") for kind, found in phrase.false_positive_demo(spark).items()]
    return functools.reduce(DataFrame.union, parts)


def phrase_account(spark: SparkSession, d: str) -> DataFrame:
    """Each word and biword of a phrase with the number of its documents, and whether any document has it."""
    asked = PHRASES["phrase_biword"] + " zzz"
    return phrase.account(asked, _biwords(spark, d), _positions(spark, d))


# dictionary


def dict_inorder(spark: SparkSession, d: str) -> DataFrame:
    """All terms in order."""
    return dictionary.inorder(_vocabulary(spark, d))


def dict_search_rank(spark: SparkSession, d: str) -> DataFrame:
    """Whether keys are there, and their ranks."""
    return dictionary.sorted_search(_vocabulary(spark, d), KEYS)


def dict_range(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a range."""
    return dictionary.range_query(_vocabulary(spark, d), *RANGE)


def dict_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a prefix."""
    return dictionary.prefix_search(_vocabulary(spark, d), PREFIX)


def dict_prefix_observed(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a prefix with compat="observed"."""
    return dictionary.prefix_search(_vocabulary(spark, d), PREFIX, "observed")


def dict_bst_search(spark: SparkSession, d: str) -> DataFrame:
    """Whether keys are in the search tree, and the nodes visited."""
    return dictionary.bst_search(_vocabulary(spark, d), KEYS)


def dict_update(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary after an insertion and a deletion."""
    return dictionary.delete(dictionary.bst_insert(_vocabulary(spark, d), "zzz"), "vaccine")


def dict_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of both dictionaries."""
    return dictionary.tree_stats(_vocabulary(spark, d))


def dict_depths(spark: SparkSession, d: str) -> DataFrame:
    """Depth of every key in the search tree."""
    return dictionary.bst_depths(_vocabulary(spark, d))


def dict_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Both searches of some keys, timed; without the times, which differ from run to run."""
    timed = dictionary.benchmark(_vocabulary(spark, d), KEYS, n_repeats=2)
    return spark.createDataFrame(timed[["Query", "Found (BST)", "BST Steps", "Found (B-Tree)"]])


# k-grams and wildcards


def kgram_index(spark: SparkSession, d: str) -> DataFrame:
    """The k-gram index."""
    return index.build_kgram_index(_vocabulary(spark, d))


def kgram_top(spark: SparkSession, d: str) -> DataFrame:
    """The k-grams of most terms."""
    return index.kgram_index_to_dataframe(_vocabulary(spark, d))


def _wildcard(pattern: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = _vocabulary(spark, d)
        return wildcard.query_wildcard(pattern, index.build_kgram_index(v), v)

    run.__doc__ = f"Terms that match {pattern!r}."
    return run


def wildcard_observed(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a wildcard with compat="observed": none for patterns of longer parts."""
    v = _vocabulary(spark, d)
    return wildcard.query_wildcard(WILDCARDS["wildcard_prefix"], index.build_kgram_index(v), v, compat="observed")


def wildcard_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a wildcard's terms."""
    v = _vocabulary(spark, d)
    return wildcard.documents_of(wildcard.query_wildcard(WILDCARDS["wildcard_prefix"], index.build_kgram_index(v), v), _postings(spark, d))


# spelling and sound


def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each term to a misspelling."""
    return _vocabulary(spark, d).select("term", edit_distance(F.col("term"), F.lit(MISSPELLED[0])).cast("bigint").alias("distance"))


def indel_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of each term to a misspelling."""
    return _vocabulary(spark, d).select("term", indel_ratio(F.col("term"), F.lit(MISSPELLED[0])).alias("score"))


def spell_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for misspelled words."""
    return spelling.suggestions(MISSPELLED, _vocabulary(spark, d))


def spell_best(spark: SparkSession, d: str) -> DataFrame:
    """The best match of each misspelled word."""
    return spelling.best_matches(MISSPELLED, _vocabulary(spark, d))


def spell_table(spark: SparkSession, d: str) -> DataFrame:
    """The display table of one word's suggestions."""
    return spelling.correction_table(MISSPELLED[0], _vocabulary(spark, d))


def soundex_codes(spark: SparkSession, d: str) -> DataFrame:
    """Soundex code of every term."""
    return spelling.coded(_vocabulary(spark, d))


def metaphone_codes(spark: SparkSession, d: str) -> DataFrame:
    """Metaphone code of every term."""
    return spelling.coded(_vocabulary(spark, d), "metaphone")


def soundex_groups(spark: SparkSession, d: str) -> DataFrame:
    """The largest groups of terms of one Soundex code."""
    return index.phonetic_index_to_dataframe(index.build_phonetic_index(_vocabulary(spark, d)))


def metaphone_groups(spark: SparkSession, d: str) -> DataFrame:
    """The largest groups of terms of one Metaphone code."""
    return index.phonetic_index_to_dataframe(index.build_phonetic_index(_vocabulary(spark, d), "metaphone"))


def phonetic_index(spark: SparkSession, d: str) -> DataFrame:
    """The phonetic index by Soundex."""
    return index.build_phonetic_index(_vocabulary(spark, d))


def phonetic_match_soundex(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the Soundex code of a misspelled word."""
    return spelling.phonetic_matches(MISSPELLED[0], index.build_phonetic_index(_vocabulary(spark, d)))


def phonetic_match(spark: SparkSession, d: str) -> DataFrame:
    """Terms that sound like a misspelled word, by both methods."""
    v = _vocabulary(spark, d)
    return spelling.phonetic_matches(MISSPELLED[0], index.build_phonetic_index(v)).union(spelling.phonetic_matches(MISSPELLED[0], index.build_phonetic_index(v, "metaphone"), "metaphone"))


def _tolerant(query: str, what: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = stored(_postings(spark, d), "postings")  # an index is made once and asked often
        v = p.select("term").distinct()
        found = tolerant.tolerant_search(query, p, v, index.build_kgram_index(v), index.build_phonetic_index(v), index.build_phonetic_index(v, "metaphone"))
        if what == "spelled":  # all but what Metaphone adds
            return found.terms.where("via <> 'metaphone'")
        return found.docs if what == "docs" else found.terms

    run.__doc__ = f"The {what} of tolerant search for {query!r}."
    return run


# similarity


def cosine_rank(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of queries and documents."""
    asked = spark.createDataFrame([(q,) for q in COSINE], "query string")
    return compare.cosine(docs(spark, d), asked).withColumn("sim", F.round("sim", TFIDF_DIGITS))


def compare_stem_lemma(spark: SparkSession, d: str) -> DataFrame:
    """Stemming and lemmatization compared."""
    return compare.compare_stem_vs_lemma(docs(spark, d), spark.createDataFrame([(q,) for q in COSINE], "query string"))


# sources, sinks and streams


def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The documents with those of another collection put in."""
    old = table(spark, d, "doc_collection").select("doc_id", "text").distinct()
    return sources.upsert(old, docs(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")))


def source_csv(spark: SparkSession, d: str) -> DataFrame:
    """The documents, written as CSV and read again; null texts come back as empty ones."""
    path = scratch(spark, "csv")
    docs(spark, d).withColumn("text", F.coalesce("text", F.lit(""))).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return sources.read_rows(spark, path, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def sample_preview(spark: SparkSession, d: str) -> DataFrame:
    """Words and characters of the sample documents."""
    return index.collection_preview(sources.sample_documents(spark)).drop("preview")


def collection_answers(spark: SparkSession, d: str) -> DataFrame:
    """One collection, asked a boolean, a phrase, a wildcard and an exact query."""
    c = Collection(docs(spark, d))
    found = {
        "boolean": c.boolean(BOOLEAN["bool_nested"]),
        "phrase": c.phrase(PHRASES["phrase_positional"]),
        "wildcard": wildcard.documents_of(c.wildcard(WILDCARDS["wildcard_prefix"]), c.postings),
        "exact": c.tolerant("vaccine").docs,
    }
    out = stored(functools.reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), "doc_id") for kind, df in found.items()]), "answers")
    c.clear()
    return out


def store_json_object(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, written as one JSON object and read again."""
    path = scratch(spark, "json")
    index_store.export_json(_postings(spark, d), path, whole=True)
    return index_store.import_json(spark, path, whole=True).select("term", F.col("doc_id").cast("bigint").alias("doc_id"), "tf")


def store_parquet(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, written and read again."""
    path = scratch(spark, "index")
    index_store.save_index(_postings(spark, d), path)
    return index_store.load_index(spark, path)


def stored_boolean(spark: SparkSession, d: str) -> DataFrame:
    """A boolean query asked of a stored index, of which only the row groups of its terms are read."""
    path = scratch(spark, "index")
    index_store.save_index(_postings(spark, d), path)
    return boolean.boolean_query(BOOLEAN["bool_implicit_and"], index_store.load_index(spark, path), docs(spark, d))


def stored_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase asked of a stored positional index."""
    path = scratch(spark, "positions")
    index_store.save_index(_positions(spark, d), path)
    return phrase.query_positional(PHRASES["phrase_positional"], index_store.load_index(spark, path))


def store_json(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, written as JSON and read again."""
    path = scratch(spark, "json")
    index_store.export_json(_postings(spark, d), path)
    return index_store.import_json(spark, path).select("term", F.col("doc_id").cast("bigint").alias("doc_id"), "tf")


def stream_postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, built from the documents as a stream."""
    path = scratch(spark, "stream")
    source = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    stream.start(source.select("doc_id", "text"), f"{path}/postings", f"{path}/checkpoint").awaitTermination()
    return stream.read(spark, f"{path}/postings")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event types in hourly windows, counted over the events as a stream."""
    path = scratch(spark, "windows")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    # event time must be an instant; times without a zone are taken in the session's, there and back
    stream.start_windows(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", path).awaitTermination()
    return stream.read_windows(spark, path).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# heavy keys (problem 1)


def _indexes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "positional_index"), table(spark, d, "inverted_index")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms with at least a hundredth of all rows of the positional index."""
    return heavy_keys.heavy_terms(*_indexes(spark, d))


def p1_row_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and list entries of every term in both indexes."""
    return heavy_keys.row_shares(*_indexes(spark, d))


def p1_term_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every term over the merged indexes."""
    return heavy_keys.term_totals(*_indexes(spark, d))


def p1_merged_postings(spark: SparkSession, d: str) -> DataFrame:
    """The complete merged postings and positions, one row a term and document."""
    both = heavy_keys.merged_postings(*_indexes(spark, d))
    return both.select("term", "doc_id", F.array_join("positions", ",").alias("positions"), "tf", "n_rows", "n_entries", "tf_sum")


def p1_posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The complete posting list of every term, in blocks; postings are printed as doc(tf)[positions]."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    entry = lambda p: F.concat(p["doc_id"], F.lit("("), blank(p["tf"].cast("string")), F.lit(")["), blank(F.array_join(p["positions"], ",")), F.lit("]"))
    return heavy_keys.posting_blocks(*_indexes(spark, d), P1_BLOCK).withColumn("postings", F.array_join(F.transform("postings", entry), " "))


#: The query that the entry point runs.
FLAGSHIP = "tfidf"


def queries() -> dict[str, Query]:
    own = (
        p1_found, p1_row_shares, p1_term_totals, p1_merged_postings, p1_posting_blocks,
        timed_tokens, tok_treebank, stem_porter, stem_snowball, stem_map, lemma, lemma_tokens, lemma_final, doc_preview, collection_totals, majority_language, doc_lengths,
        inv_set, inv_set_table, inv_tf_postings, inv_tf_table, document_frequencies, tfidf, index_stats, index_stats_table, top10_df, singleton_terms, vocab,
        biword_index, biword_table, positional_index, positional_table, phrase_candidates, phrase_false_positives, phrase_starts, phrase_compare, phrase_compare_observed, phrase_demo, phrase_account,
        dict_inorder, dict_search_rank, dict_range, dict_prefix, dict_prefix_observed, dict_bst_search, dict_update, dict_stats, dict_depths, dict_benchmark,
        kgram_index, kgram_top, wildcard_observed, wildcard_docs, edit_distances, indel_ratios, spell_suggest, spell_best, spell_table,
        soundex_codes, metaphone_codes, soundex_groups, metaphone_groups, phonetic_index, phonetic_match_soundex, phonetic_match, cosine_rank, compare_stem_lemma, bool_setops, bool_terms_and, bool_terms_or,
        source_upsert, source_csv, sample_preview, collection_answers, store_parquet, stored_boolean, stored_phrase, store_json, store_json_object, stream_postings, stream_windows,
    )
    made = {
        "tok_simple": _stage("raw_tokens"),
        "tok_lower": _stage("lower_tokens"),
        "tok_hyphen": _stage("hyph_tokens"),
        "tok_alnum_filter": _stage("clean_tokens"),
        "tok_stopword_kept": _stage("final_tokens"),
        "tok_stopword_removed": _stage("removed_sw"),
        "tok_case_kept": _stage("final_tokens", lowercase=False, handle_hyph=False, rm_stopwords=False),
        "phrase_biword": _biword_query,
        **{name: _positional_query(name) for name in PHRASES if name != "phrase_biword"},
        **{name: _boolean(q) for name, q in BOOLEAN.items()},
        **{name: _wildcard(p) for name, p in WILDCARDS.items()},
        "tolerant_wildcard": _tolerant("Vacc*", "docs"),
        "tolerant_exact": _tolerant(" Vaccine ", "docs"),
        "tolerant_corrected": _tolerant(MISSPELLED[0], "terms"),
        "tolerant_corrected_spelled": _tolerant(MISSPELLED[0], "spelled"),
        "tolerant_corrected_docs": _tolerant(MISSPELLED[0], "docs"),
    }
    for name, f in made.items():
        f.__name__ = name
    return {f.__name__: f for f in own} | made
