"""Index builders, their tables, and the queries over them."""

import math
import random

import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.operators import boolean, compare, dictionary, index, phrase, spelling, tolerant, wildcard
from termloom.operators.collection import Collection
from termloom.operators.preprocess import PreprocessConfig
from termloom.plans.boolean import parse, tokenize

SAMPLE = {
    "doc1": "Information retrieval is the activity of obtaining relevant information resources.",
    "doc2": "A search engine is a well-known software system designed to carry out web searches.",
    "doc3": "Natural language processing is a subfield of linguistics and artificial intelligence.",
    "doc4": "Stemming reduces inflected words to their word stem or root form.",
    "doc5": "Lemmatization groups inflected forms of a word so they can be analysed as a single item.",
}
PLAIN = PreprocessConfig(rm_stopwords=False)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, i, "x") for i, (k, t) in enumerate(SAMPLE.items())]
    return spark.createDataFrame(rows, "doc_id string, text string, doc_ord long, term string").cache()


@pytest.fixture(scope="module")
def plain(docs):
    return Collection(docs, PLAIN)


def test_index_and_weights(docs, plain):
    postings = plain.postings
    assert plain.vocabulary.count() == 52
    assert dict(values(index.build_doc_lengths(docs, PLAIN))) == {"doc1": 10, "doc2": 16, "doc3": 11, "doc4": 11, "doc5": 16}
    weights = {(r.term, r.doc_id): r.tfidf for r in index.compute_tfidf(postings, 5).collect()}
    assert weights["information", "doc1"] == pytest.approx(3.218876) and weights["inflected", "doc4"] == pytest.approx(0.916291)
    assert weights == {(r.term, r.doc_id): r.tfidf for r in index.compute_tfidf(postings, index.count_docs(docs)).collect()}
    stats = index.index_statistics(docs, PLAIN).first()
    assert (stats.vocab_size, stats.doc_count) == (52, 5) and stats.max_df_term in ("of", "is", "a") and stats.singleton_terms == index.singleton_terms(docs, PLAIN).count()
    table = {r.Term: r["Posting List"] for r in index.index_to_dataframe(postings).collect()}
    assert table["information"] == "doc1(2)" and table["inflected"] == "doc4(1), doc5(1)"
    sets = {r.Term: r["Posting List"] for r in index.index_to_df(index.build_inverted_set(docs, PLAIN)).collect()}
    assert sets["inflected"] == "doc4, doc5"


def test_insertion_order_decides_ties(spark):
    docs = spark.createDataFrame([(1, "b a", 1), (2, "c a", 0)], "doc_id long, text string, doc_ord long")
    cfg = PreprocessConfig(rm_stopwords=False)
    stats = index.index_statistics(docs, cfg).first()
    assert (stats.max_df_term, stats.min_df_term) == ("a", "b")
    assert [r.term for r in index.top_terms(docs, cfg).collect()] == ["a", "c", "b"]
    empty = index.index_statistics(docs.where("false"), cfg).first()
    assert (empty.vocab_size, empty.avg_df, empty.max_df_term, empty.doc_count) == (0, 0.0, None, 0)
    assert [r.Metric for r in index.stats_to_dataframe(index.index_statistics(docs, cfg)).collect()][:2] == ["Vocabulary Size", "Total Postings"]


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "doc_id long, text string")
    assert dict(values(index.build_doc_lengths(docs))) == {1: 0, 2: 0, 3: 1}
    assert values(boolean.boolean_query("NOT one", index.build_inverted_index(docs), docs)) == [1, 2]
    assert index.build_biword_index(docs).count() == 0
    none = docs.where("false")
    for made in (index.build_inverted_index(none), index.build_biword_index(none), index.build_positional_index(none), index.extract_vocabulary(none), index.collection_preview(none)):
        assert made.count() == 0
    assert [tuple(r) for r in index.collection_totals(none).collect()] == [(0, 0)]


QUERIES = {
    "information AND retrieval": ("AND", ["doc1"]), "stem OR lemma": ("OR", ["doc4"]), "NOT search": ("NOT", ["doc1", "doc3", "doc4", "doc5"]),
    "stem OR search AND engine": ("COMPLEX", ["doc2", "doc4"]), "(stem OR search) AND engine": ("COMPLEX", ["doc2"]), "search NOT engine": ("AND", []),
    "information (retrieval OR engine)": ("COMPLEX", ["doc1"]), "NOT NOT stem": ("NOT", ["doc4"]), "": ("AND", []), "Stem": ("AND", ["doc4"]),
}


def test_boolean(plain):
    for query, (operator, found) in QUERIES.items():
        assert parse(query).operator == operator, query
        assert values(plain.boolean(query)) == found, query
    for query, error in {"(cat": "Missing closing parenthesis", "cat)": "Unexpected token ')'", "cat AND": "Unexpected end of query", "()": "Unexpected token ')'"}.items():
        assert (parse(query).operator, parse(query).error) == ("INVALID", error)
        assert plain.boolean(query).count() == 0
    stemmed = Collection(plain.docs, PreprocessConfig(do_stem=True))
    assert values(stemmed.boolean("information AND retrieval")) == [] and values(stemmed.boolean("information AND retrieval", normalize_query=True)) == ["doc1"]


trees = st.recursive(st.sampled_from("abc"), lambda t: st.one_of(t.map(lambda x: f"NOT {x}"), st.tuples(t, st.sampled_from([" AND ", " OR ", " "]), t).map(lambda x: f"({x[0]}{x[1]}{x[2]})")), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(trees)
def test_boolean_column_is_the_set_evaluation(spark, query):
    postings = {"a": {1, 2}, "b": {2, 3}, "c": {5}}
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id int")
    table = spark.createDataFrame([(t, d) for t, ds in postings.items() for d in ds], "term string, doc_id int")
    assert set(values(boolean.boolean_query(query, table, docs))) == parse(query).tree.docs(postings, {1, 2, 3, 4, 5})


def test_set_operations_agree(plain):
    p, d = plain.postings, plain.docs
    terms = ["a", "of", "word"]
    assert values(boolean.boolean_and(terms, p)) == values(boolean.and_by_sets(terms, p)) == ["doc5"]
    assert values(boolean.boolean_or(terms, p)) == values(boolean.or_by_sets(terms, p))
    assert values(boolean.boolean_not("of", p, d)) == values(boolean.not_by_sets("of", p, d)) == ["doc2", "doc4"]
    assert boolean.boolean_and([], p).count() == 0
    assert tokenize("a and(b)") == ["a", "AND", "(", "b", ")"]


def test_phrases(spark, plain):
    for query, bw, ps in (("information retrieval", ["doc1"], ["doc1"]), ("information", [], ["doc1"]), ("well-known software", ["doc2"], ["doc2"]), ("", [], []), ("no such", [], [])):
        assert values(phrase.query_biword(query, plain.biwords)) == bw
        assert values(phrase.query_positional(query, plain.positions), "doc_id") == ps
    docs = spark.createDataFrame([("fp1", "a b x b c"), ("fp2", "a b c"), ("fp3", "a. B! C a b c")], "doc_id string, text string")
    c = Collection(docs)
    assert values(c.phrase("a b c")) == [("fp2", 0), ("fp3", 0)]
    assert values(phrase.phrase_starts("a b c", c.positions)) == [("fp2", 0), ("fp3", 0), ("fp3", 3)]
    assert values(phrase.query_biword("a b c", c.biwords)) == ["fp1", "fp2", "fp3"]
    assert values(phrase.false_positives("a b c", c.positions)) == ["fp1"]
    notes = {r.Document: r.Note for r in c.compare_phrase("a b c").collect()}
    assert notes["fp1"] == phrase.NOTES["false"] and notes["fp2"] == phrase.NOTES["both"]
    demo = phrase.false_positive_demo(spark)
    assert values(demo["biword"]) == values(demo["positional"], "doc_id") == ["demo_doc2"] and values(demo["false_positives"]) == ["demo_doc1"]
    positions = {r.term: r.positions for r in index.build_positional_index(spark.createDataFrame([(1, "the cat sat on the cat mat")], "doc_id int, text string")).collect()}
    assert positions["cat"] == [1, 5]
    assert values(phrase.missing_biwords("a b z", c.biwords)) == ["b z"]


def test_wildcards(plain):
    for pattern, found in {"inf*": ["inflected", "information"], "*ing": ["obtaining", "processing", "stemming"], "s*em": ["stem", "system"], "s*m": ["stem", "system"], "*stem*": ["stem", "stemming", "system"]}.items():
        assert values(plain.wildcard(pattern)) == found
    for pattern, found in {"inf*": [], "*ing": [], "s*em": [], "s*m": ["stem", "system"], "*stem*": ["stem"]}.items():
        assert values(plain.wildcard(pattern, "observed")) == found
    assert wildcard.wildcard_to_kgrams("inf*") == ["$in", "inf"] and wildcard.wildcard_to_kgrams("*tion") == ["ion", "on$", "tio"]
    assert plain.wildcard("*").count() == 52 and plain.wildcard("a_*%").count() == 0


def test_spelling_and_tolerance(plain):
    v = plain.vocabulary
    got = {r.query: (r.term, round(r.score, 2), r.distance) for r in spelling.suggestions(["infomation", "retreival", "a", "stem"], v).where("place = 1").collect()}
    assert got["infomation"] == ("information", 95.24, 1) and got["retreival"] == ("retrieval", 88.89, 2) and got["stem"] == ("stem", 100.0, 0)
    assert {r.query: r.best_match for r in spelling.best_matches(["zzzz"], v).collect()} == {"zzzz": "zzzz"}
    assert values(spelling.phonetic_matches("serch", plain.soundex)) == [("S620", "search")]
    for query, path, docs in (("infomation", "corrected", ["doc1"]), (" Information", "exact", ["doc1"]), ("inf*", "wildcard", ["doc1", "doc4", "doc5"]), ("qqqq", "corrected", [])):
        found = plain.tolerant(query)
        assert (found.path, values(found.docs)) == (path, docs)
    assert tolerant.TolerantResult is not None


class Tree:
    """A plain binary search tree."""

    def __init__(self, key):
        self.key, self.left, self.right = key, None, None

    def insert(self, key):
        side = "left" if key < self.key else "right"
        at = getattr(self, side)
        at.insert(key) if at else setattr(self, side, Tree(key))

    def search(self, key, n=1):
        if key == self.key:
            return True, n
        at = self.left if key < self.key else self.right
        return at.search(key, n + 1) if at else (False, n)


def test_search_tree(spark):
    words = sorted({"".join(random.Random(i).choices("abcdé", k=1 + i % 6)) for i in range(400)})
    vocabulary = spark.createDataFrame([(w,) for w in words + words[:3]] + [(None,)], "term string")
    order = [r.term for r in dictionary.with_priority(vocabulary).orderBy("prio").collect()]
    tree = Tree(order[0])
    for w in order[1:]:
        tree.insert(w)
    keys = ["abc", "zzz", "", words[7], words[-1], "é"]
    for parts in (1, 64):
        assert {r.query: (r.found, r.comparisons) for r in dictionary.bst_search(vocabulary, keys, parts).collect()} == {k: tree.search(k) for k in keys}
    assert {r.term: r.depth for r in dictionary.bst_depths(vocabulary).collect()} == {w: tree.search(w)[1] for w in words}
    assert dictionary.height(vocabulary).first().height == max(tree.search(w)[1] for w in words)
    assert dictionary.height(vocabulary.where("false")).first()[:] == (0, 0, True)
    assert [r.BST for r in dictionary.tree_stats(vocabulary).collect()][0] == str(len(words))


def test_sorted_dictionary(spark):
    v = spark.createDataFrame([(t,) for t in ("inf", "infer", "inform", "ing", "inz", "a", "c", "e")], "term string")
    assert values(dictionary.sorted_search(v, ["c", "d", "z"])) == [("c", True, 1), ("d", False, 2), ("z", False, 8)]
    assert values(dictionary.prefix_search(v, "inf")) == ["inf", "infer", "inform"] and values(dictionary.prefix_search(v, "inf", "observed")) == ["inf", "infer", "inform", "ing"]
    assert values(dictionary.range_query(v, "inf", "inz")) == ["inf", "infer", "inform", "ing", "inz"] and dictionary.range_query(v, "z", "a").count() == 0
    assert dictionary.prefix_search(v, "").count() == 8
    assert values(dictionary.Dictionary(v).insert("b").insert("b").delete("a").delete("zz").all_terms()) == sorted(["inf", "infer", "inform", "ing", "inz", "b", "c", "e"])
    assert dictionary.benchmark(v, ["c", "d"]).shape == (2, 7)


def test_pruning_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("term"), F.lit(1).alias("other")).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "StringStartsWith(term,1)" in plan(dictionary.prefix_search(v, "1")) and "GreaterThanOrEqual(term,1)" in plan(dictionary.range_query(v, "1", "2"))
    assert "other" not in plan(dictionary.range_query(v, "1", "2")).partition("Physical")[2]
    assert "CartesianProduct" not in plan(dictionary.bst_search(v, ["1", "x"]))


def test_cosine_and_comparison(spark, docs):
    asked = spark.createDataFrame([("information retrieval",), ("inflecting words",), ("zzz",)], "query string")
    sims = {(r.query, r.doc_id): r.sim for r in compare.cosine(docs, asked).collect()}
    assert max(sims, key=sims.get)[1] == "doc1" and all(0 < s <= 1 + 1e-9 for s in sims.values()) and not any(q == "zzz" for q, _ in sims)
    terms = [["search"], ["search", "web"]]
    two = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(terms)], "doc_id int, text string")
    w = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    got = {r.doc_id: r.sim for r in compare.cosine(two, spark.createDataFrame([("search",)], "query string")).collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(w[0] / math.hypot(*w))}
    out = {r.Query: r for r in compare.compare_stem_vs_lemma(docs, asked).collect()}
    assert out["inflecting words"]["Stem matches"] == 2 and out["zzz"].Better == "Tie"
    assert [r.Better for r in compare.compare_stem_vs_lemma(docs.where("false"), asked).collect()] == ["Tie"] * 3


def test_account_of_a_phrase(spark, docs):
    bw, ps = index.build_biword_index(docs), index.build_positions(docs)
    got = {(r.kind, r["item"]): (r.n_docs, r.missing) for r in phrase.account("information retrieval zebra", bw, ps).collect()}
    assert got == {("biword", "information retrieval"): (1, False), ("biword", "retrieval zebra"): (0, True), ("term", "information"): (1, False), ("term", "retrieval"): (1, False), ("term", "zebra"): (0, True)}
    assert values(phrase.postings("information retrieval", bw, ps)) == [("biword", "information retrieval", "doc1"), ("term", "information", "doc1"), ("term", "retrieval", "doc1")]
    assert phrase.account("", bw, ps).count() == 0
    answer, ms = phrase.timed(phrase.query_biword("information retrieval", bw))
    assert values(answer) == ["doc1"] and ms > 0


def test_account_of_a_corrected_query(spark, docs):
    from termloom.operators.collection import Collection

    c = Collection(docs)
    found = c.tolerant("infomation")
    assert found.path == "corrected" and values(found.suggestions, "term")[0] == "information" and found.soundex.columns == found.metaphone.columns == ["code", "term"]
    exact = c.tolerant("information")
    assert exact.path == "exact" and exact.suggestions is None
    c.clear()
