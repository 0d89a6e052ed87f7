"""Tokens, stems, codes and distances."""

import math

from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.phonetic import metaphone_of, soundex, soundex_of
from termloom.functions.similarity import common_subsequence, indel_ratio, ratio_of
from termloom.functions.stemming import porter, snowball
from termloom.operators import lemmas
from termloom.operators.preprocess import PreprocessConfig, final_tokens, preprocess, timed_preprocess


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_tokenizers(spark):
    assert one(spark, "Hello, world!", T.simple_tokenize) == ["Hello", "world"]
    assert one(spark, "Hello, world!", T.treebank_tokenize) == ["Hello", ",", "world", "!"]
    assert one(spark, "I can't go. He left.", T.treebank_tokenize) == ["I", "ca", "n't", "go", ".", "He", "left", "."]
    for empty in (None, "", " \t\n", "... !!"):
        assert one(spark, empty, T.simple_tokenize) == []
    assert one(spark, "x" * 100_000 + " y", T.simple_tokenize) == ["x" * 100_000, "y"]


def test_hyphens_and_filters(spark):
    tokens = lambda *ts: spark.createDataFrame([(list(ts),)], "t array<string>")
    first = lambda df, c: df.select(c.alias("x")).first().x
    assert first(tokens("well-known", "dog"), T.handle_hyphen(F.col("t"))) == ["well-known", "well", "known", "dog"]
    assert first(tokens("-"), T.handle_hyphen(F.col("t"))) == ["-", "", ""]
    assert first(tokens("-", "", "é", "élan", "9"), T.keep_wordlike(F.col("t"))) == ["élan", "9"]
    kept, removed = T.remove_stopwords(F.col("t"), ["dog"])
    assert first(tokens("The", "dog", "cat", "the", "cat"), kept) == ["cat", "cat"]
    assert first(tokens("The", "dog", "cat", "the", "cat"), removed) == ["The", "dog", "the"]


def test_kgrams(spark):
    assert one(spark, "information", T.get_kgrams) == "$in inf nfo for orm rma mat ati tio ion on$".split()
    assert one(spark, "a", T.get_kgrams) == ["$a$"]
    assert one(spark, "", T.get_kgrams) == []
    assert one(spark, None, T.get_kgrams) == []


def test_stems():
    assert [porter(w) for w in ("running", "runs", "easily", "flies", "dies", "happy", "enjoy", "relational", "hopping", "sky", "dying")] == "run run easili fli die happi enjoy relat hop sky die".split()
    assert [porter(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "conflated", "sized", "controlling", "rate", "cease")] == "caress poni cat agre plaster motor conflat size control rate ceas".split()
    assert [snowball(w) for w in ("generously", "running", "knightly", "consistency", "skies", "happy", "dying", "proceed", "communism", "by", "cried", "ties")] == "generous run knight consist sky happi die proceed communism by cri tie".split()
    assert porter("") == snowball("") == ""


def test_codes(spark):
    assert soundex_of("serch") == "S620" and soundex_of("searches") == "S622" and soundex_of("Ashcraft") == "A261" and soundex_of("Tymczak") == "T522"
    assert soundex_of("élan") == "E450" and soundex_of("19") == "1000" and soundex_of("") == ""
    df = spark.createDataFrame([("search",), ("élan",), ("19",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(soundex(F.col("t")).alias("x")).collect()] == ["S620", "E450", "1000", "", None]
    expected = {"knight": "NT", "phone": "FN", "metaphone": "MTFN", "school": "SKL", "wrack": "RK", "church": "XRX", "science": "SNS", "nation": "NXN", "vaccine": "FKSN", "thin": "0N", "": ""}
    assert {w: metaphone_of(w) for w in expected} == expected


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_ratio_is_that_of_the_plain_recurrence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    assert common_subsequence(a, b) == row[-1]
    assert math.isclose(ratio_of(a, b), 100.0 if not a and not b else 200 * row[-1] / (len(a) + len(b)))


def test_ratio_column(spark):
    df = spark.createDataFrame([("infomation", "information"), ("a", "b"), (None, "b")], "a string, b string")
    assert [None if r.x is None else round(r.x, 2) for r in df.select(indel_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [95.24, 0.0, None]


def test_pipeline_stages(spark):
    docs = spark.createDataFrame([(1, "The State-of-the-art engines are RUNNING."), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in preprocess(docs, PreprocessConfig(do_stem=True)).collect()}
    assert rows[1].final_tokens == ["state-of-the-art", "state", "art", "engin", "run"]
    assert rows[1].removed_sw == ["the", "of", "the", "are"]
    assert rows[1].stem_map == {"engines": "engin", "running": "run"}
    assert rows[2].final_tokens == rows[3].final_tokens == [] and rows[2].stem_map == {}
    kept = preprocess(docs, PreprocessConfig(lowercase=False, handle_hyph=False, rm_stopwords=False)).where("doc_id = 1").first()
    assert kept.final_tokens == ["The", "State-of-the-art", "engines", "are", "RUNNING"]
    assert preprocess(docs.where("false")).count() == 0


def test_timing(spark):
    out, ms = timed_preprocess(spark.createDataFrame([(1, "a cat")], "doc_id long, text string"))
    assert ms > 0 and out.first().final_tokens == ["cat"]


def test_lemmas_by_rule(spark):
    tokens = spark.createDataFrame([(t,) for t in ("engines", "engine", "geese", "ran", "running", "run", "glass", "was", None, "engines")], "token string")
    assert dict(values(lemmas.lemma_table(tokens, "n"))) == {"engines": "engine", "geese": "goose"}
    assert dict(values(lemmas.lemma_or_verb(tokens))) == {"engines": "engine", "geese": "goose", "ran": "run", "running": "run", "was": "be"}
    docs = spark.createDataFrame([(1, "engines engine geese"), (1, "engines engine geese"), (2, None)], "doc_id long, text string")
    out = preprocess(docs, PreprocessConfig(do_lemma=True, do_stem=True)).orderBy("doc_id").collect()
    assert [r.final_tokens for r in out] == [["engin", "engin", "goos"], ["engin", "engin", "goos"], []]
    assert out[0].lemma_map == {"engines": "engine", "geese": "goose"} and out[0].stem_map == {"engine": "engin", "goose": "goos"}
    want = dict(p.split(":") for p in """studies:study boxes:box matches:match heroes:hero classes:class houses:house queries:query bus:bus basis:basis making:make using:use reading:read
        compared:compare reduced:reduce changed:change stopped:stop visited:visit treated:treat creating:create eating:eat string:string need:need judged:judge required:require
        described:describe provided:provide increased:increase telling:tell passing:pass classified:classify indexing:index computed:compute contained:contain focused:focus""".split())
    found = spark.createDataFrame([(w,) for w in want], "w string").select("w", lemmas.lemma_of(F.col("w")).alias("l"))
    assert dict(values(found)) == want


def test_a_document_keeps_its_lemmas_whatever_is_beside_it(spark):
    cfg = PreprocessConfig(do_lemma=True)
    one = spark.createDataFrame([(1, "wolves hosted markings")], "doc_id long, text string")
    many = one.union(spark.createDataFrame([(2, "wolve host marking mark wolf hoste")], one.schema))
    assert final_tokens(one, cfg).first() == final_tokens(many, cfg).where("doc_id = 1").first()


def test_lemmas_of_a_lexicon(spark, tmp_path):
    """The public database's files: index lines after a licence that begins with blanks, and exceptions."""
    (tmp_path / "wn").mkdir()
    for name, words, exceptions in (("noun", "better building goose mouse wolf", "geese goose\nmice mouse\nwolves wolf\n"), ("verb", "build run house", "ran run\nrunning run\n"), ("adj", "good", "better good well\n")):
        (tmp_path / "wn" / f"index.{name}").write_text("  1 This is a licence\n" + "".join(f"{w} {name[0]} 1 0 1 1 00000001\n" for w in words.split()))
        (tmp_path / "wn" / f"{name}.exc").write_text(exceptions)
    lexicon = lemmas.read_lexicon(spark, f"file://{tmp_path}/wn")
    tokens = spark.createDataFrame([(t,) for t in "geese mice wolves buildings building built running ran houses better qwerties".split()] + [(None,)], "token string")
    assert dict(values(lemmas.lemma_table(tokens, "n", lexicon))) == {"geese": "goose", "mice": "mouse", "wolves": "wolf", "buildings": "building"}
    assert dict(values(lemmas.lemma_or_verb(tokens, lexicon))) == {"geese": "goose", "mice": "mouse", "wolves": "wolf", "buildings": "building", "building": "build", "running": "run", "ran": "run", "houses": "house"}
    assert dict(values(lemmas.lemma_table(tokens, "a", lexicon))) == {"better": "good"}
    docs = spark.createDataFrame([(1, "geese ran"), (1, "geese ran"), (None, "wolves wolves"), (3, None)], "doc_id long, text string")
    got = sorted(map(str, (r.final_tokens for r in preprocess(docs, PreprocessConfig(do_lemma=True), lexicon).collect())))
    assert got == ["['goose', 'run']", "['goose', 'run']", "['wolf', 'wolf']", "[]"]
    (tmp_path / "words.txt").write_text("Goose\n\nhouse\n")
    assert dict(values(lemmas.lemma_table(tokens, "n", lemmas.read_lexicon(spark, f"file://{tmp_path}/words.txt")))) == {"houses": "house"}


def test_abbreviations_end_no_sentence(spark):
    assert one(spark, "Dr. Smith met Prof. Lee et al. See Fig. 3. Then e.g. A left.", T.treebank_tokenize) == [
        "Dr.", "Smith", "met", "Prof.", "Lee", "et", "al.", "See", "Fig.", "3.", "Then", "e.g.", "A", "left", "."
    ]
    assert one(spark, "It was so. He left.", T.treebank_tokenize) == ["It", "was", "so", ".", "He", "left", "."]
