"""Canonical forms."""

import unicodedata

import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st

canonical = pytest.importorskip("termloom.llm.canonical")
CASES = {
    "\uff56\uff41\uff43\uff43ine": ("vaccine", ["form"]), "con\ufb01g": ("config", ["form"]), "\U0001d429\U0001d41arser": ("parser", ["form"]), "tie\u2011break": ("tie-break", ["form"]),
    "\uff11\uff10\uff0c5": ("10,5", ["form"]), "Tu\u0308nel": ("T\xfcnel", ["mark"]), "U\u0301j": ("\xdaj", ["mark"]), "s\u200dtudy": ("study", ["hidden"]), "of\xad": ("of", ["hidden"]),
    "\ufeffx": ("x", ["hidden"]), "wo\u2060rd": ("word", ["hidden"]), "mean\xa0rate": ("mean rate", ["blank"]), "a\u3000b": ("a b", ["blank"]), "v\u0430ccine": ("vaccine", ["letter"]),
    "\u057d\u0440t\u0430ke": ("uptake", ["letter"]), "\u0261r\u0251mmar": ("grammar", ["letter"]), "\u043ao\u043ca\u043d\u0434a": ("\u043a\u043e\u043c\u0430\u043d\u0434\u0430", ["letter"]),
    "Gr\u043e\u0308\xdfe": ("Gr\xf6\xdfe", ["mark", "letter"]), "\uff52\u0435v": ("rev", ["form", "letter"]),
}
FREE = (
    "plain", "", "Gr\xf6\xdfe", "na\xefve \u201cquotes\u201d \u2013 dash\u2026 \xbd m\xb2 5 \xb0C", "\u043f\u043e\u043b\u043d\u043e\u0442\u0430 \u043f\u043e\u0438\u0441\u043a\u0430", "\u03b2-globulin",
    "\u0394t = 3 k\u03a9", "\U0001f600 \U0001f44d", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u2764\ufe0f", "\u03b1\u03bd\u03c4\u03af\u03c3\u03c9\u03bc\u03b1", "\u30ef\u30af\u30c1\u30f3", "a\tb\r\nc", "1.\xaa 2.\xba \u2116",
)


def test_disguises():
    canon = canonical.Canon()
    for text, (form, kinds) in CASES.items():
        assert canon(text) == (form, kinds), text
    for text in FREE:
        assert canon(text) == (text, []), text
    whole = " ".join(CASES) + " " + " ".join(FREE)
    assert len(canon(whole)[0]) > 0 and set(canon(whole)[1]) == {"form", "mark", "hidden", "blank", "letter"}


alphabet = st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeo\u0301\u0327\u0308n\uff46\ufb01\u043e\u0441\xa0\u200b\xf1\uac01\u1100\u1161"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, max_size=40))
def test_form_is_stable_and_composed(text):
    canon = canonical.Canon()
    form, kinds = canon(text)
    assert (form == text) or kinds
    again, more = canon(form)
    assert canon(again)[0] == again
    if "letter" not in kinds + more:
        assert unicodedata.is_normalized("NFC", form)


def test_segments_equal_whole_normalization():
    canon = canonical.Canon()
    for text in ("Zoro\u0308n\u0303os v. Tu\u0308na", "e\u0323\u0302 x \u0327c", "\u1100\u1161\u11a8 \uac00\u11a8"):
        assert canon(text)[0] == unicodedata.normalize("NFC", text)


def test_tables(spark):
    garbled = "Gr\xc3\xb6\xc3\x9fe \xc3\xbcber\u200b"
    rows = [(1, "\uff58", "k"), (1, "\uff58", "k"), (2, None, "k"), (3, "", "k"), (4, "a" * 300_000 + "\u200b", "k"), (5, garbled, "k"), (6, "x", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = {r.doc_id: r for r in canonical.canonical(docs, "doc_id", "text").collect()}
    assert got[1].canonical == "x" and got[1].changed and got[2].canonical is None and not got[2].changed and got[3].canonical == "" and got[4].canonical == "a" * 300_000
    terms = spark.createDataFrame([(7, "v\u0430ccine"), (8, None), (9, "vaccine"), (7, "v\u0430ccine")], "entry_id long, term string")
    found = canonical.disguised(docs, terms)
    assert set(values(found)) >= {("documents", 1), ("documents", 4), ("inverted_index", 7)} and found.count() == found.distinct().count()
    assert canonical.disguised(docs.where("false"), terms.where("false")).count() == 0


def test_invisible_characters_and_rare_blanks():
    canon = canonical.Canon()
    for hidden in "\u034f\u115f\u3164\u2800\u180b\u180e\ufe03\u200b\u2060\ufeff\u00ad\U000e0041\uffa0":
        assert canon(f"in{hidden}dex") == ("index", ["hidden"]), hex(ord(hidden))
    for blank in "\x0b\x0c\u1680\u2009\u202f\u3000\u00a0":
        assert canon(f"a{blank}b") == ("a b", ["blank"]), hex(ord(blank))
    for end in "\x85\u2028\u2029":
        assert canon(f"a{end}b") == ("a\nb", ["blank"])
    assert canon("a\tb\r\nc") == ("a\tb\r\nc", [])
    assert canon("ok 👩\u200d💻 ❤\ufe0f")[1] == []


def test_small_capitals_are_look_alikes():
    canon = canonical.Canon()
    for word, plain in (("sᴛem", "stem"), ("inᴅex", "index"), ("ᴋey", "key"), ("terᴍ", "term"), ("qᴜery", "query"), ("ᴀnd", "and")):
        assert canon(word) == (plain, ["letter"]), word


def test_form_feed_in_plain_text_is_found(spark):
    docs = spark.createDataFrame([(1, "page\x0cbreak"), (2, "plain"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(7, "a\x0bb"), (8, "ab")], "entry_id long, term string")
    assert values(canonical.disguised(docs, terms)) == [("documents", 1), ("inverted_index", 7)]
