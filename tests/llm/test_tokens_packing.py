"""Token ids against public libraries; packing against its bounds."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st

tokens = pytest.importorskip("termloom.llm.tokens")
from termloom.llm import packing  # noqa: E402


def library(name):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(name), special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_are_the_librarys(name):
    encode, encoder = library(name), tokens.Encoder(name)
    r = random.Random(5)
    texts = ["", None, "<|endoftext|> x", "a" * 700, " \n\n \t x", "don't we'll", "Größe полнота 😀 ワクチン", "x" * 200_000]
    texts += ["".join(r.choice("aab \néЖ\U0001f600Zz01'") for _ in range(r.randrange(60))) for _ in range(3000)]
    assert [[i for w in ws for i in w] for ws in encoder.batch(texts)] == [encode(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert [i for w in next(iter(tokens.Encoder().batch([text]))) for i in w] == library("byte_bpe_50k")(text)


def test_pattern_is_the_public_one():
    public = pytest.importorskip("public_tokenizers")
    import regex

    for t in ("don't we'll I'm 's x'd 12 ab \n\n  c!?", "l'été d’été 'S 'LL"):
        assert regex.findall(tokens.PATTERN, t) == regex.findall(public.PATTERN, t)


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encoded(df).collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert dict(values(tokens.sized(df))) == {1: 0, 2: 0, 3: 2}
    assert tokens.encoded(df.where("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200))
def test_pack(sizes):
    sizes = np.array(sizes, np.int64)
    number, is_open = packing.pack(sizes, 100)
    assert len(number) == len(sizes) and len(is_open) == (number.max() + 1 if sizes.sum() else 0)
    open_classes = []
    for n, still in enumerate(is_open):
        own = sizes[(number == n) & (sizes > 0)]
        assert len(own) and own.sum() <= 100
        k = 100 // own.max()
        count = (100 // own == k).sum()
        assert count <= k and (count == k or still or own.sum() == 100)
        if still:
            assert count < k
            open_classes.append(k)
    assert len(open_classes) == len(set(open_classes))  # at most one a class


def test_classes_decide_how_many_lie_together():
    for size, k in ((700, 2), (683, 2), (682, 3), (1025, 1), (1024, 2), (2048, 1), (3, 682)):
        number, is_open = packing.pack(np.full(7 * k + 1, size, np.int64))
        assert np.bincount(number).tolist() == [k] * 7 + [1] and is_open.tolist() == [False] * 7 + [k > 1]
    # a class's documents are put together before smaller ones come in, though two of 600 and two of 400 would fill one
    number, _ = packing.pack(np.array([600, 600, 600, 248, 400, 424, 400, 424, 400], np.int64))
    assert number.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_top_up_is_the_largest_that_fits():
    number, _ = packing.pack(np.array([1500, 500, 548, 547, 1501, 30, 20], np.int64))
    assert number[0] == number[2] and number[4] == number[3]


def test_documents_of_one_size_are_packed_where_they_are(spark):
    """Nothing is gained by bringing shards together, so no task gets more than its shard."""
    df = spark.createDataFrame([(i, "word" + " word" * 699) for i in range(301)], "doc_id long, text string")
    out = packing.packed(df, shard_items=30).collect()
    levels = [p.container.split("/")[0] for p in out]
    assert levels.count("0") >= 301 - 11 and len({p.container for p in out}) <= 151 + 1


def test_packed(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.choice([3, 30, 90, 200, 500, 1100, 2047])) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 5000), (903, "word" + " word" * 2047), (904, "word" + " word" * 2048), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.packed(df, shard_items=40).collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for p in out:
        fill[p.container] += p["size"]
        pieces[p.doc_id, p.n_tokens].append(p)
    assert max(fill.values()) <= packing.CAPACITY
    for ps in pieces.values():
        assert sum(p["size"] for p in ps) == ps[0].n_tokens * len({p.pieces for p in ps}) or len(ps) > ps[0].pieces
        assert all(p.pieces == (1 if p.n_tokens <= packing.CAPACITY else -(-p.n_tokens // packing.CAPACITY)) for p in ps)
    assert {d for d, _ in pieces} == {i for i, _ in rows}
    assert values(packing.split_documents(df)) == [902, 904]
    twice = df.union(df.where("doc_id in (5, 902)"))  # rows of one document: each is packed, none is split for it
    assert values(packing.split_documents(twice)) == [902, 904]
    least = -(-sum(fill.values()) // packing.CAPACITY)
    assert len(fill) <= 1.12 * least + 2
    assert packing.packed(df.where("false")).count() == 0
    assert packing.packed(df.where("doc_id = 900")).count() == 1


def test_folder_of_the_vocabularies_is_a_parameter(spark, tmp_path):
    """Workers need no folder: the driver reads the file and sends it."""
    import shutil

    shutil.copy(f"{tokens.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", tmp_path / "own.tiktoken")
    df = spark.createDataFrame([(1, "Größe und Maß, размер 12"), (2, None)], "doc_id long, text string")
    made = tokens.encoded(df, "own", str(tmp_path))
    (tmp_path / "own.tiktoken").unlink()
    assert {r.doc_id: r.ids for r in made.collect()} == {1: library("byte_bpe_multi_50k")("Größe und Maß, размер 12"), 2: []}
