"""Per-term results with a third of all rows in one term."""

from collections import Counter, defaultdict

import pytest
from conftest import values
from pyspark.sql import functions as F

from termloom.operators import heavy_keys as H

POS = "term string, doc_id string, positions array<int>, n_rows int"
INV = "entry_id long, segment_id int, term string, doc_frequency long, posting_list array<struct<doc_id:string,tf:int>>, n_entries int"


@pytest.fixture(scope="module")
def tables(spark):
    pos = [("hot", f"d{i % 400}", [i, i], 0) for i in range(1500)] + [(f"t{i % 900}", f"d{i}", [i], 0) for i in range(3000)]
    pos += [(None, "d1", [1], 0), ("hot", None, [2], 0), ("lone", "d1", None, 0), ("t1", "d1", [None, 3], 0), ("t1", "d1", [3], 0)]
    inv = [(1, 0, "hot", 5, [(f"d{i}", 1 + i % 3) for i in range(700)], 0), (2, 1, "hot", None, [("d1", 9), ("d1", 9), (None, 1)], 0), (3, 0, "t1", 1, None, 0), (4, 0, None, 1, [("d1", 1)], 0), (5, 0, "only", 1, [("d7", None)], 0), (5, 0, "only", 1, [("d7", None)], 0)]
    return spark.createDataFrame(pos, POS), spark.createDataFrame(inv, INV), pos, inv


def test_shares(tables):
    positional, inverted, pos, inv = tables
    counts = Counter(p[0] for p in pos)
    assert values(H.heavy_terms(positional, inverted)) == ["hot"]
    rows = {r.term: r for r in H.row_shares(positional, inverted).collect()}
    assert None not in rows and rows["hot"].n_rows == counts["hot"] and rows["hot"].n_list_rows == 2 and rows["hot"].n_entries == 703
    assert rows["hot"].pair_rows == 2 * counts["hot"] and rows["only"].n_rows == 0 and rows["t1"].n_entries == 0
    assert {r.total_rows for r in rows.values()} == {len(pos)}


def test_merge_is_that_of_plain_dicts(tables):
    positional, inverted, pos, inv = tables
    places, n_rows = defaultdict(set), Counter()
    for term, doc, positions, _ in pos:
        if term and doc:
            places[term, doc] |= set(positions or [])
            n_rows[term, doc] += 1
    tfs = defaultdict(list)
    for _, _, term, _, entries, _ in inv:
        for doc, tf in entries or []:
            if term and doc:
                tfs[term, doc].append(tf)
    got = {(r.term, r.doc_id): r for r in H.merged_postings(positional, inverted).collect()}
    assert set(got) == set(places) | set(tfs)
    for key, r in got.items():
        assert (set(r.positions or []) if r.positions is not None else set()) == places.get(key, set())
        assert (r.n_rows or 0, r.n_entries or 0) == (n_rows[key], len(tfs.get(key, [])))
        assert (r.tf or 0) == max((t or 0 for t in tfs.get(key, [])), default=0)
    totals = {r.term: r for r in H.term_totals(positional, inverted).collect()}
    assert totals["hot"].pair_rows == sum(n_rows["hot", d] * len(tfs["hot", d]) for _, d in set(places) & set(tfs) if _ == "hot")
    assert totals["hot"].pair_tf == sum(n_rows[k] * sum(tfs[k]) for k in set(places) & set(tfs) if k[0] == "hot")


def test_blocks_are_whole_and_small(tables):
    positional, inverted, *_ = tables
    blocks = H.posting_blocks(positional, inverted, block_docs=50)
    assert blocks.groupBy("term").agg(F.max("n_docs").alias("m")).agg(F.max("m")).first()[0] <= 110
    flat = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.doc_id", "p.tf")
    assert values(flat) == values(H.merged_postings(positional, inverted), "term", "doc_id", "tf")
    assert blocks.where("term = 'hot'").count() > 5 and blocks.where("term = 't2'").count() == 1


def test_empty_tables(tables):
    positional, inverted, *_ = tables
    none = positional.where("false"), inverted.where("false")
    assert H.heavy_terms(*none).count() == H.merged_postings(*none).count() == H.term_totals(*none).count() == H.posting_blocks(*none).count() == H.row_shares(*none).count() == 0
    assert H.merged_postings(positional, none[1]).count() == H.positional_states(positional).where("doc_id is not null").count()
    assert values(H.heavy_terms(positional, none[1])) == ["hot"]


def test_rows_without_a_document_count(spark):
    positional = spark.createDataFrame([("a", None, [1], 0)] * 3 + [(f"t{i}", "d", [1], 0) for i in range(7)] + [(None, None, None, 0)] * 2, POS)
    inverted = spark.createDataFrame([(1, 0, "a", 1, [("d", 1)], 0)], INV)
    assert values(H.heavy_terms(positional, inverted, 0.25)) == ["a"] and values(H.heavy_terms(positional, inverted, 0.26)) == []
    assert [r.n_rows for r in H.merged_postings(positional, inverted).where("term = 'a'").collect()] == [None]


def test_only_terms_that_are_not_heavy_are_joined_by_term(tables, monkeypatch):
    positional, inverted, *_ = tables
    rows = lambda df: values(df.selectExpr("term", "block", "n_docs", "to_json(postings)"))
    plain = rows(H.posting_blocks(positional, inverted, block_docs=50))
    for share in (0.0, 1.0):
        monkeypatch.setattr(H, "HEAVY_SHARE", share)
        assert rows(H.posting_blocks(positional, inverted, block_docs=50)) == plain
