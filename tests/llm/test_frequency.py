"""Counts by radix spilling, against plain dictionaries."""

from collections import defaultdict

import pytest
from conftest import values

frequency = pytest.importorskip("termloom.llm.frequency")
FORM = "entry_id long, segment_id int, term string, doc_frequency long, posting_list array<struct<doc_id:string,tf:int>>, n long"


def build():
    rows = [(1, 0, "hot", 1, [(f"d{i}", 1 + i % 4) for i in range(900)], 0), (2, 3, "hot", 1, [(f"d{i}", 7) for i in range(100)], 0), (2, 3, "hot", 1, [(f"d{i}", 7) for i in range(100)], 0)]
    rows += [(10 + k, k % 5, f"t{k % 300}", 1, [(f"d{(k * 7) % 1000}", 1), (f"d{k % 50}", 2)], 0) for k in range(800)]
    rows += [(900, 0, None, 1, [("zz", 1)], 0), (901, 0, "empty", 1, [], 0), (902, 0, "null", 1, None, 0), (903, None, "odd", 1, [(None, 1), ("d1", None), ("d1", 3)], 0), (904, 0, "x" * 50_000, 1, [("d1", 1)], 0), (905, 0, "", 1, [("d2", 1)], 0)]
    return rows


def expected(rows):
    merged, n, everything = {}, defaultdict(int), set()
    for _, segment, term, _, entries, _ in rows:
        for doc, tf in entries or []:
            if doc is None:
                continue
            everything.add(doc)
            if term is None:
                continue
            key, rank = (term, doc), (-1 if segment is None else segment, tf or 0)
            merged[key] = max(merged.get(key, rank), rank)
            n[key] += 1
    out = defaultdict(lambda: [0, 0, 0])
    for (term, doc), (_, tf) in merged.items():
        out[term][0] += 1
        out[term][1] += tf
        out[term][2] += n[term, doc]
    return {t: tuple(v) for t, v in out.items()}, len(everything)


@pytest.mark.parametrize("partition_rows", [10**6, 400, 40])
def test_counts(spark, partition_rows):
    rows = build()
    df = spark.createDataFrame(rows, FORM).repartition(3)
    want, n_all = expected(rows)
    got = {r.term: r for r in frequency.marked(df, partition_rows=partition_rows).collect()}
    assert {t: (r.doc_frequency, r.occurrences, r.deliveries) for t, r in got.items()} == want
    for t, r in got.items():
        assert r.n_all == n_all and r.mark == ("rare" if want[t][0] <= 2 else "common" if want[t][0] > 0.3 * n_all else None)


def test_hot_partitions_are_split(spark):
    df = spark.createDataFrame(build(), FORM)
    folders = frequency.partitions(df, 100)
    sizes = [spark.read.parquet(f).count() for f, _ in folders]
    assert sizes == [n for _, n in folders]
    assert sum(sizes) == sum(len([e for e in r[4] or [] if e[0]]) for r in build() if r[2] is not None)
    assert max(sizes) <= 100


def test_empty(spark):
    df = spark.createDataFrame(build(), FORM)
    for none in (df.where("false"), df.where("term is null"), df.where("term = 'null'")):
        assert frequency.counted(none).count() == 0 and values(frequency.marked(none)) == []


def test_partitions_grow_rather_than_their_number(spark, monkeypatch):
    df = spark.createDataFrame(build(), FORM)
    monkeypatch.setattr(frequency, "MOST_PARTITIONS", 8)
    folders = frequency.partitions(df, 1)
    assert len(folders) <= 2 * 4 * 8 and max(n for _, n in folders) <= sum(n for _, n in folders) // 8 + 1


@pytest.mark.parametrize("passes", [None, 1, 5])
def test_one_partition_without_spilling(passes):
    import pyarrow as pa
    import pyarrow.dataset as ds

    rows = [("a", f"d{i % 70}", i % 3, i % 5 or None) for i in range(500)] + [("b", "d1", -1, None)]
    table = pa.table({name: [r[i] for r in rows] for i, name in enumerate(("term", "doc_id", "segment_id", "tf"))})
    got = defaultdict(lambda: [0, 0, 0])
    for batch in frequency.aggregated(ds.dataset(table), passes, None, "100MB"):
        for r in batch.to_pylist():
            got[r["term"]] = [x + r[c] for x, c in zip(got[r["term"]], ("doc_frequency", "occurrences", "deliveries"))]
    want, _ = expected([(0, s, t, 1, [(d, tf)], 0) for t, d, s, tf in rows])
    assert {t: tuple(v) for t, v in got.items()} == {t: want[t] for t in ("a", "b")}
