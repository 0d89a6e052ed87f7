"""Near-duplicates against brute force, also with crowded keys."""

import random
import re

import pytest
from conftest import values
from pyspark.sql import functions as F

neardup = pytest.importorskip("termloom.llm.neardup")


def brute(rows, run=3, least=0.5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= run:
            sets[i] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}"
    shared = [word() for _ in range(30)]
    out, i = [], 0
    for _ in range(60):
        base = [word() for _ in range(r.randrange(20, 120))]
        for share in (0, 0, 0.03, 0.1, 0.2, 0.3):
            out.append((i, " ".join(w if r.random() >= share else word() for w in base)))
            i += 1
    for _ in range(150):  # a passage that many share, not enough to be alike
        out.append((i, " ".join([word() for _ in range(45)] + shared)))
        i += 1
    same = " ".join(word() for _ in range(40))
    for k in range(40):
        out.append((i, same.upper() + "!" * k))
        i += 1
    return out + [(i, None), (i + 1, ""), (i + 2, "two words"), (i + 3, "just three words"), (i + 4, "Just, three words"), (i + 5, "é " * 3000 + same)]


def test_pairs(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:5]], "doc_id long, text string, runs string")
    want = brute(rows)
    got = values(neardup.duplicate_pairs(df))
    assert len(got) == len(set(got)) and set(got) <= want and len(want) - len(got) <= 0.01 * len(want)


def found_by(neardup, df, bucket):
    reps = neardup.signed(df).withColumnRenamed("doc_id", "id")
    return set(values(neardup.candidates(reps, df, bucket=bucket)[0]))


def test_crowded_keys_lose_no_pair(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_at_once, crowded = (found_by(neardup, df, bucket) for bucket in (10**6, 1))
    want = brute(rows)
    assert want & all_at_once <= crowded
    assert want <= set(values(neardup.crowded_pairs(neardup.run_sets(df))))


def test_every_pair_of_a_crowd_at_the_threshold(spark, monkeypatch):
    # every two of them have 84 of 166 runs in common: 0.506
    shared = [f"s{k}" for k in range(86)]
    rows = [(i, " ".join(shared + [f"d{i}x{k}" for k in range(41)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(a, b) for a in range(150) for b in range(a + 1, 150)}
    assert brute(rows[:4]) == {(a, b) for a, b in want if b < 4}
    assert set(values(neardup.duplicate_pairs(df))) == want
    monkeypatch.setattr(neardup, "BLOCK", 7)  # the runs they share in many blocks
    assert set(values(neardup.crowded_pairs(neardup.run_sets(df)))) >= want


def test_hot_runs_are_weighed_like_others(spark, rows, monkeypatch):
    each = neardup.run_sets(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("id", "n", "explode(runs) as run")
    plain = values(neardup.weighed(each))
    for share in (0, 1):
        monkeypatch.setattr(neardup, "HOT", share)
        assert values(neardup.weighed(each)) == plain


def test_pairs_of_sorted_rows():
    import numpy as np

    key, ids, n = (np.array(x) for x in ([1, 1, 2, 5, 5, 5, 7, 7, 7, 7], [3, 8, 3, 1, 2, 9, 1, 2, 3, 4], [10, 10, 9, 4, 9, 8, 1, 1, 1, 1]))
    pairs, crowded = neardup._paired(key, ids, n, 0.5, 3)
    assert sorted(map(tuple, np.concatenate(pairs, 1).T.tolist())) == [(1, 9), (2, 9), (3, 8)] and crowded.tolist() == [7]
    assert neardup._paired(*[np.empty(0, np.int64)] * 3, 0.5, 3)[1].tolist() == []


def test_parities_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(4)
    for n, common in ((1, 0), (60, 30), (300, 200), (5000, 3400)):
        a, b = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        b[:common] = a[:common]
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        x = neardup.parities(a) ^ neardup.parities(b)
        assert sum(int(v).bit_count() if v >= 0 else (int(v) + (1 << 64)).bit_count() for v in x) <= apart


def test_pairs_of_exactly_the_similarity(spark):
    # common runs of every share about a half, sets of equal and of unequal size
    rows = []
    for n in range(3, 40):
        base = [f"b{n}_{k}" for k in range(n)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: n // 2 + 1])), (len(rows) + 2, " ".join(base + [f"c{n}_{k}" for k in range(n - 2)]))]
        rows.append((len(rows), " ".join(base[n // 3 :] + [f"d{n}_{k}" for k in range(n // 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute(rows) <= set(values(neardup.crowded_pairs(neardup.run_sets(df))))
    reps = neardup.signed(df).withColumnRenamed("doc_id", "id")
    every = reps.selectExpr("id as a").join(reps.selectExpr("id as b"), F.expr("a < b"))  # a small table
    assert brute(rows) <= set(values(neardup.possible(every, reps)))


def test_pair_of_distant_signatures(spark):
    texts = ["u221 v221 w221 x221", "u221 v221 w221"]  # half of the runs in common, 31 of 36 components differ, a key in common
    a, b = (neardup.signature(neardup.runs(t, {})) for t in texts)
    assert (a != b).sum() == 31
    assert values(neardup.duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))) == [(0, 1)]


def test_signature_guarantee():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 1 << 31, neardup.COMPONENTS)
        differ = r.permutation(neardup.COMPONENTS)[: (neardup.ALLOWED + 1) * neardup.CHUNKS - 1]
        b = a.copy()
        b[differ] += 1
        wrong = (a != b).reshape(neardup.CHUNKS, neardup.WIDTH).sum(1)
        assert wrong.min() <= neardup.ALLOWED


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = brute(rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in neardup.groups(df).collect()}
    assert set(got) == set(parent) and sum(got[i].group_id == find(i) for i in parent) >= 0.99 * len(parent)
    assert neardup.groups(df.where("false")).count() == 0 and neardup.duplicate_pairs(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(values(neardup.components(links)))
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100


@pytest.mark.parametrize("share", [0, 1 / 1000, 2])
def test_components_around_hubs(spark, monkeypatch, share):
    monkeypatch.setattr(neardup, "HOT", share)
    r = random.Random(6)
    links = [(500, 1000 + i) for i in range(400)] + [(1399, 2), (7, 1000)] + [(3000 + i, 3000 + r.randrange(60)) for i in range(60)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(values(neardup.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_texts_and_blocks():
    known = {}
    h = neardup.runs(" ".join(f"w{i}" for i in range(30_000)), known)
    assert len(h) == 29_998
    whole = (neardup._scramble(h[:, None] * neardup._FACTORS + neardup._TERMS).min(0) >> neardup.np.uint64(32)).astype("uint32").view("int32")
    assert (neardup.signature(h) == whole).all()


def test_texts_hashed_together_are_as_alone(monkeypatch):
    texts = ["a b c d", None, "", "a b", "x y z", "b c d e f b c d", "é ü ö", "a b c d"]
    alone = [neardup.runs(t, {}).tolist() for t in texts]
    assert [len(a) for a in alone] == [2, 0, 0, 0, 1, 5, 1, 2] and alone[0] == alone[-1]
    for go, kept in ((1, 10**6), (5, 2), (10**6, 0)):
        monkeypatch.setattr(neardup, "GO", go)
        monkeypatch.setattr(neardup, "KEPT", kept)
        assert [h.tolist() for h in neardup.all_runs(texts, {})] == alone


def test_a_task_sends_few_rows_of_a_key(spark):
    same = [(i, 5, [7] * neardup.COMPONENTS) for i in range(3000)]
    other = [(5000 + i, 5, list(range(i * 100, i * 100 + neardup.COMPONENTS))) for i in range(300)]
    reps = spark.createDataFrame(same + other, "id long, n int, sig array<int>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        whole, few = values(neardup._keyed(reps)), values(neardup._keyed(reps, 20))
        pairs = neardup.key_pairs(reps, bucket=19).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n_keys = len({k for _, _, k in whole})
    assert len(whole) == 3300 * 36 and n_keys == 36 + 300 * 36 and {k for *_, k in few} == {k for *_, k in whole}
    assert sum(i < 3000 for i, *_ in few) == 36 * 20 and sum(i >= 5000 for i, *_ in few) == 300 * 36
    assert len(pairs) == 36 and all(p.b is None for p in pairs)


def test_keys_are_shared_where_a_chunk_differs_in_one():
    import numpy as np

    a = np.random.default_rng(3).integers(-(1 << 31), 1 << 31, neardup.COMPONENTS).astype(np.int32)
    b = a + 1
    b[4:6] = a[4:6]  # the second chunk differs in its first component alone
    x, y = neardup.chunk_keys(np.stack([a, b]))
    assert len(set(x.tolist()) & set(y.tolist())) == 1 and len(set(x.tolist())) == neardup.CHUNKS * neardup.WIDTH


@pytest.mark.parametrize("size", [1, 1 << 27])
def test_passes_do_the_whole_and_leave_little(spark, rows, monkeypatch, size):
    import os

    from termloom.session import _folder

    monkeypatch.setattr(neardup, "PASS", size, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(_folder(spark)[0]).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    monkeypatch.setattr(neardup, "BUCKET", 8)
    members, links = neardup.similar(df)
    left = {x.partition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left.isdisjoint({"signed", "reps", "near", "keys", "met", "held", "crowd", "crowded", "sets"}) and {"members", "links"} <= left
    reps = dict(values(members, "doc_id", "rep"))
    want = {(a, b) for a, b in brute(rows) if reps[a] == a and reps[b] == b}
    assert len(want - set(values(links, "a", "b"))) <= 0.01 * len(want) and set(values(links, "a", "b")) <= want
