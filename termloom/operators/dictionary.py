"""Vocabulary dictionaries: a binary search tree and a sorted list, both as relations.

Inserting keys by ascending priority builds the Cartesian tree of (term, priority).
The priority is a hash of the term, which makes the tree one of random insertion
order yet the same every time. A search visits exactly the terms whose priority is
the least so far when walking away from the key on either side.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import stored

#: Parts at least in which a search looks for the terms it visits, four for each core on larger clusters; each part's are few.
PARTS = 64


def with_priority(vocabulary: DataFrame) -> DataFrame:
    """Distinct term and prio; null terms are none."""
    return vocabulary.select("term").where("term is not null").distinct().withColumn("prio", F.md5(F.col("term").cast("binary")))


def bst_insert(vocabulary: DataFrame, key: str) -> DataFrame:
    """The vocabulary with a key; duplicates are ignored."""
    return vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([(key,)], "term string")).distinct()


def delete(vocabulary: DataFrame, key: str) -> DataFrame:
    """The vocabulary without a key; a missing one is ignored."""
    return vocabulary.where(F.col("term") != key)


def inorder(vocabulary: DataFrame) -> DataFrame:
    """All terms, sorted and distinct."""
    return vocabulary.select("term").where("term is not null").distinct().orderBy("term")


def size(vocabulary: DataFrame) -> DataFrame:
    """One row: size."""
    return vocabulary.agg(F.count_distinct("term").alias("size"))


def bst_search(vocabulary: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """query, found and comparisons (nodes visited) of each key.

    The terms visited are found in hash parts first, each with few, then among
    those; no window sees the whole vocabulary.
    """
    keys = list(dict.fromkeys(keys))
    spark = vocabulary.sparkSession
    parts = parts or max(PARTS, 4 * spark.sparkContext.defaultParallelism)
    tree = with_priority(vocabulary)
    asked = spark.createDataFrame([(k,) for k in keys], "query string").withColumn("own", F.md5(F.col("query").cast("binary")))
    # the keys are a handful given by the caller
    seen = tree.withColumn("query", F.explode(F.array(*map(F.lit, keys)))).withColumn("own", F.md5(F.col("query").cast("binary")))
    hits = seen.where("term = query").select("query", F.lit(True).alias("found"))
    # a key that isn't there never stops the walk
    present = tree.where(F.col("term").isin(keys)).select(F.col("term").alias("query"), F.col("prio").alias("limit"))
    rest = seen.where("term <> query").join(F.broadcast(present), "query", "left").where("limit is null or prio < limit")
    rest = rest.withColumn("below", F.col("term") < F.col("query")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    for by in (["query", "below", "part"], ["query", "below"]):
        down = W.partitionBy(*by).orderBy(F.desc("term")).rowsBetween(W.unboundedPreceding, -1)
        up = W.partitionBy(*by).orderBy("term").rowsBetween(W.unboundedPreceding, -1)
        lower = rest.where("below").withColumn("least", F.min("prio").over(down))
        upper = rest.where("not below").withColumn("least", F.min("prio").over(up))
        rest = lower.union(upper).where("least is null or prio < least").drop("least")
    visited = rest.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return (
        asked.select("query")
        .join(F.broadcast(hits), "query", "left")
        .join(visited, "query", "left")
        .select("query", F.coalesce("found", F.lit(False)).alias("found"), (F.coalesce("n", F.lit(0)) + F.coalesce("found", F.lit(False)).cast("int")).cast("bigint").alias("comparisons"))
    )


def _records(prio: np.ndarray) -> list[int]:
    """Indexes whose value is less than all before."""
    out, least = [], None
    for i, p in enumerate(prio):
        if least is None or p < least:
            out.append(i)
            least = p
    return out


def bst_depths(vocabulary: DataFrame) -> DataFrame:
    """term and depth (1 at the root) of every key.

    The sorted vocabulary is cut in ranges; what a range means to those beside it is
    its few least-so-far priorities seen from either edge. A key's ancestors are the
    least-so-far priorities on its way out, through its own range and then others'.
    """
    ordered = with_priority(vocabulary).repartitionByRange("term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "ordered")

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term", key=lambda s: s.map(lambda t: t.encode()))
        prio = pdf["prio"].to_numpy(object)
        left, right = prio[_records(prio)], prio[::-1][_records(prio[::-1])]
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "side": ["l"] * len(left) + ["r"] * len(right), "place": [*range(len(left)), *range(len(right))], "prio": [*left, *right]})

    # a few tens of priorities a range
    found = ordered.groupBy("part").applyInPandas(edges, "part int, side string, place int, prio string").toPandas().sort_values(["part", "side", "place"])
    parts = sorted(found["part"].unique().tolist())
    from_left = {p: found[(found.part == p) & (found.side == "l")]["prio"].tolist() for p in parts}
    from_right = {p: found[(found.part == p) & (found.side == "r")]["prio"].tolist() for p in parts}

    def chain(order: list[int], lists: dict[int, list[str]]) -> dict[int, list[str]]:
        """For each range the least-so-far priorities of all ranges beyond it, nearest first."""
        out, run = {}, []
        for p in order:
            out[p] = run
            own = lists[p]
            run = own + [x for x in run if x < own[-1]]
        return out

    before, after = chain(parts, from_right), chain(parts[::-1], from_left)

    def depths(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term", key=lambda s: s.map(lambda t: t.encode()))
        prio, part = pdf["prio"].tolist(), int(pdf["part"].iloc[0])
        total = np.ones(len(prio), np.int64)
        for side, outside in ((1, before[part]), (-1, after[part])):
            # outside priorities, nearest first, fall; those less than the least from here to the edge are ancestors
            falling = outside[::-1]
            stack: list[str] = []
            order = range(len(prio)) if side == 1 else range(len(prio) - 1, -1, -1)
            for i in order:
                while stack and stack[-1] > prio[i]:
                    stack.pop()
                # the stack holds this side's ancestors within the range
                least = stack[0] if stack else prio[i]
                total[i] += len(stack) + bisect.bisect_left(falling, min(least, prio[i]))
                stack.append(prio[i])
        return pd.DataFrame({"term": pdf["term"].to_numpy(), "depth": total})

    return ordered.groupBy("part").applyInPandas(depths, "term string, depth bigint")


def tree_stats(vocabulary: DataFrame) -> DataFrame:
    """Property, BST and B-Tree (the sorted list): size, height, ideal height, balance and complexities, six rows in a fixed order."""
    n, h = F.col("size"), F.col("height")
    ideal = F.when(n > 0, F.round(F.log2(n + 1), 2)).otherwise(0.0)
    text = lambda c: c.cast("string")
    # fixed values: names and texts of the table
    rows = (
        ("Vocabulary size", text(n), text(n)), ("Tree height", text(h), F.lit("O(log n)")), ("Ideal log₂(n) height", text(ideal), F.lit("—")),
        ("Is balanced", F.when(F.col("balanced"), "True").otherwise("False"), F.lit("Always")),
        ("Search complexity", F.lit("O(h) worst O(n)"), F.lit("O(log n) guaranteed")), ("Insert complexity", F.lit("O(h)"), F.lit("O(log n)")),
    )
    listed = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("Property"), a.alias("BST"), b.alias("B-Tree")) for i, (p, a, b) in enumerate(rows)))
    return height(vocabulary).select(F.explode(listed).alias("r")).select("r.*").orderBy("ord").select("Property", "BST", "B-Tree")


def height(vocabulary: DataFrame) -> DataFrame:
    """One row: size, height and balanced."""
    return bst_depths(vocabulary).agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.max("depth"), F.lit(0)).alias("height")).withColumn(
        "balanced", (F.col("size") == 0) | (F.col("height") <= 2 * F.log2(F.col("size") + 1))
    )


def sorted_search(vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """query, found and idx, the number of terms less than the key, in one aggregate."""
    keys = list(dict.fromkeys(keys))
    counts = [F.count_if(F.col("term") < k).alias(f"i{n}") for n, k in enumerate(keys)] + [F.coalesce(F.bool_or(F.col("term") == k), F.lit(False)).alias(f"f{n}") for n, k in enumerate(keys)]
    one = vocabulary.select("term").distinct().agg(*counts)
    rows = F.array(*(F.struct(F.lit(k).alias("query"), F.col(f"f{n}").alias("found"), F.col(f"i{n}").alias("idx")) for n, k in enumerate(keys)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def range_query(vocabulary: DataFrame, lo: str, hi: str) -> DataFrame:
    """Terms from lo to hi, both included, sorted; none where lo > hi."""
    return vocabulary.where(F.col("term").between(lo, hi)).select("term").distinct().orderBy("term")


def prefix_search(vocabulary: DataFrame, prefix: str, compat: str = "documented") -> DataFrame:
    """Terms that start with the prefix, sorted; all for an empty one.

    compat="observed" also finds the prefix with its last character raised by one,
    and fails where that can't be raised.
    """
    if compat != "observed" or not prefix:
        return vocabulary.where(F.col("term").startswith(prefix)).select("term").distinct().orderBy("term")
    return range_query(vocabulary, prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1))


class Dictionary:
    """Mutable-looking handle on a vocabulary: each change gives a new relation."""

    def __init__(self, vocabulary: DataFrame):
        self.vocabulary = vocabulary

    def insert(self, key: str) -> Dictionary:
        return Dictionary(bst_insert(self.vocabulary, key))

    def delete(self, key: str) -> Dictionary:
        return Dictionary(delete(self.vocabulary, key))

    def all_terms(self) -> DataFrame:
        return inorder(self.vocabulary)


def benchmark(vocabulary: DataFrame, keys: list[str], n_repeats: int = 1) -> pd.DataFrame:
    """Found, steps and mean milliseconds of both searches, one run for all keys; which is faster is Tie where equal."""
    import time

    def timed(make) -> tuple[list, float]:
        t = time.perf_counter()
        for _ in range(n_repeats):
            rows = make().collect()  # one row a key
        return rows, round((time.perf_counter() - t) * 1000 / n_repeats / max(1, len(keys)), 6)

    tree, tree_ms = timed(lambda: bst_search(vocabulary, keys))
    flat, flat_ms = timed(lambda: sorted_search(vocabulary, keys))
    by = {r["query"]: r for r in flat}
    faster = "Tie" if tree_ms == flat_ms else "BST" if tree_ms < flat_ms else "B-Tree"
    mark = lambda found: "✅" if found else "❌"
    return pd.DataFrame(
        [
            {"Query": r["query"], "Found (BST)": mark(r["found"]), "BST Time (ms)": tree_ms, "BST Steps": r["comparisons"], "Found (B-Tree)": mark(by[r["query"]]["found"]), "B-Tree Time (ms)": flat_ms, "Faster": faster}
            for r in tree
        ]
    )
