"""Filling containers of fixed capacity with whole documents (problem 7).

Harmonic packing: a size s belongs to the class k = capacity // s, whose containers
take exactly k documents of the class and no other count. k of them always fit, and
one more of the class never would. Workers fill containers independently, each over
its own shard of about SHARD_ITEMS documents, class by class from the largest sizes.
The space that a container's k documents leave is topped up with the largest
documents of smaller classes that fit.

What is over when a class's documents don't make up another k stays open: less than
one container a class and shard, whatever the shard holds. Only the open containers
of MERGE shards are packed again together, and so on until one group is left or a
round saves no container; a task never gets more than MERGE shards' open ones.

Only a document larger than a container is split: into full containers of its own
and a rest that is packed like any document.

Defined cases: null and empty texts have size 0 and lie in some container of their
shard, or in an empty one; repeated rows are items of their own; documents of
exactly the capacity aren't split; only ``doc_id`` and ``text`` are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tokens import sized

CAPACITY = 2048
#: Mean number of documents that one worker packs at a time.
SHARD_ITEMS = 20_000
#: Shards of one round that become one in the next.
MERGE = 16


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The container number of each item of a shard, and which containers are open: of fewer items of their class than it takes, and not full.

    Sizes are 0 to capacity; items of 0 go to container 0.
    """
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    sorted_sizes = sizes[order]
    taken = np.zeros(len(order), bool)
    # where each size begins in the order, for the largest item that fits a space
    begin = np.searchsorted(-sorted_sizes, -np.arange(capacity + 1)).tolist()
    after = list(range(len(order) + 1))  # the next item that isn't taken, itself or later

    def free(at: int) -> int:
        """The first item from ``at`` on that isn't taken."""
        end = at
        while after[end] != end:
            end = after[end]
        while after[at] != end:
            after[at], at = end, after[at]
        return end

    out = np.zeros(len(sizes), np.int64)
    kinds = capacity // np.maximum(sorted_sizes, 1)
    number, is_open = 0, []
    for k in np.unique(kinds).tolist():
        first, end = np.searchsorted(kinds, [k, k + 1]).tolist()
        own = first + np.flatnonzero(~taken[first:end])
        for at in range(0, len(own), k):
            lot = own[at : at + k]
            taken[lot] = True
            for i in lot.tolist():
                after[i] = i + 1
            out[order[lot]] = number
            room = capacity - int(sorted_sizes[lot].sum())
            while room > 0 and (i := free(max(end, begin[room]))) < len(order):
                taken[i], after[i] = True, i + 1
                out[order[i]] = number
                room -= int(sorted_sizes[i])
            is_open.append(len(lot) < k and room > 0)
            number += 1
    return out, np.array(is_open, bool)


def placed(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``packed`` with ``row``, a number of each row of ``documents``."""
    sizes = stored(sized(documents), "sizes").withColumn("row", F.monotonically_increasing_id())
    whole = F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(F.lit(0))
    rest = F.col("n_tokens") - F.col("whole") * capacity
    sizes = sizes.withColumn("whole", whole.cast("bigint")).withColumn("rest", rest)
    pieces = (F.col("whole") + F.when((F.col("rest") > 0) | (F.col("n_tokens") == 0), 1).otherwise(0)).alias("pieces")
    full = (
        sizes.where("whole > 0")
        .select("doc_id", "n_tokens", "row", "whole", pieces, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
        .select(
            "doc_id", "row", "n_tokens", F.col("piece").cast("int").alias("piece"), F.col("pieces").cast("int"),
            (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("size"),
            F.concat_ws("/", F.lit("own"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("container"),
        )
    )
    items = sizes.where("rest > 0 or n_tokens = 0").select(
        "doc_id", "n_tokens", "row", F.col("whole").cast("int").alias("piece"), pieces, (F.col("whole") * capacity).alias("start"), F.col("rest").alias("size")
    ).withColumn("pieces", F.col("pieces").cast("int"))
    schema = "doc_id bigint, n_tokens bigint, row bigint, piece int, pieces int, start bigint, size bigint, container string, open boolean"
    groups = max(1, -(-items.count() // shard_items))
    done, level, before = [full], 0, None
    while True:
        here = level

        def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
            shard = shard.sort_values(["doc_id", "row", "piece"], kind="stable", ignore_index=True)
            number, is_open = pack(shard["size"].to_numpy(np.int64), capacity)
            shard["container"] = [f"{here}/{key[0]}/{n}" for n in number]
            shard["open"] = is_open[number] if len(is_open) else False
            return shard.drop(columns="shard")

        # at level 0 shards are drawn by a hash, then MERGE of them make a group, as a shard's open containers are few
        filled = stored(
            items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).groupBy("shard").applyInPandas(run, schema),
            f"packed{level}",
        )
        done.append(filled.where("not open").select(full.columns))
        still = filled.where("open")
        n = still.select("container").distinct().count()
        if groups == 1 or n == 0 or before is not None and filled.select("container").distinct().count() >= before:
            done.append(still.select(full.columns))
            break
        items, groups, level, before = still.drop("container", "open"), -(-groups // MERGE), level + 1, n
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def packed(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every document in its container, one row a piece.

    Columns: doc_id, n_tokens (of the document), piece (from 0), pieces, start
    (first token of the piece), size (its tokens), container.
    """
    return placed(documents, capacity, shard_items).drop("row")


def split_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id of every document that must be split: those that lie in more than one container when all are packed."""
    return placed(documents, capacity).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").distinct()


def containers(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How full the containers are: number of containers, tokens, the least number that could hold them, mean fill."""
    bins = packed(documents, capacity).groupBy("container").agg(F.sum("size").alias("fill"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least"),
        F.max("fill").alias("fullest"),
        F.round(F.avg("fill") / capacity, 6).alias("mean_fill"),
    )
