"""Per-term results that don't hang on a few heavy terms (problem 1).

Eager aggregation through joins: both index tables are aggregated by the join
key before the join, the compact states are joined, counts are multiplied and
sums combined algebraically, and the outcome is rolled up. Spark aggregates
partially before each shuffle, so a term that owns a third of all rows sends one
state a task, whatever its number of rows.

Defined cases, all operators: null terms belong to no result but count as rows
of the table; null doc_ids, positions and lists count as rows and add nothing
else; rows delivered again change row counts only. Empty tables give no rows.
Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Terms with at least this share of all merged postings are laid out in salted blocks; there are at most 1/HEAVY_SHARE of them, so their table may be broadcast.
HEAVY_SHARE = 1 / 1000
#: Mean number of documents in a block of a posting list.
BLOCK_DOCS = 4096


def positional_states(positional: DataFrame) -> DataFrame:
    """One compact state a (term, doc_id): rows and the merged, sorted positions. Rows without a doc_id make one state a term, without positions."""
    placed = F.when(F.col("doc_id").isNotNull(), F.col("positions"))
    return (
        positional.select("term", "doc_id", "positions")
        .where("term is not null")
        .groupBy("term", "doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(placed)))).alias("positions"),
        )
    )


def posting_entries(inverted: DataFrame) -> DataFrame:
    """One row a list entry: term, segment_id, doc_id, tf. Null lists and entries give none."""
    return inverted.select("term", "segment_id", F.explode("posting_list").alias("p")).select(
        "term", "segment_id", F.col("p.doc_id").alias("doc_id"), F.col("p.tf").cast("bigint").alias("tf")
    ).where("doc_id is not null")


def posting_states(inverted: DataFrame) -> DataFrame:
    """One compact state a (term, doc_id): entries, their tf sum, and the merged tf (largest of all deliveries)."""
    return (
        posting_entries(inverted)
        .where("term is not null")
        .groupBy("term", "doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_entries"),
            F.sum("tf").alias("tf_sum"),
            F.max("tf").alias("tf"),
        )
    )


def row_shares(positional: DataFrame, inverted: DataFrame) -> DataFrame:
    """Rows of each term in both tables, and its share of all positional rows.

    Both tables are counted by term first; the compact counts are joined on the
    term. ``pair_rows`` is the number of rows of the plain join of both tables
    on the term: the product of the counts, without that join. Columns:
    term, n_rows, n_list_rows, n_entries, pair_rows, total_rows.
    """
    rows = positional.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    lists = (
        inverted.where("term is not null")
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("n_list_rows"),
            F.sum(F.coalesce(F.size("posting_list"), F.lit(0)).cast("bigint")).alias("n_entries"),
        )
    )
    total = rows.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"))
    joined = rows.where("term is not null").join(lists, "term", "full_outer")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("n_rows", "n_list_rows", "n_entries")}
    return (
        joined.withColumns(zero)
        .withColumn("pair_rows", F.col("n_rows") * F.col("n_list_rows"))
        .withColumn("total_rows", total.scalar())
    )


def joined_states(positional: DataFrame, inverted: DataFrame) -> DataFrame:
    """Both tables reduced to states by (term, doc_id), which no term can make heavy, and the states joined."""
    return positional_states(positional).join(posting_states(inverted), ["term", "doc_id"], "full_outer")


def heavy_terms(positional: DataFrame, inverted: DataFrame, share: float = 0.01) -> DataFrame:
    """Terms with at least ``share`` of all rows of the positional table: ``term``. Rows are summed up by term from the joined states."""
    rows = joined_states(positional, inverted).groupBy("term").agg(F.sum("n_rows").alias("n_rows"))
    total = positional.agg(F.count(F.lit(1)).alias("total_rows")).scalar()
    return rows.where(F.col("n_rows") >= F.lit(Decimal(str(share))) * total).select("term")


def merged_postings(positional: DataFrame, inverted: DataFrame) -> DataFrame:
    """The complete merged index, one row a (term, doc_id), from the joined states.

    Columns: term, doc_id, positions (null where the positional table has none), tf
    (null where no list has the pair), n_rows, n_entries, tf_sum.
    """
    return joined_states(positional, inverted).where("doc_id is not null")


def term_totals(positional: DataFrame, inverted: DataFrame) -> DataFrame:
    """Totals of every term over the merged index, rolled up from joined states.

    Columns: term; n_docs (documents in either table); n_docs_both; n_positions
    (merged); sum_tf (merged); pair_rows (rows of the join of all positional rows
    with all list entries on term and document: products of counts); pair_tf
    (sum of tf over that join: each state's tf sum times the other's row count).
    """
    both = merged_postings(positional, inverted)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("n_rows").isNotNull() & F.col("n_entries").isNotNull()).alias("n_docs_both"),
        zero(F.sum(F.when(F.col("positions").isNotNull(), F.size("positions")).cast("bigint"))).alias("n_positions"),
        zero(F.sum("tf")).alias("sum_tf"),
        zero(F.sum(F.col("n_rows") * F.col("n_entries"))).alias("pair_rows"),
        zero(F.sum(F.col("n_rows") * F.col("tf_sum"))).alias("pair_tf"),
    )


def posting_blocks(positional: DataFrame, inverted: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The complete posting list of every term, in blocks of about ``block_docs`` documents.

    A list of any length is spread over as many rows as it needs; the block of a
    document is a hash of its id. Rows of heavy terms (at most 1/HEAVY_SHARE of them)
    get their block count by broadcast and go straight to their blocks; only those of
    other terms are joined with theirs by term. The merged index is made once, in the
    shared folder. Columns: term, block, n_docs, postings (sorted array of doc_id, tf,
    positions).
    """
    both = stored(merged_postings(positional, inverted).select("term", "doc_id", "tf", "positions"), "merged")
    wide = both.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > block_docs)
    wide = stored(wide.withColumn("blocks", F.ceil(F.col("df") / block_docs).cast("int")), "wide")
    least = HEAVY_SHARE * both.agg(F.count(F.lit(1)).alias("n")).scalar()
    heavy = F.broadcast(wide.where(F.col("df") >= least).select("term", "blocks"))
    middle = wide.where(F.col("df") < least).select("term", "blocks")
    hot = both.join(heavy, "term")
    rest = both.join(heavy, "term", "left_anti").join(middle, "term", "left")
    number = F.conv(F.substring(F.md5(F.col("doc_id").cast("binary")), 1, 8), 16, 10).cast("bigint")
    placed = hot.unionByName(rest).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(number, F.col("blocks"))).otherwise(0).cast("int"))
    return placed.groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.array_sort(F.collect_list(F.struct("doc_id", "tf", "positions"))).alias("postings"),
    )
