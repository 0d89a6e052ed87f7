"""Exact counts of every distinct term, and marks on the too rare and too common (problem 5).

Recursive radix spilling: list entries go to the shared folder in partitions by the
first bits of a hash of their term. A partition of more rows than a worker should
take is split by the next bits, as many as its own size asks for; where bits of the
term no longer help, as for one term that owns a large part of all rows, by bits of a
hash of the document, over which distinct documents and occurrences just add up.
DuckDB then aggregates each partition out of core, reading its files as a stream
within a memory limit and spilling to the shared folder; on an object store, where
it can't spill, in as many passes over parts of the documents as the size asks for.
Every row is counted; nothing is estimated.

With the input the size of a partition grows rather than their number: a round makes
at most 4 * MOST_PARTITIONS of them, which is all that the driver ever lists.

Defined cases: null terms count for the documents of the whole table but are no
term; null lists and null entries add nothing; rows delivered twice and documents
indexed again count once a document, with the tf of the latest segment (the larger
within one segment); a null tf counts as 0 occurrences; terms without any posting
have no row; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

#: Most bits by which one round splits a partition, and bits by which it splits beyond what even parts would need.
MOST_BITS, MORE_BITS = 12, 1
#: Rounds that split by the term before the document's hash is used, and rounds at most; after them a partition holds but repeats of single pairs.
TERM_ROUNDS, MOST_ROUNDS = 2, 6
#: Rows of a partition beyond which it is split further, at least, and the number of partitions of that size beyond which larger ones are allowed.
PARTITION_ROWS, MOST_PARTITIONS = 500_000, 1 << 14
#: Memory of DuckDB in one task.
MEMORY = "400MB"
#: Terms of so many documents or fewer are rare, of more than this share of all documents common.
RARE, COMMON = 2, 0.30

_AGGREGATE = """
    select term, count(*)::bigint as doc_frequency, sum(tf)::bigint as occurrences, sum(n)::bigint as deliveries
    from (select term, doc_id, arg_max(coalesce(tf, 0), segment_id::bigint * 4294967296 + coalesce(tf, 0)) as tf, count(*) as n
          from entries where {part} group by term, doc_id)
    group by term
"""


def entries(inverted: DataFrame) -> DataFrame:
    """List entries as they are: term, doc_id, segment_id (-1 where null) and tf. Hashes are made from them when needed and not stored."""
    return (
        inverted.where("term is not null")
        .select("term", F.coalesce("segment_id", F.lit(-1)).cast("int").alias("segment_id"), F.explode("posting_list").alias("p"))
        .select("term", F.col("p.doc_id").alias("doc_id"), "segment_id", F.col("p.tf").cast("int").alias("tf"))
        .where("doc_id is not null")
    )


def _bits(rows, partition_rows: int):
    """Bits by which so many rows are split; for a column or a number of rows."""
    if isinstance(rows, int):
        return min(MOST_BITS, max(0, math.ceil(math.log2(max(1, rows / partition_rows)))) + MORE_BITS)
    return F.least(F.lit(MOST_BITS), F.ceil(F.log2(rows / partition_rows)) + MORE_BITS).cast("int")


def _spill(rows: DataFrame, path: str, of: str, seed: int) -> None:
    """Write ``rows`` under ``path`` in folders by the next ``bits`` (a column) of a hash of ``of``; a partition already there is refined."""
    digit = F.expr(f"string(shiftrightunsigned(xxhash64({seed}, {of}), 64 - bits))")
    named = F.concat_ws("-", F.col("bucket"), digit) if "bucket" in rows.columns else digit
    # rebalancing splits a partition that is too large for one task and joins small ones
    rows.withColumn("bucket", named).drop("bits").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def partitions(inverted: DataFrame, partition_rows: int = PARTITION_ROWS) -> list[tuple[str, int]]:
    """Spill the entries; the folders with their rows, at most ``partition_rows`` each or the share of all rows that keeps them few (more only where one pair of term and document has more)."""
    spark = inverted.sparkSession
    total = inverted.agg(F.sum(F.size("posting_list").cast("bigint"))).first()[0] or 0
    partition_rows = max(partition_rows, total // MOST_PARTITIONS)
    rows, done = entries(inverted).withColumn("bits", F.lit(_bits(total, partition_rows))), []
    parted: list[str] = []
    for round_ in range(MOST_ROUNDS):
        path = scratch(spark, f"radix{round_}")
        _spill(rows, path, "term" if round_ < TERM_ROUNDS else "doc_id", round_)
        if not _has_files(spark, path):
            return done
        table = spark.read.option("basePath", path).parquet(path).withColumn("bucket", F.col("bucket").cast("string"))
        # a partition of x times the rows it may have is split in at most 4 * x parts, and all x add up to MOST_PARTITIONS at most
        counts = {r[0]: r[1] for r in table.groupBy("bucket").count().collect()}
        large = [(b, n) for b, n in counts.items() if n > partition_rows and round_ + 1 < MOST_ROUNDS]
        again = {b for b, _ in large}
        done += [(f"{path}/bucket={b}", n) for b, n in counts.items() if b not in again]
        for folder in parted:
            _delete(spark, folder)
        parted = [f"{path}/bucket={b}" for b in again]
        if not large:
            return done
        # fewer than MOST_PARTITIONS rows, hence broadcast
        split = spark.createDataFrame(large, "bucket string, n bigint").select("bucket", _bits(F.col("n"), partition_rows).alias("bits"))
        rows = table.join(F.broadcast(split), "bucket")
    return done


def _delete(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _has_files(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(s.isDirectory() and s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p))


def counted(inverted: DataFrame, partition_rows: int = PARTITION_ROWS, memory: str = MEMORY) -> DataFrame:
    """doc_frequency, occurrences and deliveries (list entries, repeats included) of every term."""
    spark = inverted.sparkSession
    folders = partitions(inverted, partition_rows)
    spill = scratch(spark, "duckdb")
    schema = "term string, doc_frequency bigint, occurrences bigint, deliveries bigint"
    if not folders:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for folder, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = fs.FileSystem.from_uri(folder)
                if isinstance(system, fs.LocalFileSystem):  # a mounted shared folder
                    yield from aggregated(f"read_parquet('{path}/*.parquet', hive_partitioning = false)", None, fs.FileSystem.from_uri(spill)[1], memory)
                else:
                    yield from aggregated(ds.dataset(path, filesystem=system, format="parquet"), -(-rows // PARTITION_ROWS), None, memory)

    n = max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    parts = spark.createDataFrame(folders, "folder string, n bigint").repartition(n)
    # a term split by document comes from several partitions
    return parts.mapInArrow(run, schema).groupBy("term").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("doc_frequency", "occurrences", "deliveries")))


def aggregated(source, passes: int | None, spill: str | None, memory: str) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of one partition, a term once for each pass. source: an SQL source or a dataset of Arrow; passes: parts by document to go through one by one; spill: where DuckDB may spill to, or None for nowhere."""
    import os
    import shutil
    import uuid

    import duckdb

    own = None if spill is None else f"{spill}/{uuid.uuid4().hex}"
    try:
        with duckdb.connect() as con:
            con.execute(f"set memory_limit = '{memory}'")
            con.execute("set threads = 1")
            con.execute("set preserve_insertion_order = false")
            if own:
                os.makedirs(own, exist_ok=True)
            con.execute(f"set temp_directory = '{own or ''}'")
            if isinstance(source, str):
                con.execute(f"create view entries as from {source}")
            else:
                con.register("entries", source)
            for k in range(passes or 1):
                reader = con.sql(_AGGREGATE.format(part=f"hash(doc_id) % {passes} = {k}" if passes and passes > 1 else "true")).to_arrow_reader(50_000)
                for out in reader:
                    yield out.cast(_SCHEMA) if out.schema != _SCHEMA else out
    finally:
        if own:
            shutil.rmtree(own, ignore_errors=True)


_SCHEMA = pa.schema([("term", pa.string()), ("doc_frequency", pa.int64()), ("occurrences", pa.int64()), ("deliveries", pa.int64())])


def documents_of(inverted: DataFrame) -> DataFrame:
    """One row: n_all, the distinct documents of all lists, those of null terms included."""
    ids = inverted.select(F.explode(F.array_distinct(F.transform("posting_list", lambda p: p.doc_id))).alias("doc_id"))
    return ids.where("doc_id is not null").distinct().agg(F.count(F.lit(1)).alias("n_all"))


def marked(inverted: DataFrame, rare: int = RARE, common: float = COMMON, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Counts of every term and its mark: ``rare``, ``common`` or null. Columns: term, doc_frequency, occurrences, deliveries, n_all, mark."""
    n = F.col("doc_frequency")
    mark = F.when(n <= rare, "rare").when(n > F.lit(Decimal(str(common))) * F.col("n_all"), "common")
    return counted(inverted, partition_rows).withColumn("n_all", documents_of(inverted).scalar()).withColumn("mark", mark)
