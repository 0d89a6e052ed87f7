"""Postings kept up to date from a stream of documents.

Each micro-batch writes the postings of its documents as one folder named by the
batch, replacing what an earlier try of the same batch left, so that a restarted
stream counts nothing twice. Reading merges the batches; of a document delivered
again the latest batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_inverted_index
from ..operators.preprocess import PreprocessConfig


def start(docs: DataFrame, path: str, checkpoint: str, cfg: PreprocessConfig = PreprocessConfig(), **trigger) -> StreamingQuery:
    """Start indexing a streaming frame (doc_id, text) into ``path``."""

    def write(batch: DataFrame, n: int) -> None:
        postings = build_inverted_index(batch, cfg)
        # a document without tokens is kept as a row without a term, so that it replaces what it had
        listed = batch.select("doc_id").distinct().select(F.lit(None).cast("string").alias("term"), "doc_id", F.lit(0).cast("bigint").alias("tf"))
        postings.unionByName(listed).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """term, doc_id and tf over all batches, the latest of each document."""
    rows = spark.read.parquet(path)
    latest = rows.where("term is null").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.where("term is not null").join(latest, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "tf")


def start_windows(events: DataFrame, time: str, value: str, path: str, width: str = "1 hour", late: str = "2 hours", **trigger) -> StreamingQuery:
    """Start counting the values of a streaming frame in windows of event time into ``path``; each batch writes the windows it changed, as they are then."""
    counts = windowed_term_counts(events, time, value, width, late)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/windows/batch={n}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """start, end, value and n of every window, as its latest batch left it."""
    rows = spark.read.parquet(f"{path}/windows")
    value = next(c for c in rows.columns if c not in ("start", "end", "n", "batch"))
    return rows.groupBy("start", "end", value).agg(F.max_by("n", "batch").alias("n"))


def windowed_term_counts(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Occurrences of each value in windows of event time; what is later than ``late`` is left out. For streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), value).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", value, "n")
