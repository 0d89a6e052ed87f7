"""Index tables on disk: Parquet, sorted by term for pruning, and a JSON exchange form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(index: DataFrame, path: str, key: str = "term", partitions: int | None = None) -> None:
    """Write an index table range-partitioned and sorted by its key, so that lookups, ranges and prefixes read few row groups."""
    ranged = index.repartitionByRange(partitions, key) if partitions else index.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def export_json(postings: DataFrame, path: str, whole: bool = False) -> None:
    """One JSON object a line: a term and its postings, document to tf; or, where there is no tf, the sorted documents.

    ``whole`` writes a single object of all terms instead, as one file: lines are
    sorted and written by one task, one term at a time, so that none is gathered. For
    exchange with programs that read an index in one piece.
    """
    doc = F.col("doc_id").cast("string")
    if "tf" in postings.columns:
        value = F.map_from_entries(F.sort_array(F.collect_list(F.struct(doc, "tf"))))
    else:
        value = F.sort_array(F.collect_set(doc))
    lines = postings.groupBy("term").agg(value.alias("postings")).orderBy("term")
    if whole:
        key = F.expr("substring(to_json(named_struct('t', term)), 6, length(to_json(named_struct('t', term))) - 6)")
        entries = lines.select("term", F.concat(F.lit(","), key, F.lit(":"), F.to_json("postings")).alias("value"))
        ends = postings.sparkSession.createDataFrame([(0, None, "{"), (2, None, "}")], "part int, term string, value string")
        # the first entry has no comma before it
        first = postings.agg(F.min("term")).scalar()
        entries = entries.select(F.lit(1).alias("part"), "term", F.when(F.col("term") == first, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("value"))
        ends.unionByName(entries).repartition(1).sortWithinPartitions("part", "term").select("value").write.mode("overwrite").text(path)
        return
    lines.select(F.to_json(F.struct("term", "postings")).alias("value")).write.mode("overwrite").text(path)


def _entries_by_line(spark: SparkSession, path: str) -> DataFrame:
    """term and postings of files whose lines, but for the outer braces, each hold whole entries of the one object; a line that doesn't is a row of nulls."""
    line = F.regexp_replace(F.trim("value"), r"^\s*,\s*|\s*,\s*$", "")
    entries = F.from_json(F.concat(F.lit("{"), line, F.lit("}")), "map<string,string>")
    inner = spark.read.text(path).where(~F.trim("value").isin("{", "}", "{}", ""))
    return inner.select(F.explode_outer(entries).alias("term", "postings"))


def import_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """term, doc_id and tf (null for lists) of exported lines, or of files that are one object of terms each (``whole``).

    One object is read by lines, in as many tasks as the file has splits, if each of its
    lines holds whole entries, as ``export_json`` writes them. An object laid out otherwise
    (indented, or all in one line) is taken in one piece.
    """
    if whole:
        rows = _entries_by_line(spark, path)
        if not rows.where("term is null").isEmpty():
            text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
            rows = text.select(F.explode("m").alias("term", "postings"))
    else:
        rows = spark.read.text(path).select(F.get_json_object("value", "$.term").alias("term"), F.get_json_object("value", "$.postings").alias("postings"))
    maps = F.transform(F.map_entries(F.from_json("postings", "map<string,bigint>")), lambda e: F.struct(e["key"].alias("doc_id"), e["value"].alias("tf")))
    lists = F.transform(F.from_json("postings", "array<string>"), lambda d: F.struct(d.alias("doc_id"), F.lit(None).cast("bigint").alias("tf")))
    entries = F.when(F.substring(F.ltrim("postings"), 1, 1) == "[", lists).otherwise(maps)
    return rows.select("term", F.explode(entries).alias("p")).select("term", "p.doc_id", "p.tf")
