"""Documents from files, samples and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.types import StringType

FORM = "doc_id string, text string, doc_ord bigint"
#: The sample documents.
SAMPLE = (
    "Information retrieval finds documents that satisfy an information need.",
    "A search engine is a well-known software system that answers web queries.",
    "Stemming reduces inflected words to their stem; lemmatization maps them to a dictionary form.",
    "Cold-chain storage keeps vaccines stable; the long-term follow-up found no loss (p < 0.05).",
    "The boolean operators AND, OR and NOT combine posting lists.",
    "A cross-sectional survey (n = 412) asked students’ and nurses’ views: 63% ± 4% would be vaccinated again; costs & side-effects mattered most.",
    "COVID-19 case counts fell by 18%; the author’s cost-free clinics reached women’s shelters, schools & prisons.",
    "Phrase queries need positions: information retrieval isn’t retrieval information.",
)


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def read_uploads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text and CSV files as documents, one a file, whole: doc_id is the file's name, invalid UTF-8 is passed over, the first file of a name wins.

    Order is by a hash of the path. Files of no bytes, which scans pass over, are no documents.
    """
    files = spark.read.format("binaryFile").load(paths)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "path", "content")
    # metadata only decides which file of a name is the first
    first = named.select("doc_id", "path").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("path"))).where("n = 1").select("path")
    return named.join(first, "path", "left_semi").select("doc_id", _decoded("content").alias("text"), F.xxhash64("path").alias("doc_ord"))


def read_rows(spark: SparkSession, path: str, id_column: str, text_column: str) -> DataFrame:
    """A CSV file with a header, one document a row."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("doc_ord"))


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``docs`` with ``new`` put in; of equal doc_id the new one stays."""
    return docs.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def sample_documents(spark: SparkSession) -> DataFrame:
    """A small collection of eight documents to try things on: hyphens, curly quotes, percentages, signs and operators in prose."""
    return spark.createDataFrame([(f"sample{i}.txt", t, i) for i, t in enumerate(SAMPLE)], FORM)


def clear(docs: DataFrame) -> DataFrame:
    """An empty collection of the same columns; what was kept of ``docs`` is let go."""
    docs.unpersist()
    return docs.where(F.lit(False))
