"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with one row a key, rows of a null key left out; of differing values the greatest stays, null being the least.

    Keys are counted first, which moves ids only. Rows are brought together only if
    some key is there twice.
    """
    df = df.where(F.col(key).isNotNull())
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return df
    others = [c for c in df.columns if c != key]
    best = F.max(F.struct(value, *(c for c in others if c != value))).alias("best")
    return df.groupBy(key).agg(best).select(*(F.col(key) if c == key else F.col(f"best.{c}").alias(c) for c in df.columns))
