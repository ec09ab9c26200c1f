"""Segmentation over reading order: blocks, parents, sessions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, keys: list[str], order: list[str], starts: Column, block: str = "block") -> DataFrame:
    """Numbers rows by the block that they are in; block 0 is what stands before the first start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(block, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def block_summary(df: DataFrame, keys: list[str], block: str, order: str, text: str) -> DataFrame:
    """Per block: rows, first and last place, characters."""
    return df.groupBy(*keys, block).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.sum(F.char_length(text)).alias("chars"))


def expected_alternatives(tables: DataFrame, title: str, table: str, hours: str) -> DataFrame:
    """Roles of tables that share a title: the one with the most hours is the summary, the others alternatives. With a
    tie for the most, or one table alone, all are summaries."""
    w = Window.partitionBy(title)
    top = F.max(hours).over(w)
    ties = F.sum(F.when(F.col(hours) == F.col("_top"), 1).otherwise(0)).over(w)
    return tables.withColumn("_top", top).withColumn("_ties", ties).select(table, title, hours, F.when((F.col("_ties") == 1) & (F.col(hours) < F.col("_top")), "ALTERNATIVE").otherwise("SUMMARY").alias("role"))


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
