"""Votes and medians: what a document's own rows say most often. Ties go to what was seen first."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, order: list[str]) -> DataFrame:
    """Per keys, the value with the largest total weight; ties to the one whose first row comes first in `order`."""
    totals = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("first"), F.col(value).alias("v")))
    return totals.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(value), (-F.col("_b.w")).alias("weight"))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Per keys, the most frequent value; ties to the one whose first row comes first in `order`."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(value), (-F.col("_b.n")).alias("n"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys, the middle value, of two middle ones the larger; by rank, so no group is gathered into one row."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, value).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("median"), F.col("_n").alias("n"))


def modal_sequence(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Per key, all its values in order as one text, and whether that is the most frequent such text (ties to the
    smallest key). A key is a unit, whose values are a few outcomes."""
    own = df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]), ">").alias("sequence"))
    modal = own.groupBy("sequence").agg(F.count("*").alias("n"), F.min(key).alias("k")).agg(F.min(F.struct((-F.col("n")).alias("n"), "k", F.col("sequence").alias("s"))).alias("_m")).select(F.col("_m.s").alias("modal"))
    return own.join(F.broadcast(modal)).select(key, "sequence", (F.col("sequence") == F.col("modal")).alias("is_modal"))


def unique_labels(df: DataFrame, short: Column, full: Column) -> DataFrame:
    """Adds label: the short form where only one row has it, else the full one."""
    return df.withColumn("_s", short).withColumn("label", F.when(F.count("*").over(Window.partitionBy("_s")) == 1, F.col("_s")).otherwise(full)).drop("_s")
