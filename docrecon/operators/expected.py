"""Expected summary rows matched with units: each step takes a match only where it is the only one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _alone(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys the number of distinct values and the smallest; null keys are left out."""
    held = df.select(*keys, value).dropna(subset=keys).distinct()
    return held.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias(value))


def unique_match(units: DataFrame, rows: DataFrame, keys: list[str], unit: str, row: str) -> DataFrame:
    """Pairs (unit, row) by keys where neither side has a second candidate. Null keys match nothing. Both sides are
    counted before they meet, so a key meets in one row."""
    a, b = _alone(units, keys, unit).filter("_n = 1").drop("_n"), _alone(rows, keys, row).filter("_n = 1").drop("_n")
    return a.join(b, keys).select(unit, row)


def ambiguous_rows(units: DataFrame, rows: DataFrame, keys: list[str], unit: str, row: str) -> DataFrame:
    """Units whose keys have rows but no single pair, with how many rows and units share the keys: EXPECTED_ROW_AMBIGUOUS."""
    a, b = _alone(units, keys, unit).withColumnRenamed("_n", "units").drop(unit), _alone(rows, keys, row).withColumnRenamed("_n", "rows").drop(row)
    shared = a.join(b, keys).filter("units > 1 or rows > 1")
    return units.select(unit, *keys).distinct().join(shared, keys).select(unit, "units", "rows", F.lit("EXPECTED_ROW_AMBIGUOUS").alias("code"), F.lit("INFO").alias("severity"))


def match_expected(units: DataFrame, rows: DataFrame, context: str, name: str, place: str, unit: str, row: str) -> DataFrame:
    """Each unit with its expected row and how it was found: by name within the context, else by place, else not."""
    by_name = unique_match(units, rows, [context, name], unit, row).withColumnRenamed(row, "_name")
    rest = rows.join(by_name, F.col(row) == F.col("_name"), "left_anti")
    by_place = unique_match(units.join(by_name, unit, "left_anti"), rest, [context, place], unit, row).withColumnRenamed(row, "_place")
    joined = units.select(unit).join(by_name, unit, "left").join(by_place, unit, "left")
    return joined.select(unit, F.coalesce("_name", "_place").alias(row), F.when(F.col("_name").isNotNull(), "name").when(F.col("_place").isNotNull(), "place").otherwise("none").alias("how"))


def missing_units(rows: DataFrame, matched: DataFrame, context: str, row: str) -> DataFrame:
    """Expected rows without a unit, in contexts that have at least one matched row."""
    used = matched.filter(F.col(row).isNotNull()).select(row)
    contexts = rows.join(used, row, "left_semi").select(context).distinct()
    return rows.join(used, row, "left_anti").join(contexts, context, "left_semi")
