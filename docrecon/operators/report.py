"""Results as they are handed on: rows without repeats, issue groups, a wide grid, nested JSON."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank_repeats(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Group columns on the first row of each group alone, as spreadsheets with merged cells show them; a level is
    blanked only below a blanked or equal level above."""
    out = rows
    for i in range(len(groups), 0, -1):
        first = F.row_number().over(Window.partitionBy(*groups[:i]).orderBy(*order)) == 1
        out = out.withColumn(f"_b{i}", first)
    for i, g in enumerate(groups, 1):
        out = out.withColumn(f"shown_{g}", F.when(F.col(f"_b{i}"), F.col(g)))
    return out.drop(*[f"_b{i}" for i in range(1, len(groups) + 1)])


def issue_groups(findings: DataFrame, names: DataFrame, file: str, code: str) -> DataFrame:
    """Codes folded into issue groups by names(code, issue), unknown codes as themselves: issue, files, total."""
    named = findings.join(names, code, "left").withColumn("issue", F.coalesce("issue", code))
    return named.groupBy("issue").agg(F.countDistinct(file).alias("files"), F.count("*").alias("total"))


def wide_grid(cells: DataFrame, keys: list[str], header: str, headers: list[str], value: Column) -> DataFrame:
    """One row per keys, one column per header. The headers are given, so no pass is needed to find them."""
    return cells.groupBy(*keys).pivot(header, headers).agg(F.min(value))


def nested_json(units: DataFrame, items: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per unit a JSON text with its items in order."""
    packed = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("items"))
    return units.join(packed, key, "left").select(key, F.to_json(F.struct(F.col(key), F.transform(F.coalesce("items", F.array().cast(packed.schema["items"].dataType)), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("items"))).alias("json"))
