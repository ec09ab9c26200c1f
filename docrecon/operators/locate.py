"""From findings to places: boxes of span ids, lines that stand once, and the first place of a chain of fallbacks."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span_boxes(fields: DataFrame, spans: DataFrame, key: str, ids: str, span: str, page: str) -> DataFrame:
    """Per field and page: the box around its spans and their number. Ids without a span are left out."""
    named = fields.select(key, F.explode(ids).alias(span)).distinct()
    return named.join(spans, span).groupBy(key, page).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("spans"))


def only_place(lines: DataFrame, keys: list[str], text: str, page: str) -> DataFrame:
    """Texts that stand at exactly one place of their keys, with the page."""
    return lines.groupBy(*keys, text).agg(F.count("*").alias("_n"), F.min(page).alias(page)).filter("_n = 1").drop("_n")


def first_place(findings: DataFrame, chain: list[tuple[str, DataFrame]], key: str, place: str) -> DataFrame:
    """Each finding with its place from the first source of the chain that has one, and that source's name."""
    sources = [d.groupBy(key).agg(F.min(place).alias(f"_{i}")) for i, (_, d) in enumerate(chain)]
    joined = reduce(lambda a, b: a.join(b, key, "left"), sources, findings)
    names = reduce(lambda c, i: c.when(F.col(f"_{i}").isNotNull(), chain[i][0]), range(1, len(chain)), F.when(F.col("_0").isNotNull(), chain[0][0]))
    return joined.select(*findings.columns, F.coalesce(*[f"_{i}" for i in range(len(chain))]).alias(place), names.otherwise("none").alias("source"))
