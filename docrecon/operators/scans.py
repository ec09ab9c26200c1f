"""Scans over rows in an order, for state that runs on: what a row carries from the rows before it.

A key's rows are cut into blocks (pages of a document). Each block is scanned by itself, and what it hands on is one row, so
a key with any share of all rows is the work of many tasks; only the rows of blocks, one each, are scanned per key. A scan
reads its rows twice, so what several scans in a row build on is written once (kept).
"""

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.shipping import shared_folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as written to the folder that all executors share and read back; lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(keys: list[str], block: str):
    within = Window.partitionBy(*keys, block)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return within, before


def _joined(rows: DataFrame, ends: DataFrame, on: list[str]) -> DataFrame:
    other = ends.withColumnsRenamed({c: f"_at_{c}" for c in on})
    return rows.join(other, F.expr(" and ".join(f"{c} <=> _at_{c}" for c in on))).drop(*(f"_at_{c}" for c in on))


def carried(rows: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, Column], *, inclusive: bool = True) -> DataFrame:
    """Adds for each of values its last value that is not null in the order (block, then order) up to a row, its own
    included or not. The order must tell rows of a block apart."""
    within, before = _blocks(keys, block)
    so_far = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    marked = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    ends = marked.groupBy(*keys, block).agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in values))
    ends = ends.select(*keys, block, *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values))
    scanned = marked.withColumns({f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(so_far) for n in values})
    found = _joined(scanned, ends, [*keys, block]).withColumns({n: F.coalesce(f"_w_{n}", f"_c_{n}") for n in values})
    return found.drop(*(f"_{s}_{n}" for n in values for s in "vwc"))


def counted(rows: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each condition how many rows up to a row, its own included, meet it."""
    within, before = _blocks(keys, block)
    so_far = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({f"_v_{n}": F.when(c, 1).otherwise(0) for n, c in values.items()})
    ends = marked.groupBy(*keys, block).agg(*(F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values))
    ends = ends.select(*keys, block, *(F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values))
    scanned = marked.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(so_far) for n in values})
    found = _joined(scanned, ends, [*keys, block]).withColumns({n: F.col(f"_w_{n}") + F.col(f"_c_{n}") for n in values})
    return found.drop(*(f"_{s}_{n}" for n in values for s in "vwc"))
