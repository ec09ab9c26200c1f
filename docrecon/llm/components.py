"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import keep


def connected_components(links: DataFrame, max_rounds: int = 60, keep=keep) -> DataFrame:
    """links(a, b) -> (_node, _component), the smallest node that each linked node reaches; ends of links alone are listed.

    A large star hangs each node's larger neighbours on its smallest one, a small star its smaller ones; both keep what
    is connected, and their rounds end, after about log n of them, when each component is one star. Each round is a
    grouping with map-side minima and an equi-join, written to the shared folder. Self-links and repeats are harmless;
    links with a null end are none. keep(df, name) writes a round's table.
    """
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _digest(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("_node"), F.col("v").alias("_component"))
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = keep(small, "links")
        before, state = state, _digest(edges)
        if before == state:
            return edges.select(F.col("u").alias("_node"), F.col("v").alias("_component")).unionAll(edges.select(F.col("v").alias("_node"), F.col("v").alias("_component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
