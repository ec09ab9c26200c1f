"""Segments within a unit: outcomes with their components, and applications by header rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.operators.layout import color_distance
from docrecon.operators.scans import kept
from docrecon.operators.votes import first_seen_mode
from docrecon.shipping import ship


def nested_items(rows: DataFrame, keys: list[str], order: list[str], outer: Column, inner: Column) -> DataFrame:
    """Numbers rows by the outer item that they are in (0 before the first) and by the inner one within it (0 for the
    outer item's own rows). A row that starts both starts the outer one."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("outer_pos", F.sum(F.when(outer, 1).otherwise(0)).over(run))
    within = Window.partitionBy(*keys, "outer_pos").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("inner_pos", F.sum(F.when(inner & ~outer, 1).otherwise(0)).over(within))


def item_texts(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Per item its rows joined by newlines in order; an item is as large as a text block of a page."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def first_section(rows: DataFrame, unit: str, section: str, pos: str, matches: Column) -> DataFrame:
    """Kind of each section: the unit's first one whose first row matches holds its outcomes, later ones with a match
    its applications, earlier ones and those without a match are other."""
    heads = rows.groupBy(unit, section).agg(F.min(F.struct(pos, matches.alias("m"))).alias("h"), F.max(matches.cast("int")).alias("_any"))
    first = F.min(F.when(F.col("h.m"), F.col("h")[pos])).over(Window.partitionBy(unit))
    kind = F.when(F.col("h")[pos] == F.col("_f"), "learning_outcomes").when((F.col("h")[pos] > F.col("_f")) & (F.col("_any") == 1), "applications").otherwise("other")
    return heads.withColumn("_f", first).select(unit, section, F.coalesce(kind, F.lit("other")).alias("kind"))


def title_runs(spans: DataFrame, keys: list[str], order: str, color: str, text: str, tolerance: int = 10, block: int = 1024) -> DataFrame:
    """Runs of spans whose colour is within the tolerance of the run's first, per keys (a row of a page): keys, run, text.

    Members of a run are at most twice the tolerance apart, so spans are first cut where neighbours are further apart; each
    piece is folded by itself in order, which carries the run at hand alone, and its runs are numbered on from those of the pieces
    before it. Blocks of the order give one cut each, so a key may hold any share of all spans; what stays in one task is a piece. A span without colour is a run of its own.
    The order is a number; a null one stands first.
    """
    placed = spans.select(F.struct(*keys).alias("_k"), F.col(order).alias("_o"), F.col(color).cast("long").alias("_c"), F.col(text).alias("_t"))
    placed = placed.withColumns({"_b": F.floor(F.col("_o") / block), "_at": F.struct("_o", "_c")})
    # the first place of each block where neighbours are apart, and that of the blocks before; texts take no part
    before = F.lag(F.struct("_c")).over(Window.partitionBy("_k", "_b").orderBy("_at"))
    apart = F.col("_before").isNotNull() & F.coalesce(color_distance(F.col("_c"), F.col("_before._c")) > 2 * tolerance, F.lit(True))
    cuts = placed.select("_k", "_b", "_at", "_c").withColumn("_before", before).groupBy("_k", "_b").agg(F.min(F.when(apart, F.col("_at"))).alias("_cut"))
    so_far = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(F.col("_k").alias("_bk"), F.col("_b").alias("_bb"), "_cut", F.last("_cut", ignorenulls=True).over(so_far).alias("_open"))
    piece = F.when(F.col("_at") >= F.col("_cut"), F.col("_cut")).otherwise(F.col("_open"))
    pieces = placed.join(cuts, F.expr("_k <=> _bk and _b <=> _bb")).select("_k", piece.alias("_piece"), "_o", "_c", "_t")
    ordered = pieces.repartition("_k", "_piece").sortWithinPartitions("_k", "_piece", "_o", "_c", "_t")
    schema = ordered.select("_k", "_piece", F.lit(0).alias("_n"), F.col("_t").alias("text")).schema

    def run(batches):
        import pyarrow as pa

        piece, first, number, parts, kinds = None, None, 0, [], None

        def near(a: int | None, b: int | None) -> bool:
            return a is not None and b is not None and max(abs((a >> s & 255) - (b >> s & 255)) for s in (16, 8, 0)) <= tolerance

        def made(rows):
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["_k", "_piece", "_n", "text"])

        for batch in batches:
            kinds, rows = [batch.schema.field("_k").type, batch.schema.field("_piece").type, pa.int32(), pa.string()], []
            for k, p, c, t in zip(*(batch.column(n).to_pylist() for n in ("_k", "_piece", "_c", "_t")), strict=True):
                if parts and (k, p) == piece and near(first, c):
                    parts.append(t or "")
                    continue
                if parts:
                    rows.append((*piece, number, " ".join(parts)))
                number = number + 1 if parts and (k, p) == piece else 0
                piece, first, parts = (k, p), c, [t or ""]
            yield made(rows)
        if parts:
            yield made([(*piece, number, " ".join(parts))])

    ship(spans.sparkSession)
    runs = kept(ordered.mapInArrow(run, schema), "runs")
    ends = runs.groupBy("_k", "_piece").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(Window.partitionBy("_k").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(F.col("_k").alias("_ek"), F.col("_piece").alias("_ep"), F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = runs.join(ends, F.expr("_k <=> _ek and _piece <=> _ep"))
    return numbered.select("_k.*", (F.col("_n") + F.col("_before")).cast("int").alias("run"), "text")


def unlabelled_applications(rows: DataFrame, sections: DataFrame, doc: str, unit: str, section: str, pos: str, code_only: str) -> DataFrame:
    """Rows of applications that stand in a section of another label: rows' columns, for those from the section's first line
    with nothing but a code on; what is before them is no application.

    The label of applications is a document's own: the most frequent one (ties: seen first) of application sections that
    begin with such a line. sections(doc, unit, section, kind, key); a null key is a label of its own. A document without such a
    section learns no label, and none of its rows move; nor do those of a section without such a line.
    """
    at = [doc, unit, section]
    heads = rows.groupBy(*at).agg(F.min(pos).alias("_head"), F.min(F.when(F.col(code_only), F.col(pos))).alias("_code"))
    held = kept(sections.filter("kind = 'applications'").select(*at, "key").join(heads, at), "applications")
    label = first_seen_mode(held.filter("_head = _code"), [doc], "key", [unit, section]).select(doc, F.col("key").alias("_label"))
    moved = held.join(label, doc).filter(~F.col("key").eqNullSafe(F.col("_label")) & F.col("_code").isNotNull()).select(*at, "_code")
    return rows.join(moved, at).filter(F.col(pos) >= F.col("_code")).select(*rows.columns)
