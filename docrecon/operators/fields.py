"""Fields as texts of spans: rows joined with a space where the page shows one, and for each span which characters of the
field it gave. Spans are (field, row, x0, x1, size, id, text, page); a field is as large as a block of a page."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# White space as regular expressions of one byte a character have it.
SPACE = " \t\n\x0b\f\r"


def span_offsets(spans: DataFrame) -> DataFrame:
    """Per span: field, row, id, page, start and end in the field's text (from 0, end excluded), and piece, what the span
    adds to its row. A gap wider than 0.15 of the span's size is one space unless a side has one; rows lose the white
    space at their ends and are joined by newlines. Empty spans are left out.

    Spans are dealt out by field and sorted once, and all windows go by that order; the page stands in it, so that every use of
    the offsets reads the same exchange."""
    bare = lambda cut: F.char_length("text") - F.char_length(cut("text", F.lit(SPACE)))
    in_row = Window.partitionBy("field", "row").orderBy("x0", "id", "page")
    so_far = in_row.rowsBetween(Window.unboundedPreceding, 0)
    whole = in_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = spans.filter(F.trim("text", F.lit(SPACE)) != "").dropna(subset=["field", "row"]).repartition("field").sortWithinPartitions("field", "row", "x0", "id", "page")
    rows = dealt.withColumns({"_x": F.lag("x1").over(in_row), "_before": F.lag("text").over(in_row), "_k": F.row_number().over(in_row), "_lead": F.first(bare(F.ltrim)).over(whole), "_trail": F.last(bare(F.rtrim)).over(whole)})
    gap = (F.col("x0") - F.col("_x") > 0.15 * F.col("size")) & ~F.col("_before").rlike(r"[ \t]$") & ~F.col("text").rlike(r"^[ \t]")
    rows = rows.withColumn("piece", F.concat(F.when(gap, " ").otherwise(""), "text"))
    rows = rows.withColumns({"_to": F.sum(F.char_length("piece")).over(so_far), "_size": F.sum(F.char_length("piece")).over(whole) - F.col("_lead") - F.col("_trail")}).withColumn("_from", F.col("_to") - F.char_length("text"))
    up_to = Window.partitionBy("field").orderBy("row", "x0", "id", "page").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.sum(F.when(F.col("_k") == 1, F.col("_size") + 1).otherwise(0)).over(up_to) - F.col("_size") - 1)
    inside = lambda c: F.least(F.greatest(F.col(c) - F.col("_lead"), F.lit(0)), F.col("_size")) + F.col("_at")
    return rows.select("field", "row", "id", "page", "x0", "piece", inside("_from").cast("int").alias("start"), inside("_to").cast("int").alias("end"))


def field_texts(offsets: DataFrame) -> DataFrame:
    """Of span_offsets: field, text, pages and ids in reading order."""
    words = F.array_sort(F.collect_list(F.struct("x0", "id", "piece")))
    lines = offsets.groupBy("field", "row").agg(F.regexp_replace(F.array_join(F.transform(words, lambda x: x["piece"]), ""), r"^\s+|\s+$", "").alias("_line"), F.transform(F.array_sort(F.collect_list(F.struct("x0", "id"))), lambda x: x["id"]).alias("_ids"), F.collect_set("page").alias("_pages"))
    of_rows = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("row", c))), lambda x: x[c])
    return lines.groupBy("field").agg(F.array_join(of_rows("_line"), "\n").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_pages")))).alias("pages"), F.flatten(of_rows("_ids")).alias("ids"))


def sub_fields(texts: DataFrame, offsets: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(part, field, start, end) -> part, field, text (white space at its ends left out), ids and pages of the spans
    that gave it. Ranges without a text are left out."""
    cut = ranges.join(texts.select("field", F.col("text").alias("_t")), "field").withColumn("_s", F.expr("substring(_t, start + 1, end - start)"))
    lead = F.char_length("_s") - F.char_length(F.regexp_replace("_s", r"^\s+", ""))
    cut = cut.withColumns({"text": F.regexp_replace("_s", r"^\s+|\s+$", ""), "_a": F.col("start") + lead}).filter("text <> ''").withColumn("_b", F.col("_a") + F.char_length("text"))
    held = offsets.select(F.col("field").alias("_f"), F.col("start").alias("_from"), F.col("end").alias("_to"), "id", "page", "row", "x0")
    met = cut.join(held, (F.col("field") == F.col("_f")) & (F.col("_from") < F.col("_b")) & (F.col("_to") > F.col("_a")))
    return met.groupBy("part", "field", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "x0", "id"))), lambda x: x["id"]).alias("ids"), F.array_sort(F.collect_set("page")).alias("pages"))


def text_places(offsets: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(field, needle) -> the spans in which the first place of the needle in the field's text lies: field, needle,
    id, page."""
    found = wanted.join(texts.select("field", "text"), "field").withColumn("_a", F.instr("text", F.col("needle")) - 1).filter("_a >= 0")
    inner = F.regexp_replace("needle", r"^\s+|\s+$", "")
    start = F.col("_a") + F.char_length("needle") - F.char_length(F.regexp_replace("needle", r"^\s+", ""))
    ranges = found.filter(inner != "").select("field", "needle", start.alias("_from"), (start + F.char_length(inner)).alias("_to"))
    met = ranges.join(offsets.select("field", "id", "page", "start", "end"), "field").filter((F.col("start") < F.col("_to")) & (F.col("end") > F.col("_from")))
    return met.select("field", "needle", "id", "page")
