"""Expected tables from the cells of a page's tables: titles, columns' roles, rows, and lists of outcome codes.

Cells are (doc, table, row, col, x0, y0, x1, y1, text); a table's cells are as many as stand on a page, so what is joined within
one table stays small. Lines are (doc, table's page, ...) of the page's text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.keys import norm_label
from docrecon.functions.labels import HOURS_HINTS, LO_HINTS, ORDER_HINTS, leading_code, names_any

TABLE = ["doc", "table"]
# Share of a table's width that a title cell has at least; how far above a table its title may stand, with a
# colour of its own and without; how close the lines of a title are, by their size.
WIDE, COLOURED_ABOVE, ABOVE, CLOSE = 0.8, 90.0, 40.0, 0.6


def whole_number(c: Column) -> Column:
    return F.when(F.btrim(c).rlike("^[0-9]+$"), F.btrim(c).try_cast("int"))


def numbered(c: Column) -> tuple[Column, Column]:
    """The number that a text such as `3. Ad` begins with, and whether it has one."""
    head = F.btrim(F.substring_index(c, ".", 1))
    rest = F.btrim(F.substring(c, F.instr(c, ".") + 1, F.char_length(c)))
    found = (F.instr(c, ".") > 0) & head.rlike("^[0-9]+$") & (rest != "")
    return F.when(found, head.try_cast("int")), found


def _filled(cells: DataFrame) -> DataFrame:
    return cells.filter("text is not null and btrim(text) <> ''")


def inner_titles(cells: DataFrame, keyword: str) -> DataFrame:
    """doc, table, row, title: a first row of one filled cell as wide as most of the table, which names no column."""
    size = cells.groupBy(*TABLE).agg(F.min("row").alias("row"), (F.max("x1") - F.min("x0")).alias("_width"))
    first = _filled(cells).join(size, [*TABLE, "row"]).groupBy(*TABLE, "row", "_width").agg(F.count("*").alias("_n"), F.max("text").alias("title"), F.max(F.col("x1") - F.col("x0")).alias("_own"))
    column = names_any(F.col("title"), (*LO_HINTS, *HOURS_HINTS, *ORDER_HINTS)) | (norm_label(F.col("title")) == norm_label(F.lit(keyword)))
    return first.filter((F.col("_n") == 1) & (F.col("_own") >= WIDE * F.col("_width")) & ~column).select(*TABLE, "row", "title")


def outer_titles(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, table, title: the nearest block of lines above a table that has a colour of its own, else the nearest line close above.

    tables(doc, table, page, x0, y0, x1, after: the end of the table before, 0 without one); lines(doc, page, row, x0, y0, x1, y1,
    size, color, heading: whether most of its letters are in no body colour, text). Lines of one colour and size that follow
    one another closely are one block.
    """
    t = tables.select(*TABLE, "page", F.col("x0").alias("_l"), F.col("y0").alias("_t"), F.col("x1").alias("_r"), "after")
    band = lines.join(t, ["doc", "page"]).filter((F.col("y1") <= F.col("_t") + 1) & (F.col("y0") >= F.greatest("after", F.col("_t") - COLOURED_ABOVE)) & (F.col("x1") >= F.col("_l")) & (F.col("x0") <= F.col("_r")))
    own = Window.partitionBy(*TABLE)
    band = band.withColumns({"_below": F.lead(F.struct("color", "size", "y0", "heading")).over(own.orderBy("row")), "_last": F.max(F.when(F.col("heading"), F.col("row"))).over(own)})
    goes_on = F.col("heading") & F.col("_below.heading") & (F.col("color") == F.col("_below.color")) & (F.abs(F.col("size") - F.col("_below.size")) <= 0.5) & (F.col("_below.y0") - F.col("y1") <= CLOSE * F.col("size"))
    stop = F.max(F.when((F.col("row") < F.col("_last")) & ~F.coalesce(goes_on, F.lit(False)), F.col("row"))).over(own)
    band = band.withColumns({"_stop": F.coalesce(stop, F.lit(-1)), "_near": F.max(F.when(F.col("y1") >= F.col("_t") - ABOVE, F.col("row"))).over(own)})
    chosen = F.when(F.col("_last").isNotNull(), (F.col("row") > F.col("_stop")) & (F.col("row") <= F.col("_last"))).otherwise(F.col("row") == F.col("_near"))
    picked = band.filter(chosen).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("_b"))
    return picked.select(*TABLE, F.array_join(F.transform("_b", lambda x: x["text"]), "\n").alias("title"))


def table_rows(cells: DataFrame, keyword: str) -> DataFrame:
    """doc, table, n (row), order, name, count_raw, count, hours, is_total: the data rows of tables with an outcome column.

    Rows up to the first with a number or a dash are headers; a title row is left out. A cell has the role of the narrowest header
    cell over its middle (the upper, then the left one of equal ones). The name column is headed by the unit's keyword, or is the
    leftmost whose header holds it. Without an order column, the order is a number's cell left of the names, or what the
    name begins with. The last row without order but with a count is the table's total. Cells of one role are joined by blanks.
    """
    titles = inner_titles(cells, keyword).withColumnRenamed("row", "_title_row").drop("title")
    held = _filled(cells).join(titles, TABLE, "left").filter("_title_row is null or row <> _title_row").drop("_title_row")
    is_number = whole_number(F.col("text")).isNotNull() | (F.btrim(F.col("text")) == "-")
    held = held.withColumn("_from", F.min(F.when(is_number, F.col("row"))).over(Window.partitionBy(*TABLE)))
    key, wanted = norm_label(F.col("text")), norm_label(F.lit(keyword))
    lo, hours, order = (names_any(F.col("text"), h) for h in (LO_HINTS, HOURS_HINTS, ORDER_HINTS))
    heads = held.filter("_from is null or row < _from").withColumns({"_kind": F.when(lo, "lo").when(hours, "hours").when(order, "order"), "_named": F.contains(key, wanted) & ~lo, "_exact": key == wanted})
    best = F.min(F.when(F.col("_named"), F.struct(~F.col("_exact"), F.when(F.col("_exact"), F.lit(0.0)).otherwise(F.col("x0")), "row", "col", F.col("x0").alias("left"))))
    about = heads.groupBy(*TABLE).agg(best.alias("_name"), F.max(F.col("_kind") == "lo").alias("_has_lo"), F.coalesce(F.max(F.col("_kind") == "order"), F.lit(False)).alias("_has_order")).filter("_has_lo")
    heads = heads.join(about.select(*TABLE, "_name"), TABLE)
    heads = heads.select(*TABLE, F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.struct(F.col("x1") - F.col("x0"), "row", "col").alias("_rank"), F.coalesce("_kind", F.when((F.col("row") == F.col("_name.row")) & (F.col("col") == F.col("_name.col")), "name")).alias("_role"))
    data = held.filter("row >= _from").join(about, TABLE).withColumn("_mid", (F.col("x0") + F.col("x1")) / 2)
    covered = data.join(heads, TABLE).filter((F.col("_x0") - 1 <= F.col("_mid")) & (F.col("_mid") <= F.col("_x1") + 1)).groupBy(*TABLE, "row", "col").agg(F.min_by(F.struct("_role"), "_rank").alias("_r"))
    roles = data.join(covered, [*TABLE, "row", "col"], "left")
    alone = F.btrim(F.col("text")).rlike(r"^[0-9]+\s*\.$") & ~F.col("_has_order") & (F.col("x1") <= F.col("_name.left") + 1)
    roles = roles.withColumn("role", F.coalesce("_r._role", F.when(alone, "order"))).filter("role is not null")
    texts = roles.groupBy(*TABLE, "row", "_has_order").agg(F.array_sort(F.collect_list(F.struct("col", "role", "text"))).alias("_all"))
    of = lambda role: F.nullif(F.array_join(F.transform(F.filter("_all", lambda x: x["role"] == role), lambda x: x["text"]), " "), F.lit(""))
    texts = texts.select(*TABLE, "row", "_has_order", of("order").alias("_order"), of("name").alias("name"), of("lo").alias("count_raw"), of("hours").alias("_hours"))
    begun, _ = numbered(F.col("name"))
    texts = texts.withColumns({"order": F.when(F.col("_order").isNotNull(), whole_number(F.rtrim(F.btrim("_order"), F.lit(".")))).when(~F.col("_has_order"), begun), "count": whole_number(F.col("count_raw")), "hours": whole_number(F.col("_hours"))})
    last = F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc("row"))) == 1
    return texts.select(*TABLE, F.col("row").alias("n"), "order", "name", "count_raw", "count", "hours", (last & F.col("order").isNull() & F.col("count").isNotNull()).alias("is_total"))


def outcome_lists(cells: DataFrame, keyword: str, schemes: DataFrame) -> DataFrame:
    """Tables that list outcome codes under units: doc, table, col, order, name, place, raw, parsed.

    Such a table has a row that the unit's keyword heads and one that outcomes head, with as many cells, and in every row two cells
    or more. Each line of an outcome cell is a row here; parsed says that it is one code of the document's scheme
    (schemes(doc, prefix, types)) and nothing else: the others are kept as they stand.
    """
    heads = cells.withColumn("_i", F.row_number().over(Window.partitionBy(*TABLE, "row").orderBy("col")))
    sizes = heads.groupBy(*TABLE, "row").agg(F.count("*").alias("_n"), F.max(F.when(F.col("_i") == 1, F.col("text"))).alias("_head"))
    kind = sizes.withColumns({"_unit": F.coalesce(norm_label(F.col("_head")) == norm_label(F.lit(keyword)), F.lit(False)), "_lo": names_any(F.col("_head"), LO_HINTS)})
    first = lambda c: F.min(F.when(F.col(c), F.struct("row", "_n")))
    fits = kind.groupBy(*TABLE).agg(F.min("_n").alias("_least"), F.count("*").alias("_rows"), first("_unit").alias("_u"), first("_lo").alias("_l")).filter("_rows >= 2 and _least >= 2 and _u is not null and _l is not null and _u._n = _l._n")
    within = heads.filter("_i > 1").join(fits, TABLE)
    names = within.filter("row = _u.row").select(*TABLE, "_i", F.col("text").alias("name"))
    codes = within.filter("row = _l.row").select(*TABLE, "_i", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "raw")).filter("btrim(raw) <> ''")
    order, _ = numbered(F.col("name"))
    found = codes.join(names, [*TABLE, "_i"]).join(schemes.select(F.col("doc"), "prefix", "types"), "doc", "left")
    whole = leading_code(F.col("raw"), F.col("prefix"), F.col("types")) == F.btrim("raw")
    return found.select(*TABLE, (F.col("_i") - 1).alias("col"), order.alias("order"), "name", "place", "raw", F.coalesce(whole, F.lit(False)).alias("parsed"))
