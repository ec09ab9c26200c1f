"""What the cells of a spreadsheet mean: columns and their level, themes with outcomes and components, several files as
one, and values that were entered by hand. Cells are (file, row, header, value) below the header row."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.keys import norm_label, page_numbers

# Names of the columns that every file needs, and what says that a document has no structure pages.
REQUIRED = {"theme": ("Tema", "Ünite", "Öğrenme Alanı"), "lo": ("Öğrenme Çıktısı",), "component": ("Süreç Bileşeni", "Süreç Bileşenleri")}
NO_PAGES = ("yok", "-", "0")


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(value, r"\s+", " ")) != "", F.lit(False))


def required_columns(headers: DataFrame) -> DataFrame:
    """headers(file, col, header) -> file, theme, lo, component (the first column that is named so) and error, which names
    what is missing."""
    named = [F.min(F.when(F.col("_key").isin(*_keys(names)), F.col("col"))).alias(k) for k, names in REQUIRED.items()]
    found = headers.withColumn("_key", norm_label(F.col("header"))).groupBy("file").agg(*named)
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(names[0])) for k, names in REQUIRED.items()]))
    return found.withColumn("error", F.when(F.size(missing) > 0, F.array_join(missing, ", ")))


def _keys(names) -> list[str]:
    return ["".join(c for c in n.replace("İ", "i").replace("I", "ı").lower() if c.isalnum()).replace("ı", "i") for n in names]


def column_levels(cells: DataFrame, headers: DataFrame, theme: str, lo: str, component: str) -> DataFrame:
    """Per file and other column its level: theme if all its filled cells stand in rows with a theme, lo if in rows with an
    outcome, component otherwise, empty without any. Rows are marked once and then only counted."""
    held = cells.filter(filled(F.col("value")))
    marks = held.filter(F.col("header").isin(theme, lo)).groupBy("file", "row").agg(F.bool_or(F.col("header") == theme).alias("_t"), F.bool_or(F.col("header") == lo).alias("_l"))
    own = held.filter(~F.col("header").isin(theme, lo, component)).join(marks, ["file", "row"], "left")
    counts = own.groupBy("file", "header").agg(F.count("*").alias("_n"), F.count_if(F.col("_t")).alias("_nt"), F.count_if(F.col("_l")).alias("_nl"))
    level = F.when(F.col("_n").isNull(), "empty").when(F.col("_n") == F.col("_nt"), "theme").when(F.col("_n") == F.col("_nl"), "lo").otherwise("component")
    return headers.filter(~F.col("header").isin(theme, lo, component)).select("file", "header").distinct().join(counts, ["file", "header"], "left").select("file", "header", level.alias("level"))


def merged_levels(levels: DataFrame, order: DataFrame) -> DataFrame:
    """One level per column over all files: the first that is not empty, in the order of the files (file, place)."""
    placed = levels.join(order, "file").withColumn("_l", F.when(F.col("level") != "empty", F.struct("place", "level")))
    return placed.groupBy("header").agg(F.coalesce(F.min("_l")["level"], F.lit("empty")).alias("level"), F.min("place").alias("first"))


def address(file: Column, row: Column, col: Column) -> Column:
    """`file!B7`; columns up to ZZ."""
    letter = lambda n: F.char(n.cast("int") + 64)
    first = F.when(col > 26, letter(F.floor((col - 1) / 26))).otherwise("")
    return F.concat(file, F.lit("!"), first, letter((col - 1) % 26 + 1), row.cast("string"))


def theme_tree(cells: DataFrame, theme: str, lo: str, component: str) -> DataFrame:
    """Cells of the three columns with their place: file, row, header, value, theme_pos, lo_pos, component_pos. A cell
    belongs to the last theme and outcome at or above it; what stands before the first theme, and components before their
    theme's first outcome, are left out."""
    rows = cells.filter(filled(F.col("value")) & F.col("header").isin(theme, lo, component)).withColumn("_o", F.when(F.col("header") == theme, 0).when(F.col("header") == lo, 1).otherwise(2))
    above = lambda *keys: Window.partitionBy(*keys).orderBy("row", "_o").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("theme_pos", F.sum((F.col("_o") == 0).cast("int")).over(above("file"))).filter("theme_pos > 0")
    counted = counted.withColumn("lo_pos", F.sum((F.col("_o") == 1).cast("int")).over(above("file", "theme_pos")))
    counted = counted.filter("_o < 2 or lo_pos > 0").withColumn("component_pos", F.sum((F.col("_o") == 2).cast("int")).over(above("file", "theme_pos", "lo_pos")))
    return counted.select("file", "row", "header", "value", "theme_pos", F.when(F.col("_o") > 0, F.col("lo_pos")).alias("lo_pos"), F.when(F.col("_o") == 2, F.col("component_pos")).alias("component_pos"))


def read_overrides(rows: DataFrame) -> DataFrame:
    """rows(name, title, code, pages, start) as texts -> name, title, code, pages (numbers; empty for none), start and
    error. Rows without a name or without any value are left out; what cannot be read is an error of that name alone."""
    clean = rows.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("name", "title", "code", "pages", "start")])
    given = clean.filter((F.col("name") != "") & (F.concat("title", "code", "pages", "start") != ""))
    pages = F.when(F.col("pages") == "", F.lit(None)).when(F.lower("pages").isin(*NO_PAGES), F.array().cast("array<int>")).otherwise(page_numbers(F.col("pages")))
    bad_pages, bad_start = (F.col("pages") != "") & F.col("_p").isNull(), (F.col("start") != "") & ~F.col("start").rlike(r"^[0-9]{1,9}(\.0)?$")
    error = F.when(bad_pages, F.concat(F.lit("pages: "), "pages")).when(bad_start, F.concat(F.lit("start: "), "start"))
    read = given.withColumn("_p", pages).withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return read.select("name", good(F.nullif("title", F.lit(""))).alias("title"), good(F.nullif("code", F.lit(""))).alias("code"), good(F.col("_p")).alias("pages"), good(F.regexp_extract("start", "^[0-9]+", 0).try_cast("int")).alias("start"), "error")


def with_new_names(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """rows, as they are, and a row with the name alone for each of names that they lack."""
    new = names.select(name).distinct().join(rows.select(name), name, "left_anti")
    return rows.unionByName(new, allowMissingColumns=True)


def application_blocks(lines: DataFrame, keys: list[str], order: str, text: str, code: Column) -> DataFrame:
    """Lines cut into blocks at those that are a code alone: keys, code (null before the first), body. Of a code that comes
    twice the last block counts."""
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_c", code).withColumn("_b", F.sum(F.col("_c").isNotNull().cast("int")).over(within))
    packed = marked.groupBy(*keys, "_b").agg(F.max("_c").alias("code"), F.min(order).alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_c").isNull(), F.struct(order, text)))), lambda x: x[text]), "\n").alias("body"))
    last = F.max(F.struct("_at", F.trim("body").alias("body")))
    return packed.groupBy(*keys, "code").agg(last.alias("_l")).select(*keys, "code", "_l.body")


def compare_blocks(document: DataFrame, sheet: DataFrame, keys: list[str], status) -> DataFrame:
    """Both sides' blocks by code: keys, code, document, sheet, status. A sheet's text before its first code is left to
    review; status(document, sheet) compares two bodies."""
    d, s = (x.filter("code is not null").select(*keys, "code", F.col("body").alias(n)) for x, n in ((document, "document"), (sheet, "sheet")))
    met = d.join(s, [*keys, "code"], "full_outer")
    own = F.when(F.col("sheet").isNull(), "PDF_DE_VAR_EXCELDE_YOK").when(F.col("document").isNull(), "EXCELDE_VAR_PDF_DE_YOK").otherwise(status(F.col("document"), F.col("sheet")))
    loose = sheet.filter("code is null and body <> ''").select(*keys, F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("document"), F.col("body").alias("sheet"), F.lit("İNCELEME_GEREKLİ").alias("status"))
    return reduce(DataFrame.unionByName, [met.select(*keys, "code", "document", "sheet", own.alias("status")), loose])
