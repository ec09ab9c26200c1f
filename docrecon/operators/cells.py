"""Cells of a document beside those of a spreadsheet: code lists, item lists, and the grid of themes, outcomes and
components that both make. Cells are rows; a list in a cell becomes one row an entry, so lists meet by equality joins."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.codes import code_prefix, code_segments
from docrecon.functions.keys import PLACEHOLDER, norm_label, short, squeeze, without_name_suffix
from docrecon.functions.status import cell_status, merged_status
from docrecon.operators.scans import kept

# A code with a name, what an empty cell of the spreadsheet says, what parts of a list by side, and the
# order in which a row's cells decide its status.
CODE_LINE = r"^\s*(\p{L}{1,5}[0-9]+(?:\.[0-9]+)*)\.?\s*"
EMPTY_MARKERS = ("yok", "")
SHEET_PARTS, DOCUMENT_PARTS = "\n", r"\n\s*\n"
ROW_ORDER = ("FARKLI", "YALNIZCA_SİSTEM", "YALNIZCA_PDF", "BİÇİM", "AYNI", "BOŞ")


def code_entries(cells: DataFrame, ids: list[str], text: str, parts: str) -> DataFrame:
    """Entries of a cell's code list: ids, key (of the code, or of the whole entry without one), place, entry, code, name.
    A key that a cell repeats counts once, as it stands last."""
    spread = cells.select(*ids, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), parts)).alias("place", "entry"))
    rows = spread.withColumn("entry", F.trim(F.regexp_replace("entry", rf"{PLACEHOLDER}|^\s+|\s+$", ""))).filter(~norm_label(F.col("entry")).isin(*EMPTY_MARKERS))
    raw = F.regexp_extract("entry", CODE_LINE, 1)
    key = F.when(raw != "", F.concat_ws("|", code_prefix(raw), F.array_join(code_segments(raw), "."))).otherwise(F.concat(F.lit("?"), "entry"))
    named = rows.withColumns({"key": key, "code": F.rtrim(F.regexp_extract("entry", CODE_LINE, 0)), "name": F.trim(F.regexp_replace("entry", CODE_LINE, ""))})
    last = F.max(F.struct("place", "entry", F.when(raw != "", F.col("code")).alias("code"), "name")).alias("_e")
    return named.groupBy(*ids, "key").agg(last).select(*ids, "key", "_e.*")


def name_entry_status(sheet_name: Column, document_name: Column, sheet_code: Column, document_code: Column, sheet: Column, document: Column) -> Column:
    """Of two entries with one key: their names decide; a suffix " becerisi" that one side alone has is left out, and codes
    that are written in two ways make a difference in form at most. Entries without a code are compared whole."""
    s_cut, d_cut = without_name_suffix(sheet_name), without_name_suffix(document_name)
    own = cell_status(document_name, sheet_name)
    cut = F.when((own == "FARKLI") & s_cut.isNotNull() & d_cut.isNull(), cell_status(document_name, s_cut)).when((own == "FARKLI") & d_cut.isNotNull() & s_cut.isNull(), cell_status(d_cut, sheet_name)).otherwise(own)
    named = F.when((cut == "AYNI") & (squeeze(sheet_code) != squeeze(document_code)), "BİÇİM").otherwise(cut)
    return F.when(sheet_code.isNotNull() & document_code.isNotNull(), named).otherwise(cell_status(document, sheet))


def code_list_diff(cells: DataFrame, ids: list[str], sheet: str, document: str) -> DataFrame:
    """Per cell and code: sheet and document entry, status, and note: `nameless` where the document has the code without a
    name (nothing to compare), `suffix` where only the ignored suffix made a difference."""
    s, d = (code_entries(cells, ids, c, parts).select(*ids, "key", *(F.col(x).alias(f"{p}_{x}") for x in ("place", "entry", "code", "name"))) for c, parts, p in ((sheet, SHEET_PARTS, "s"), (document, DOCUMENT_PARTS, "d")))
    met = s.join(d, [*ids, "key"], "full_outer")
    nameless = F.col("d_code").isNotNull() & (F.col("d_name") == "")
    own = name_entry_status(*[F.col(x) for x in ("s_name", "d_name", "s_code", "d_code", "s_entry", "d_entry")])
    status = F.when(F.col("d_entry").isNull(), "YALNIZCA_SİSTEM").when(F.col("s_entry").isNull(), "YALNIZCA_PDF").when(nameless, "AYNI").otherwise(own)
    marked = met.withColumn("status", status)
    both = F.col("s_entry").isNotNull() & F.col("d_entry").isNotNull()
    note = F.when(both & nameless, "nameless").when(both & (F.col("status") != cell_status(F.col("d_entry"), F.col("s_entry"))), "suffix")
    return marked.select(*ids, "key", F.coalesce("s_place", F.col("d_place") + 100_000).alias("place"), F.col("s_entry").alias("sheet"), F.col("d_entry").alias("document"), "status", note.alias("note"))


def _listed(condition: Column, value: str) -> Column:
    """Values of the rows under the condition, in order of place, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("place", F.col(value).alias("v"))))), lambda x: x["v"]), "; ")


def code_cells(cells: DataFrame, ids: list[str], sheet: str, document: str) -> DataFrame:
    """Per cell with a code list: status, only_sheet, only_document (short entries), nameless and differing (keys). A cell
    without entries on both sides is BOŞ."""
    rows = code_list_diff(cells, ids, sheet, document).withColumns({"_s": short(squeeze(F.col("sheet"))), "_d": short(squeeze(F.col("document")))})
    found = rows.groupBy(*ids).agg(
        F.count_if(F.col("sheet").isNotNull()).alias("_ns"), F.count_if(F.col("document").isNotNull()).alias("_nd"), F.collect_set("status").alias("_all"),
        _listed(F.col("document").isNull(), "_s").alias("only_sheet"), _listed(F.col("sheet").isNull(), "_d").alias("only_document"),
        _listed(F.col("note") == "nameless", "key").alias("nameless"), _listed(F.col("document").isNotNull() & F.col("sheet").isNotNull() & (F.col("status") == "FARKLI"), "key").alias("differing"),
    )
    status = F.when(F.col("_nd") == 0, "YALNIZCA_SİSTEM").when(F.col("_ns") == 0, "YALNIZCA_PDF").when(F.size(F.array_except("_all", F.lit(["AYNI"]))) == 0, "AYNI").when(F.size(F.array_except("_all", F.lit(["AYNI", "BİÇİM"]))) == 0, "BİÇİM").otherwise("FARKLI")
    lists = ("only_sheet", "only_document", "nameless", "differing")
    two = lambda c: F.when(status.isin("YALNIZCA_SİSTEM", "YALNIZCA_PDF"), F.lit("")).otherwise(F.col(c))
    held = found.select(*ids, status.alias("status"), *[two(c).alias(c) for c in lists])
    return cells.select(*ids).join(held, ids, "left").select(*ids, F.coalesce("status", F.lit("BOŞ")).alias("status"), *[F.coalesce(c, F.lit("")).alias(c) for c in lists])


def _items(cells: DataFrame, ids: list[str], text: Column, part: str, name: str) -> DataFrame:
    rows = cells.select(*ids, F.posexplode(F.split(F.coalesce(text, F.lit("")), part)).alias("place", "entry")).withColumn("entry", F.trim(F.regexp_replace("entry", r"^\s+|\s+$", ""))).filter("entry <> ''")
    return rows.withColumn("key", norm_label(F.col("entry"))).groupBy(*ids, "key").agg(F.max(F.struct("place", "entry")).alias("_e")).select(*ids, "key", F.col("_e.place").alias(f"{name}_place"), F.col("_e.entry").alias(name))


def item_cells(cells: DataFrame, ids: list[str], sheet: str, document: str) -> DataFrame:
    """Per cell with a list of items, a line each in the sheet and between commas in the document: status, only_sheet,
    only_document. Items are sets by their key; those in both sides with other spellings make a difference in form."""
    joined = lambda c: F.regexp_replace(c, r"-\s*\n\s*", "")
    s = _items(cells, ids, joined(F.col(sheet)), "\n", "s")
    d = _items(cells, ids, joined(F.translate(document, "\n", " ")), ",", "d")
    met = s.join(d, [*ids, "key"], "full_outer").withColumn("place", F.coalesce("s_place", "d_place"))
    found = met.groupBy(*ids).agg(
        F.count_if(F.col("s").isNotNull()).alias("_ns"), F.count_if(F.col("d").isNotNull()).alias("_nd"), F.bool_and(squeeze(F.col("s")) == squeeze(F.col("d"))).alias("_same"),
        _listed(F.col("d").isNull(), "s").alias("only_sheet"), _listed(F.col("s").isNull(), "d").alias("only_document"),
    )
    status = F.when(F.col("_nd") == 0, "YALNIZCA_SİSTEM").when(F.col("_ns") == 0, "YALNIZCA_PDF").when((F.col("only_sheet") != "") | (F.col("only_document") != ""), "FARKLI").when(F.col("_same"), "AYNI").otherwise("BİÇİM")
    two = lambda c: F.when(status == "FARKLI", F.col(c)).otherwise(F.lit("")).alias(c)
    held = found.select(*ids, status.alias("status"), two("only_sheet"), two("only_document"))
    return cells.select(*ids).join(held, ids, "left").select(*ids, F.coalesce("status", F.lit("BOŞ")).alias("status"), F.coalesce("only_sheet", F.lit("")).alias("only_sheet"), F.coalesce("only_document", F.lit("")).alias("only_document"))


def looks_like_items(sheet: Column, document: Column, longest: int = 60) -> Column:
    """Whether a text cell holds a list: several short lines without a full stop, and a comma in the document."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(sheet, r"-\s*\n\s*", ""), "\n"), F.trim), lambda x: x != "")
    return (F.size(lines) > 1) & F.forall(lines, lambda x: (F.char_length(x) <= longest) & ~x.endswith(".")) & F.contains(document, F.lit(","))


def grid_cells(document: DataFrame, sheet: DataFrame, code_headers: list[str]) -> DataFrame:
    """Both sides' cells(theme, lo, pos, header, value) beside each other: theme, lo, pos, header, sheet, document, kind,
    status. lo is null for cells of a theme, pos for those of a theme or an outcome. Of cells that a side repeats the
    smallest value counts. Code columns are compared as lists, texts that look like lists as items."""
    keys = ["theme", "lo", "pos", "header"]
    both = document.select(*keys, F.col("value").alias("document"), F.lit(None).cast("string").alias("sheet")).unionByName(sheet.select(*keys, F.lit(None).cast("string").alias("document"), F.col("value").alias("sheet")))
    cells = both.groupBy(*keys).agg(F.coalesce(F.min("sheet"), F.lit("")).alias("sheet"), F.coalesce(F.min("document"), F.lit("")).alias("document"))
    kind = F.when(F.col("header").isin(*code_headers), "codes").when(F.col("lo").isNull() & looks_like_items(F.col("sheet"), F.col("document")), "items").otherwise("text")
    # three comparisons build on the cells
    cells = kept(cells.withColumn("kind", kind), "cells").withColumns({"_lo": F.coalesce(F.col("lo").cast("string"), F.lit("")), "_pos": F.coalesce(F.col("pos").cast("string"), F.lit(""))})
    ids = ["theme", "_lo", "_pos", "header"]
    codes = code_cells(cells.filter("kind = 'codes'"), ids, "sheet", "document").select(*ids, "status")
    items = item_cells(cells.filter("kind = 'items'"), ids, "sheet", "document").select(*ids, "status")
    lists = codes.unionByName(items).withColumnRenamed("status", "_list")
    text = cell_status(F.col("document"), F.col("sheet"))
    return cells.join(lists, ids, "left").select(*keys, "sheet", "document", "kind", F.coalesce("_list", text).alias("status"))


def grid_rows(cells: DataFrame, component: str) -> DataFrame:
    """The rows that a grid shows: theme, lo, pos, first_of_theme, first_of_lo, status. An outcome has a row for each of its
    components and one if it has none, a theme without outcomes one. A theme's cells count in its first row, an
    outcome's in its first; the row's status is the first of ROW_ORDER that a cell of it has."""
    cells = kept(cells, "grid")
    first = F.lit(0).cast(cells.schema["pos"].dataType)
    los = cells.filter("lo is not null").select("theme", "lo").distinct()
    parts = cells.filter(F.col("header") == component).select("theme", "lo", "pos").distinct()
    rows = los.join(parts, ["theme", "lo"], "left").withColumn("pos", F.coalesce("pos", first))
    bare = cells.select("theme").distinct().join(los, "theme", "left_anti").select("theme", F.lit(None).cast(cells.schema["lo"].dataType).alias("lo"), first.alias("pos"))
    rows = rows.unionByName(bare)
    rows = rows.withColumns({"first_of_theme": F.row_number().over(Window.partitionBy("theme").orderBy("lo", "pos")) == 1, "first_of_lo": F.col("lo").isNotNull() & (F.row_number().over(Window.partitionBy("theme", "lo").orderBy("pos")) == 1)})
    rank = F.min(F.array_position(F.lit(list(ROW_ORDER)), F.col("status")))
    ranks = cells.groupBy("theme", "lo", "pos").agg(rank.alias("_r"))
    of = [ranks.filter(c).select(*keys, F.col("_r").alias(n)) for c, keys, n in (("lo is null", ["theme"], "_t"), ("lo is not null and pos is null", ["theme", "lo"], "_l"), ("pos is not null", ["theme", "lo", "pos"], "_c"))]
    joined = rows.join(of[0], "theme", "left").join(of[1], ["theme", "lo"], "left").join(of[2], ["theme", "lo", "pos"], "left")
    worst = F.least(F.when(F.col("first_of_theme"), F.col("_t")), F.when(F.col("first_of_lo"), F.col("_l")), F.col("_c"))
    return joined.select("theme", "lo", "pos", "first_of_theme", "first_of_lo", F.coalesce(F.element_at(F.lit(list(ROW_ORDER)), worst.cast("int")), F.lit("BOŞ")).alias("status"))


def merged_cells(cells: DataFrame, outcome: str, component: str) -> DataFrame:
    """One cell per theme and column for the upright view: theme, header, sheet, document, members, status. Outcomes and
    their components are one text in order; entries of code columns stand once each, in order. The status comes from the
    cells that are merged, so no difference is hidden."""
    header = F.when(F.col("header").isin(outcome, component), outcome).otherwise(F.col("header"))
    order = F.struct(F.col("lo"), F.coalesce(F.col("pos"), F.lit(-1)).alias("pos"))
    held = cells.filter("lo is not null").select("theme", header.alias("header"), order.alias("_o"), "kind", "sheet", "document", "status")
    packed = held.groupBy("theme", "header", "kind").agg(F.array_sort(F.collect_list(F.struct("_o", "sheet", "document"))).alias("_all"), F.collect_set("status").alias("_s"))
    text = lambda side: F.array_join(F.filter(F.transform("_all", lambda x: F.trim(x[side])), lambda x: x != ""), "\n")

    def entries(side: str, parts: str) -> Column:
        split = F.flatten(F.transform("_all", lambda x: F.filter(F.transform(F.split(x[side], parts), lambda e: F.trim(F.regexp_replace(e, rf"{PLACEHOLDER}|^\s+|\s+$", ""))), lambda e: e != "")))
        return F.array_join(F.array_sort(F.array_distinct(split)), "\n")

    joined = lambda side, parts: F.when(F.col("kind") == "codes", entries(side, parts)).otherwise(text(side)).alias(side)
    return packed.select("theme", "header", joined("sheet", SHEET_PARTS), joined("document", DOCUMENT_PARTS), F.size("_all").alias("members"), merged_status(F.col("_s")).alias("status"))


def diff_items(cells: DataFrame, theme: str = "Theme", outcome: str = "Outcome") -> DataFrame:
    """The differences of a grid's cells(theme, lo, pos, header, sheet, document, status), each once: theme, lo, pos, header,
    status, sheet, document. A theme that one side has alone is one row (header `*`, with the cell that the theme header names);
    so is an outcome of a theme that both have. Cells that are equal, equal but for form, or empty are none."""
    sided = F.when(F.count_if(F.col("document") != "") == 0, "YALNIZCA_SİSTEM").when(F.count_if(F.col("sheet") != "") == 0, "YALNIZCA_PDF")
    held = kept(cells.filter("sheet <> '' or document <> ''"), "grid")
    themes = held.groupBy("theme").agg(sided.alias("_theme"))
    los = held.filter("lo is not null").groupBy("theme", "lo").agg(sided.alias("_lo"))
    whole = held.join(themes, "theme").join(los, ["theme", "lo"], "left")
    one_sided = whole.filter("coalesce(_theme, _lo) is not null").withColumn("_of", F.when(F.col("_theme").isNull(), F.col("lo")))
    named = F.col("pos").isNull() & F.when(F.col("_theme").isNull(), F.col("header") == outcome).otherwise((F.col("header") == theme) & F.col("lo").isNull())
    tops = one_sided.groupBy("theme", F.col("_of").alias("lo")).agg(F.max(F.coalesce("_theme", "_lo")).alias("status"), *(F.coalesce(F.max(F.when(named, F.col(c))), F.lit("")).alias(c) for c in ("sheet", "document")))
    tops = tops.select("theme", "lo", F.lit(None).cast(cells.schema["pos"].dataType).alias("pos"), F.lit("*").alias("header"), "status", "sheet", "document")
    own = whole.filter("_theme is null and _lo is null").filter(F.col("status").isin("FARKLI", "YALNIZCA_SİSTEM", "YALNIZCA_PDF"))
    return own.select(tops.columns).unionByName(tops)
