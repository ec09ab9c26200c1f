"""Expected tables beside extracted units: which table and row a unit has, and what differs. All are relations:

units(doc, unit, context, order, name, los, hours_text), tables(doc, table, title, role), rows(doc, table, n, order, name,
count_raw, count, hours, is_total) and listed(doc, table, order, code), the outcome lists. Findings are doc, unit (null for
a document or a table), code, severity, detail.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.keys import label_tokens, norm_label, ordinal_token
from docrecon.operators.scans import kept

# Roles of tables.
SUMMARY, ALTERNATIVE, LO_LIST = "SUMMARY", "ALTERNATIVE", "LO_LIST"


def row_name_key(name: Column) -> Column:
    """Match key of a row's name without its leading number, then without its leading code (letters, and numbers after
    full stops); null where nothing is left. The name is cut at its full stops and its leading pieces are left out."""
    number = lambda p: F.coalesce(p, F.lit("")).rlike("^[0-9]+$")
    given = F.transform(F.split(name, r"\."), lambda x: F.btrim(x))
    numbered = number(F.get(given, 0)) & (F.array_join(F.slice(given, 2, F.size(given)), "") != "")
    pieces = F.when(numbered, F.slice(given, 2, F.size(given))).otherwise(given)
    rest = F.slice(pieces, 2, F.size(pieces))
    other = F.array_position(F.transform(rest, number), False).cast("int")
    after = F.when(other > 0, F.slice(rest, other, F.size(rest))).otherwise(F.array().cast("array<string>"))
    coded = F.get(pieces, 0).rlike(r"^\p{L}+$") & F.coalesce(F.get(rest, 0), F.lit("")).rlike("^[0-9]")
    text = F.when(coded, F.regexp_replace(F.array_join(after, "."), "^[0-9]+", "")).otherwise(F.array_join(pieces, "."))
    return F.nullif(norm_label(text), F.lit(""))


def context_in_title(context: Column, title: Column) -> Column:
    """Whether the context's words stand in the title in a row, or both have the context's ordinal and its next word in a
    row. Both are arrays of label_tokens; an empty context stands nowhere."""

    def within(c: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(title) - F.size(c) + 1, F.lit(1)))
        return (F.size(c) > 0) & (F.size(title) >= F.size(c)) & F.exists(places, lambda i: F.slice(title, i, F.size(c)) == c)

    opening = (F.size(context) >= 2) & ordinal_token(F.coalesce(F.get(context, 0), F.lit("")))
    return within(context) | (opening & within(F.slice(context, 1, 2)))


def finding(rows: DataFrame, code: str, severity: str, detail: Column) -> DataFrame:
    unit = F.col("unit") if "unit" in rows.columns else F.lit(None).cast("long")
    return rows.select("doc", unit.alias("unit"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def tables_of_units(units: DataFrame, tables: DataFrame, role: str, *, single: bool = True) -> DataFrame:
    """Per unit the number of tables of a role whose title has its context, and the smallest of them: doc, unit,
    candidates, table. With `single`, a document's only table of the role is every unit's. Contexts meet titles once each,
    not once a unit."""
    own = tables.filter(F.col("role") == role).select("doc", "table", label_tokens(F.col("title")).alias("_t"))
    contexts = units.select("doc", "context").distinct().withColumn("_c", label_tokens(F.coalesce("context", F.lit(""))))
    met = contexts.join(own, "doc").filter(context_in_title(F.col("_c"), F.coalesce("_t", F.array().cast("array<string>"))))
    found = met.groupBy("doc", "context").agg(F.count("*").alias("_n"), F.min("table").alias("_table"))
    alone = own.groupBy("doc").agg(F.count("*").alias("_all"), F.min("table").alias("_only"))
    name = F.coalesce("context", F.lit("")).alias("_k")
    joined = units.select("doc", "unit", name).join(found.select("doc", name, "_n", "_table"), ["doc", "_k"], "left").join(alone, "doc", "left")
    fallback = F.lit(single) & F.col("_n").isNull() & (F.col("_all") == 1)
    return joined.select("doc", "unit", F.when(fallback, 1).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("candidates"), F.when(fallback, F.col("_only")).otherwise(F.col("_table")).alias("table"))


def match_rows(units: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Per unit its summary table and row: doc, unit, candidates, table, n, how (name, order, ambiguous or no table). A row
    is found by name where the table has one such row, else by number where it has one. Rows are counted by key before
    units meet them."""
    held = rows.filter("order is not null").withColumn("_name", row_name_key(F.col("name")))
    by_name = held.filter("_name is not null").groupBy("doc", "table", "_name").agg(F.count("*").alias("_c"), F.min("n").alias("_by_name")).filter("_c = 1").drop("_c")
    by_order = held.groupBy("doc", "table", "order").agg(F.count("*").alias("_c"), F.min("n").alias("_by_order")).filter("_c = 1").drop("_c")
    found = tables_of_units(units, tables, SUMMARY).withColumn("table", F.when(F.col("candidates") == 1, F.col("table")))
    own = units.select("doc", "unit", "order", norm_label(F.col("name")).alias("_name")).join(found, ["doc", "unit"])
    joined = own.join(by_name, ["doc", "table", "_name"], "left").join(by_order, ["doc", "table", "order"], "left")
    how = F.when(F.col("table").isNull(), "no table").when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_order").isNotNull(), "order").otherwise("ambiguous")
    return joined.select("doc", "unit", "candidates", "table", F.coalesce("_by_name", "_by_order").alias("n"), how.alias("how"))


def expected_findings(units: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """What matching units with summary tables shows, per unit, table and document."""
    # eleven findings build on these
    units, tables, rows = kept(units, "units"), kept(tables, "tables"), kept(rows, "rows")
    matched = kept(match_rows(units, tables, rows), "matched")
    named = matched.join(rows.select("doc", "table", "n", F.col("name").alias("_row_name"), "count", "hours", F.col("order").alias("_order")), ["doc", "table", "n"], "left").join(units.select("doc", "unit", "name", "los"), ["doc", "unit"])
    named = kept(named.withColumns({"_row_key": row_name_key(F.col("_row_name")), "_key": norm_label(F.col("name"))}), "named")
    differs = F.col("_row_key") != F.col("_key")
    used = matched.filter("n is not null").select("doc", "table", "n").distinct()
    with_rows = used.select("doc", "table").distinct()
    summary = tables.filter(F.col("role") == SUMMARY).select("doc", "table")
    unmatched = summary.join(with_rows, ["doc", "table"], "left_anti")
    missing = rows.filter("order is not null").join(with_rows, ["doc", "table"], "left_semi").join(used, ["doc", "table", "n"], "left_anti")
    counted = named.filter("n is not null")
    docs = units.select("doc").distinct()
    extracted = units.groupBy("doc").agg(F.count("*").alias("_units"), F.sum("los").alias("_los"))
    asked = rows.join(summary, ["doc", "table"], "left_semi").filter("order is not null").groupBy("doc").agg(F.count("*").alias("_rows"), F.when(F.count_if(F.col("count").isNull()) == 0, F.sum("count")).alias("_expected"))
    usable = extracted.join(summary.select("doc").distinct(), "doc", "left_semi").join(unmatched.select("doc").distinct(), "doc", "left_anti").join(asked, "doc")
    found = [
        finding(matched.filter("candidates <> 1"), "EXPECTED_TABLE_AMBIGUOUS", "INFO", F.col("candidates")),
        finding(matched.filter("how = 'ambiguous'"), "EXPECTED_ROW_AMBIGUOUS", "INFO", F.col("table")),
        finding(counted.filter(differs), "UNIT_NAME_MISMATCH", "NEEDS_REVIEW", F.col("_row_name")),
        finding(unmatched, "EXPECTED_TABLE_UNMATCHED", "INFO", F.col("table")),
        finding(missing, "MISSING_UNIT", "FAIL", F.concat_ws("/", "table", "order")),
        finding(named.filter("n is null or count is null"), "EXPECTED_COUNT_MISSING", "INFO", F.col("los")),
        finding(counted.filter("count <> los"), "LO_COUNT_MISMATCH", "FAIL", F.col("los") - F.col("count")),
        finding(docs.join(tables.select("doc").distinct(), "doc", "left_anti"), "EXPECTED_TABLE_NOT_FOUND", "INFO", F.lit(None)),
        finding(extracted.join(unmatched.select("doc").distinct(), "doc", "left_semi"), "EXPECTED_TOTAL_UNKNOWN", "INFO", F.col("_los")),
        finding(usable.filter("_rows <> _units"), "UNIT_COUNT_MISMATCH", "FAIL", F.col("_units") - F.col("_rows")),
        finding(usable.filter("_expected <> _los"), "LO_TOTAL_MISMATCH", "FAIL", F.col("_los") - F.col("_expected")),
    ]
    return reduce(DataFrame.unionByName, found)


def table_findings(tables: DataFrame, rows: DataFrame, listed: DataFrame) -> DataFrame:
    """What tables show by themselves: counts that are no numbers, totals that rows do not add up to, lines of outcome
    lists that are no code (listed has them with a null code and their text)."""
    held = rows.join(tables.filter(F.col("role") != LO_LIST).select("doc", "table"), ["doc", "table"], "left_semi")
    sums = held.groupBy("doc", "table").agg(F.sum(F.when(F.col("order").isNotNull(), F.col("count"))).alias("_sum"), F.count_if(F.col("order").isNotNull() & F.col("count").isNull()).alias("_open"), F.min(F.when(F.col("is_total"), F.col("count"))).alias("_total"))
    return finding(held.filter("order is not null and count is null"), "EXPECTED_COUNT_UNREADABLE", "INFO", F.col("count_raw")).unionByName(
        finding(sums.filter("_open = 0 and _sum <> _total"), "TABLE_TOTAL_INCONSISTENT", "NEEDS_REVIEW", F.col("_total") - F.col("_sum"))
    ).unionByName(finding(listed.filter("code is null"), "LO_LIST_UNPARSED", "NEEDS_REVIEW", F.col("text")))


def limited_findings(units: DataFrame, outcomes: DataFrame, tables: DataFrame, rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Alternative tables beside outcome lists: a unit needs one of each, with one row and one column of its number; the
    row's count is the list's number of codes, and each listed code is one of the unit's outcomes(doc, unit, code)."""
    alt = tables_of_units(units, tables, ALTERNATIVE, single=False).select("doc", "unit", F.col("candidates").alias("_a"), F.col("table").alias("_alt"))
    lst = tables_of_units(units, tables, LO_LIST, single=False).select("doc", "unit", F.col("candidates").alias("_l"), F.col("table").alias("_list"))
    both = alt.join(lst, ["doc", "unit"]).filter("_a > 0 or _l > 0").join(units.select("doc", "unit", "order"), ["doc", "unit"])
    one = both.filter("_a = 1 and _l = 1")
    in_alt = rows.groupBy("doc", F.col("table").alias("_alt"), "order").agg(F.count("*").alias("_rows"), F.min("count").alias("_count"))
    in_list = listed.groupBy("doc", F.col("table").alias("_list"), "order").agg(F.countDistinct("column").alias("_columns"), F.count("code").alias("_codes"))
    joined = one.join(in_alt, ["doc", "_alt", "order"], "left").join(in_list, ["doc", "_list", "order"], "left")
    single = joined.filter("_rows = 1 and _columns = 1")
    codes = single.select("doc", "unit", "_list", "order").join(listed.filter("code is not null").select("doc", F.col("table").alias("_list"), "order", "code"), ["doc", "_list", "order"])
    found = [
        finding(both.filter("_a <> 1 or _l <> 1"), "LIMITED_TABLE_AMBIGUOUS", "NEEDS_REVIEW", F.concat_ws("/", "_a", "_l")),
        finding(joined.filter("not (_rows <=> 1 and _columns <=> 1)"), "LIMITED_ROW_AMBIGUOUS", "NEEDS_REVIEW", F.concat_ws("/", "_alt", "_list")),
        finding(single.filter("not (_count <=> _codes)"), "LIMITED_LO_COUNT_MISMATCH", "NEEDS_REVIEW", F.concat_ws("/", "_count", "_codes")),
        finding(codes.join(outcomes.select("doc", "unit", "code"), ["doc", "unit", "code"], "left_anti"), "LIMITED_LO_NOT_FOUND", "NEEDS_REVIEW", F.col("code")),
    ]
    return reduce(DataFrame.unionByName, found)


def hours_findings(units: DataFrame, sections: DataFrame, expected: DataFrame) -> DataFrame:
    """sections(doc, unit, text) are those whose label names hours; expected(doc, unit, hours). A unit needs one with a
    number, equal to the expected one."""
    own = sections.groupBy("doc", "unit").agg(F.count("*").alias("_n"), F.min("text").alias("_text"))
    joined = units.select("doc", "unit").join(own, ["doc", "unit"], "left").join(expected.select("doc", "unit", "hours"), ["doc", "unit"], "left")
    text = F.trim("_text")
    read = joined.withColumn("_value", F.when(text.rlike("^[0-9]{1,9}$"), text.cast("long"))).withColumn("_one", (F.coalesce("_n", F.lit(0)) == 1) & F.col("_text").isNotNull())
    found = [
        finding(read.filter("not _one"), "HOURS_NOT_FOUND", "INFO", F.coalesce("_n", F.lit(0))),
        finding(read.filter("_one and _value is null"), "HOURS_UNREADABLE", "INFO", text),
        finding(read.filter("_one and _value is not null and hours is null"), "EXPECTED_HOURS_MISSING", "INFO", F.col("_value")),
        finding(read.filter("_one and _value <> hours"), "HOURS_MISMATCH", "FAIL", F.concat_ws("/", "hours", "_value")),
    ]
    return reduce(DataFrame.unionByName, found)


def section_findings(sections: DataFrame, lines: DataFrame, labels: DataFrame, least: int = 4) -> DataFrame:
    """sections(doc, unit, section, pos, norm, kind, content), their lines(doc, unit, section, norm, text) and the document's
    labels(doc, place, norm, text): labels that a unit repeats, lacks, leaves empty or has in another order, and labels
    that stand as a line in another section (of `least` characters or more)."""
    seen = sections.filter("norm is not null")
    double = seen.groupBy("doc", "unit", "norm").agg(F.count("*").alias("_n")).filter("_n > 1")
    placed = seen.join(labels.select("doc", "norm", "place"), ["doc", "norm"])
    units = sections.select("doc", "unit").distinct()
    missing = units.join(labels.select("doc", "place", F.col("text").alias("_label")), "doc").join(placed.select("doc", "unit", "place").distinct(), ["doc", "unit", "place"], "left_anti")
    steps = placed.groupBy("doc", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda x: x["place"]).alias("_order"))
    own = lines.select("doc", "unit", "section", "text", F.col("norm").alias("_line")).filter(F.char_length("_line") >= least)
    leaked = own.join(labels.select("doc", F.col("norm").alias("_line"), F.col("text").alias("_label")), ["doc", "_line"])
    found = [
        finding(double, "DUPLICATE_SECTION", "NEEDS_REVIEW", F.col("norm")),
        finding(missing, "MISSING_SECTION", "NEEDS_REVIEW", F.col("_label")),
        finding(sections.filter("norm is not null and kind <> 'GROUP' and content is null"), "EMPTY_SECTION", "WARNING", F.col("norm")),
        finding(steps.filter("_order <> array_sort(_order)"), "SECTION_ORDER", "NEEDS_REVIEW", F.array_join(F.col("_order").cast("array<string>"), ",")),
        finding(leaked, "SECTION_LEAKAGE", "FAIL", F.col("text")),
    ]
    return reduce(DataFrame.unionByName, found)
