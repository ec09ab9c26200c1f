"""Reconciliation of two sides by keys, names and places."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.status import text_status


def keyed_diff(document: DataFrame, sheet: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Both sides by key with status. A key that a side has twice is left to review, and that side's text stays null, as
    none is picked from several."""
    only = F.when(F.count("*") == 1, F.min(text))
    a = document.groupBy(*keys).agg(F.count("*").alias("_na"), only.alias("document"))
    b = sheet.groupBy(*keys).agg(F.count("*").alias("_nb"), only.alias("sheet"))
    status = (
        F.when((F.col("_na") > 1) | (F.col("_nb") > 1), "İNCELEME_GEREKLİ").when(F.col("_nb").isNull(), "PDF_DE_VAR_EXCELDE_YOK")
        .when(F.col("_na").isNull(), "EXCELDE_VAR_PDF_DE_YOK").otherwise(text_status(F.col("document"), F.col("sheet")))
    )
    return a.join(b, keys, "full_outer").select(*keys, "document", "sheet", status.alias("status"))


def rematch(left: DataFrame, right: DataFrame, keys: list[str], key: str, name: str) -> DataFrame:
    """Rows without a partner by key, paired one to one by name: KOD_FARKLI. Of several with one name the first meets
    the first, the second the second."""
    a = left.join(right.select(*keys, key).distinct(), [*keys, key], "left_anti")
    b = right.join(left.select(*keys, key).distinct(), [*keys, key], "left_anti")
    placed = F.row_number().over(Window.partitionBy(*keys, name).orderBy(key))
    a, b = (x.select(*keys, name, F.col(key).alias(f"{side}_key"), placed.alias("_n")) for x, side in ((a, "left"), (b, "right")))
    return a.join(b, [*keys, name, "_n"]).drop("_n").withColumn("status", F.lit("KOD_FARKLI"))


def count_differs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides have, with other numbers of rows: SAYI_FARKLI."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("document")), right.groupBy(*keys).agg(F.count("*").alias("sheet"))
    return a.join(b, keys).filter("document <> sheet").withColumn("status", F.lit("SAYI_FARKLI"))


def wrong_section(diff: DataFrame, elsewhere: DataFrame, keys: list[str]) -> DataFrame:
    """diff, which has status and sheet, with YANLIŞ_BÖLÜM for texts of the sheet alone that stand in another section:
    elsewhere has the keys and found_in."""
    joined = diff.join(elsewhere.select(*keys, "found_in"), keys, "left")
    return joined.withColumn("status", F.when(F.col("found_in").isNotNull() & (F.col("status") != "AYNI"), "YANLIŞ_BÖLÜM").otherwise(F.col("status")))


def out_of_scope(diff: DataFrame, scope: DataFrame, unit: str) -> DataFrame:
    """diff with KAPSAM_DIŞI as the status of units that scope does not list. Scope is as small as the units are."""
    held = scope.select(unit).distinct().withColumn("_in", F.lit(True))
    return diff.join(held, unit, "left").withColumn("status", F.when(F.col("_in"), F.col("status")).otherwise("KAPSAM_DIŞI")).drop("_in")


def positional_diff(left: DataFrame, right: DataFrame, keys: list[str], place: str, text: str) -> DataFrame:
    """Both sides by place within their keys."""
    joined = left.select(*keys, place, F.col(text).alias("document")).join(right.select(*keys, place, F.col(text).alias("sheet")), [*keys, place], "full_outer")
    status = F.when(F.col("sheet").isNull(), "PDF_DE_VAR_EXCELDE_YOK").when(F.col("document").isNull(), "EXCELDE_VAR_PDF_DE_YOK").otherwise(text_status(F.col("document"), F.col("sheet")))
    return joined.withColumn("status", status)


def set_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with which side has them."""
    both = left.select(*keys).distinct().withColumn("_l", F.lit(1)).unionByName(right.select(*keys).distinct().withColumn("_l", F.lit(2)))
    return both.groupBy(*keys).agg(F.sum("_l").alias("_s")).select(*keys, F.when(F.col("_s") == 3, "AYNI").when(F.col("_s") == 1, "PDF_DE_VAR_EXCELDE_YOK").otherwise("EXCELDE_VAR_PDF_DE_YOK").alias("status"))


def found_elsewhere(missing: DataFrame, fields: DataFrame, scope: str, section: str, key: str, least: int = 20) -> DataFrame:
    """missing rows with the first other section of their scope that has the same key of `least` characters or more.

    Of each key only its first two sections are kept, so a line that a scope repeats is one row.
    """
    other = fields.filter(F.char_length(key) >= least).select(scope, key, section)
    first = other.groupBy(scope, key).agg(F.min(section).alias("_first"))
    second = other.join(first, [scope, key]).filter(F.col(section) > F.col("_first")).groupBy(scope, key).agg(F.min(section).alias("_second"))
    places = first.join(second, [scope, key], "left")
    hit = missing.distinct().join(places, [scope, key])
    found = F.when(F.col("_first") != F.col(section), F.col("_first")).otherwise(F.col("_second"))
    return hit.withColumn("found_in", found).filter("found_in is not null").select(*missing.columns, "found_in")


def plurality(pairs: DataFrame, left: str, right: str, order: Column) -> DataFrame:
    """For each left the right that most pairs name; ties to the one named first."""
    counts = pairs.groupBy(left, right).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "_o", F.col(right).alias("r")))
    return counts.groupBy(left).agg(best.alias("_b")).select(left, F.col("_b.r").alias(right), (-F.col("_b.n")).alias("n"))


def status_counts(df: DataFrame, status: str, statuses: tuple[str, ...]) -> DataFrame:
    """Counts of all statuses, zeros included, with their place in the report."""
    names = df.sparkSession.createDataFrame(list(enumerate(statuses)), f"place int, {status} string")
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    return names.join(counts, status, "left").select("place", status, F.coalesce("n", F.lit(0)).alias("n"))


def default_scope(units: DataFrame, matched: DataFrame, group: str, unit: str) -> DataFrame:
    """Units of the groups that have a matched unit; all units if none is matched."""
    groups = units.join(matched.select(unit), unit, "left_semi").select(group).distinct()
    none = groups.agg((F.count("*") == 0).alias("_none"))
    held = units.join(groups.withColumn("_in", F.lit(True)), group, "left").join(F.broadcast(none))
    return held.filter(F.col("_in") | F.col("_none")).drop("_in", "_none")
