"""Integrity checks. Each returns findings: key columns, code, severity; or the measured columns of the check."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities in rising order, and the alphabet of component letters.
SEVERITIES = ("INFO", "WARNING", "NEEDS_REVIEW", "FAIL")
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyz"


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), severity)


def count_check(units: DataFrame, items: DataFrame, key: str, expected: Column) -> DataFrame:
    """Per unit: expected, found and status. Items are counted before the join, so it meets one row per unit."""
    found = items.groupBy(key).agg(F.count("*").alias("found"), expected.cast("long").alias("expected"))
    status = F.when(F.col("expected").isNull(), "NEEDS_REVIEW").when(F.col("expected") == F.col("found"), "PASS").otherwise("FAIL")
    return units.select(key).join(found, key, "left").select(key, "expected", F.coalesce("found", F.lit(0)).alias("found"), status.alias("status"))


def worst_status(units: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Per unit the status of its worst finding; PASS without any, or with INFO alone."""
    worst = findings.groupBy(key).agg(F.max(severity_rank(F.col("severity"))).alias("_r"))
    status = F.when(F.coalesce("_r", F.lit(1)) <= 1, "PASS").otherwise(F.element_at(F.lit(list(SEVERITIES)), F.col("_r").cast("int")))
    return units.select(key).distinct().join(worst, key, "left").select(key, status.alias("status"))


def finding(df: DataFrame, keys: list[str], code: str, severity: str) -> DataFrame:
    return df.select(*keys, F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def total_check(rows: DataFrame, totals: DataFrame, key: str, part: str, total: str) -> DataFrame:
    """Groups whose parts do not add up to their total row; unusable (null) parts make a group unknown, not wrong."""
    sums = rows.groupBy(key).agg(F.sum(part).alias("parts"), F.bool_and(F.col(part).isNotNull()).alias("usable"))
    return totals.select(key, total).join(sums, key).filter(F.col("usable") & (F.col("parts") != F.col(total))).select(key, "parts", total)


def sequence_gaps(df: DataFrame, key: str, number: str, order: list[str]) -> DataFrame:
    """Rows whose number is not their place within the key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("expected", F.row_number().over(w)).filter(F.col(number) != F.col("expected"))


def order_violations(df: DataFrame, key: str, rank: str, order: list[str]) -> DataFrame:
    """Per key with any: how many rows rank below the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_b", F.lag(rank).over(w)).filter(F.col("_b") > F.col(rank)).groupBy(key).agg(F.count("*").alias("violations"))


def letter_sequence(df: DataFrame, key: str, letter: str, order: list[str]) -> DataFrame:
    """Per key: its letters in order and whether they are the alphabet's first ones."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = df.withColumn("_r", F.row_number().over(w))
    good = F.bool_and(F.col(letter) == F.substring(F.lit(ALPHABET), F.col("_r"), F.lit(1)))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", letter))), lambda x: x[letter]), "")
    return placed.groupBy(key).agg(letters.alias("letters"), good.alias("good"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def cross_reference(declared: DataFrame, given: DataFrame, keys: list[str], missing: str, unknown: str, severity: str = "FAIL") -> DataFrame:
    """Findings for declared keys that are not given, and the other way round."""
    a, b = declared.select(*keys).distinct(), given.select(*keys).distinct()
    return finding(a.join(b, keys, "left_anti"), keys, missing, severity).unionByName(finding(b.join(a, keys, "left_anti"), keys, unknown, severity))


def coverage(all_ids: DataFrame, assigned: list[DataFrame], keys: list[str]) -> DataFrame:
    """Ids that are in no assignment, or in several; an id counts once in each assignment."""
    union = reduce(DataFrame.unionByName, [a.select(*keys).distinct() for a in assigned])
    counts = union.groupBy(*keys).agg(F.count("*").alias("n"))
    held = all_ids.select(*keys).distinct().join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return held.filter("n <> 1").select(*keys, F.when(F.col("n") == 0, "UNASSIGNED_SPANS").otherwise("DOUBLE_ASSIGNED_SPANS").alias("code"))


def not_in_source(fields: DataFrame, sources: DataFrame, key: str, text: str, source: str, ids: list[str], block: int = 64) -> DataFrame:
    """Fields whose text, white space aside, is not part of their source: all columns of fields. ids name a field; their
    last one tells in which block of fields it is.

    A source is cleaned once and meets its fields a block at a time, so it is copied for a block, not for each field.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t-\r]+", "")
    clean = sources.select(key, bare(F.col(source)).alias("_source"))
    packed = fields.select(key, F.expr(f"{ids[-1]} div {block}").alias("_block"), F.struct(bare(F.col(text)).alias("_bare"), *ids).alias("_f")).groupBy(key, "_block").agg(F.collect_list("_f").alias("_fields"))
    missing = packed.join(clean, key).select(F.explode(F.filter("_fields", lambda f: ~F.contains(F.col("_source"), f["_bare"]))).alias("_f")).select(*[F.col(f"_f.{i}").alias(i) for i in ids])
    return fields.join(missing.distinct(), ids)


def subset_pairs(df: DataFrame, group: str, member: str) -> DataFrame:
    """Pairs of groups with whether all members of the first are in the second, by counting shared members. Groups are
    few (columns, kinds), members many."""
    rows = df.select(group, member).distinct()
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    other = rows.withColumnRenamed(group, "other")
    shared = rows.join(other, member).groupBy(group, "other").agg(F.count("*").alias("shared"))
    return shared.filter(F.col(group) != F.col("other")).join(sizes, group).select(group, "other", "shared", "size", (F.col("shared") == F.col("size")).alias("subset"))
