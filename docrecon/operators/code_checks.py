"""What a unit's categories declare against what its applications use, and where an undeclared code should stand.

used(scope..., prefix, segments) and declared(scope..., place, category, prefix, segments) as in code_columns. Repeated rows count
once; a declared code that a category repeats stands at its first place. Rows without prefix or segments name no code.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.codes import uncovered
from docrecon.operators.code_columns import field_skill_prefixes, is_field_skills, placed_undeclared
from docrecon.operators.scans import kept

#: Fixed value: the category of undeclared codes that fit no single category.
UNPLACED = "(kategorisi belirlenemeyen)"


def code_text(prefix: Column, segments: Column) -> Column:
    """A code as it is written: digits follow the letters at once, letters a full stop."""
    return F.concat(prefix, F.when(F.get(segments, 0).rlike("^[0-9]"), "").otherwise("."), F.array_join(segments, "."))


def codes_only(rows: DataFrame) -> DataFrame:
    return rows.filter("prefix is not null and size(segments) > 0")


def undeclared_codes(used: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """Different used codes that no declaration of their scope covers, with incomplete: shorter than every declared code
    of their prefix anywhere. Those of a field skill's prefix are left out."""
    own, given = codes_only(used).select(*scope, "prefix", "segments").distinct(), codes_only(declared)
    least = given.groupBy("prefix").agg(F.min(F.size("segments")).alias("_least"))
    rows = uncovered(own, given, scope).join(field_skill_prefixes(given), "prefix", "left_anti").join(least, "prefix", "left")
    return rows.select(*scope, "prefix", "segments", (F.size("segments") < F.coalesce("_least", F.lit(0))).alias("incomplete"))


def _leading_parts(codes: DataFrame, scope: list[str]) -> DataFrame:
    return codes.select(*scope, "prefix", F.col("segments").alias("whole"), F.explode(F.expr("transform(sequence(1, size(segments)), n -> slice(segments, 1, n))")).alias("segments"))


def code_roles(used: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., category, role, place, code: a category's declared and unused codes (by their place) and the used and
    undeclared ones (place null). Field skills are no category; an undeclared code without a single category has UNPLACED. A code
    may cover, and be covered, in several categories."""
    given, own = codes_only(declared), codes_only(used).select(*scope, "prefix", "segments").distinct()
    code = code_text(F.col("prefix"), F.col("segments"))
    held = given.filter(~F.coalesce(is_field_skills(F.col("category")), F.lit(False))).groupBy(*scope, "category", "prefix", "segments").agg(F.min("place").alias("place"))
    held = kept(held, "held")
    parts = _leading_parts(own, scope)
    hit = parts.select(*scope, "prefix", "segments").distinct()
    met = parts.join(held, [*scope, "prefix", "segments"]).select(*scope, "category", "prefix", F.col("whole").alias("segments")).distinct()
    missing = kept(undeclared_codes(used, declared, scope).filter("not incomplete").drop("incomplete"), "undeclared")
    placed = placed_undeclared(missing, given, scope)
    loose = missing.join(placed.select(*scope, "prefix", "segments"), [*scope, "prefix", "segments"], "left_anti").withColumn("category", F.lit(UNPLACED))
    nowhere = F.lit(None).cast(held.schema["place"].dataType)
    role = lambda rows, name, place: rows.select(*scope, "category", F.lit(name).alias("role"), place.alias("place"), code.alias("code"))
    found = role(held, "declared", F.col("place")).unionByName(role(held.join(hit, [*scope, "prefix", "segments"], "left_anti"), "unused", F.col("place")))
    return found.unionByName(role(met, "used", nowhere)).unionByName(role(placed.unionByName(loose), "undeclared", nowhere))


def code_checks(roles: DataFrame, scope: list[str]) -> DataFrame:
    """Per unit and category what a reviewer reads: declared, used (with the undeclared ones last), unused and undeclared,
    joined by `, `; codes by place, then by text. A cell names the different codes of one category of one unit."""
    by = F.array_sort(F.collect_list(F.struct("role", "place", "code")))
    rows = roles.groupBy(*scope, "category").agg(by.alias("_all"))

    def of_role(name):
        return F.filter("_all", lambda x: x["role"] == name)

    def joined(*names):
        own = F.concat(*(of_role(n) for n in names))
        return F.array_join(F.transform(own, lambda x: x["code"]), ", ")

    return rows.select(*scope, "category", joined("declared").alias("declared"), joined("used", "undeclared").alias("used"), joined("unused").alias("unused"), joined("undeclared").alias("undeclared"))


def declaring_sections(undeclared: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """Where each undeclared code should have been declared: the category that it is placed in (how: placed), else every category
    of its unit with codes of its prefix (prefix; all are candidates, none is chosen), else null."""
    keys, given = [*scope, "prefix"], codes_only(declared)
    rows = undeclared.select(*scope, "prefix", "segments").distinct()
    placed = placed_undeclared(rows, given, scope)
    left = rows.join(placed.drop("category"), [*keys, "segments"], "left_anti").join(given.select(*keys, "category").distinct().withColumn("how", F.lit("prefix")), keys, "left")
    return placed.withColumn("how", F.lit("placed")).unionByName(left.select(*placed.columns, "how"))
