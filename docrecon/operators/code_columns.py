"""Which category or section a code or a column belongs to: joins with a rank, one match winning over the others.

used(scope..., lo, prefix, segments) are codes of an outcome's application; declared(scope..., place, category, prefix, segments,
entry) the codes that a unit declares, place being their order and category the path of the section that they stand in.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.keys import FOLD_FROM, FOLD_TO, norm_label, strip_parens
from docrecon.functions.labels import FIELD_SKILL_HINTS, names_any

# Which column of the sheet holds the codes of which section, by what the section's name holds; the least
# length of a label that a longer header may begin with; and the label whose section may stand without it.
CODE_COLUMNS = {
    "Beceriler Arası İlişkiler (Alan/Kavramsal Beceriler)": ("kavramsal", "becerilerarasi"),
    "Erdem-Değer-Eylem Çerçevesi": ("degerler",),
    "Eğilimler": ("egilimler",),
    "Okuryazarlık Becerileri": ("okuryazarlik",),
    "Sosyal-Duygusal Öğrenme Becerileri": ("sosyalduygusal",),
}
LEAST_LABEL = 8
APPLICATIONS = "Öğrenme-Öğretme Uygulamaları"


def last_part(path: Column) -> Column:
    """The last component of a path such as `A > B`."""
    return F.trim(F.element_at(F.split(path, ">"), -1))


def is_field_skills(path: Column) -> Column:
    """Whether a section declares field skills, which code checks leave out."""
    return names_any(last_part(path), FIELD_SKILL_HINTS)


def field_skill_prefixes(declared: DataFrame) -> DataFrame:
    return declared.filter(is_field_skills(F.col("category"))).select("prefix").distinct()


def folded_name(c: Column) -> Column:
    """A name's letters and digits alone, folded to ASCII."""
    return F.translate(norm_label(c), FOLD_FROM, FOLD_TO)


def code_categories(used: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """Different rows of used with category, entry and how: exact (a declared code is the same; the last such declaration
    counts, and its text is the entry), cover (the first declared code that the used one is part of), prefix (the first of
    the same prefix) or null.

    Codes and declarations are dealt out once, by scope and prefix, and meet in one join. What a scope declares of a prefix is one
    row there: a map by first segment of maps by code, in which a used code looks up its leading parts. Codes go there as texts; only
    segments that their text does not give back go beside it.
    """
    keys, code = [*scope, "prefix"], lambda c: F.concat(F.array_join(c, "\x1f", "\x00"), F.lit("\x1e"), F.size(c))
    one = F.substring_index(F.substring_index("_code", "\x1f", 1), "\x1e", 1)
    told_by = F.split(F.substring_index("_code", "\x1e", 1), "\x1f")
    known = declared.filter(code(F.col("segments")).isNotNull()).dropna(subset=keys).select(*keys, code(F.col("segments")).alias("_code"), "place", "category", "entry").repartition(*keys)
    told = known.withColumn("_one", one).groupBy(*keys, "_one", "_code").agg(F.min(F.struct("place", "category")).alias("first"), F.max(F.struct("place", "category", "entry")).alias("last"))
    parts = told.groupBy(*keys, "_one").agg(F.map_from_entries(F.collect_list(F.struct("_code", F.struct("first", "last")))).alias("_codes"), F.min("first").alias("_some"))
    own = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_one", "_codes"))).alias("_known"), F.min("_some").alias("_some"))
    rows = used.withColumn("_code", code(F.col("segments"))).withColumn("_odd", F.when(~told_by.eqNullSafe(F.col("segments")), F.col("segments"))).drop("segments")
    found = rows.repartition(*keys).distinct().join(own.hint("shuffle_hash"), keys, "left").withColumn("segments", F.coalesce("_odd", told_by))
    # first the maps of a code's first segment and of none, so that no row carries all that its scope declares
    found = found.select(*used.columns, "_some", "_code", F.try_element_at("_known", F.coalesce(one, F.lit(""))).alias("_here"), F.try_element_at(F.try_element_at("_known", F.lit("")), code(F.array().cast("array<string>")))["first"].alias("_every"))
    exact = F.try_element_at("_here", F.col("_code"))["last"]
    covers = F.transform(F.sequence(F.lit(1), F.greatest(F.size("segments"), F.lit(1))), lambda n: F.try_element_at("_here", code(F.slice("segments", F.lit(1), n)))["first"])
    found = found.withColumns({"_exact": exact, "_cover": F.least(F.array_min(covers), "_every")})
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_cover").isNotNull(), "cover").when(F.col("_some").isNotNull(), "prefix")
    return found.select(*used.columns, F.coalesce("_exact.category", "_cover.category", "_some.category").alias("category"), F.col("_exact.entry").alias("entry"), how.alias("how"))


def column_codes(categories: DataFrame, columns: dict[str, tuple[str, ...]] = CODE_COLUMNS) -> DataFrame:
    """code_categories with the columns (header) that a code falls into: those of which a word is in its category's name. A code
    without a column is left out."""
    # the name once a row; no filter on the category, which would be worked out a second time for it
    named = categories.withColumn("_name", folded_name(last_part(F.col("category"))))
    headers = F.array_compact(F.array(*(F.when(F.exists(F.lit(list(words)), lambda w: F.contains("_name", w)), header) for header, words in columns.items())))
    return named.withColumn("header", F.explode(headers)).drop("_name")


def declared_entries_of(used: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """used with the entry of the first declaration of exactly its code, else null."""
    code = F.array_join("segments", ".")
    first = declared.groupBy(*scope, "prefix", code.alias("_code")).agg(F.min_by("entry", "place").alias("entry"))
    return used.withColumn("_code", code).join(first, [*scope, "prefix", "_code"], "left").select(*used.columns, "entry")


def placed_undeclared(undeclared: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """Codes that are used but not declared, in the one category that they can belong to: the only one with codes of the
    prefix, else the only one with codes of the prefix and the same first number. Field skills are no category; a code with no
    or several candidates is left out, as nothing is guessed."""
    number = lambda c: F.coalesce(F.get(F.filter(c, lambda x: x.rlike("^[0-9]+$")), 0), F.lit(""))
    keys = [*scope, "prefix"]
    known = declared.filter(~is_field_skills(F.col("category"))).withColumn("_number", number(F.col("segments")))
    by_prefix = known.groupBy(*keys).agg(F.count_distinct("category").alias("_n"), F.min("category").alias("_only"))
    by_number = known.groupBy(*keys, "_number").agg(F.count_distinct("category").alias("_m"), F.min("category").alias("_same"))
    rows = undeclared.withColumn("_number", number(F.col("segments")))
    met = rows.join(by_prefix, keys).join(by_number, [*keys, "_number"], "left")
    chosen = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_m") == 1, F.col("_same"))
    return met.withColumn("category", chosen).filter("category is not null").select(*undeclared.columns, "category")


def header_sections(headers: DataFrame, sections: DataFrame, unit: list[str]) -> DataFrame:
    """Per unit and header (of headers(header)) the section that it means: unit..., header, pos. sections(unit..., pos, key,
    kind) have their label's key; groups and sections without one mean none.

    A header means the section of its own key, else that of the longest label of LEAST_LABEL characters or more that it begins
    with; the first of equal ones. One that begins as the applications' label and finds none means the first applications
    section. A header's beginnings are made for the lengths that labels have, so this is an equality join.
    """
    own = headers.select("header").distinct().withColumn("_key", norm_label(strip_parens(F.col("header"))))
    named = sections.filter("key <> '' and coalesce(kind, '') <> 'group'")
    lengths = named.select(F.char_length("key").alias("_n")).distinct()
    begun = own.join(F.broadcast(lengths), (F.col("_n") == F.char_length("_key")) | ((F.col("_n") < F.char_length("_key")) & (F.col("_n") >= LEAST_LABEL)))
    starts = begun.select("header", F.expr("substring(_key, 1, _n)").alias("key"))
    found = named.join(starts, "key").groupBy(*unit, "header").agg(F.max_by("pos", F.struct(F.char_length("key"), -F.col("pos"))).alias("pos"))
    left = own.filter(F.startswith("_key", norm_label(F.lit(APPLICATIONS)))).select("header", F.lit("applications").alias("kind"))
    others = sections.groupBy(*unit, "kind").agg(F.min("pos").alias("pos")).join(F.broadcast(left), "kind").select(*unit, "header", "pos")
    return found.unionByName(others.join(found.select(*unit, "header"), [*unit, "header"], "left_anti"))
