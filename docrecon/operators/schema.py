"""What a document says about its own structure, by votes over its units. Learned rows are joined back by document; they
never pass through the driver."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.keys import label_word_key, norm_label
from docrecon.operators.matching import fuzzy_variants
from docrecon.operators.votes import first_seen_mode


def learn_labels(lines: DataFrame, doc: str, unit: str, pos: str, text: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """Labels of a document: keys that stand in at least max(least, share of its units) units, with their most frequent
    spelling (ties to the first seen), the units that have them, and their place by mean rank (ties by key)."""
    rows = lines.withColumn("key", norm_label(F.col(text))).filter("key <> ''")
    units = lines.groupBy(doc).agg(F.countDistinct(unit).alias("_units"))
    votes = rows.groupBy(doc, "key").agg(F.countDistinct(unit).alias("units"), F.avg(pos).alias("_mean"))
    kept = votes.join(units, doc).filter(F.col("units") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("_units")))
    spelling = first_seen_mode(rows, [doc, "key"], text, [unit, pos]).select(doc, "key", F.col(text).alias("label"))
    return kept.join(spelling, [doc, "key"]).withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("_mean", "key"))).select(doc, "key", "label", "units", "place")


def confirmed_values(rows: DataFrame, vocabulary: DataFrame, doc: str, value: str, key: str, least: int = 2) -> DataFrame:
    """Values (colours, sizes) under which at least `least` different vocabulary keys of the document stand."""
    return rows.join(vocabulary.select(doc, key).distinct(), [doc, key]).groupBy(doc, value).agg(F.countDistinct(key).alias("hits")).filter(F.col("hits") >= least)


def code_scheme(codes: DataFrame, doc: str, unit: str, group: str, place: str, number: str) -> DataFrame:
    """How a document numbers its units: whether numbers follow the place among all units or within the group, by which
    fits more units; ties go to all units."""
    per_group = F.row_number().over(Window.partitionBy(doc, group).orderBy(place, unit))
    overall = F.row_number().over(Window.partitionBy(doc).orderBy(place, unit))
    placed = codes.withColumns({"_g": per_group, "_a": overall})
    fits = placed.groupBy(doc).agg(F.sum((F.col("_a") == F.col(number)).cast("int")).alias("fits_all"), F.sum((F.col("_g") == F.col(number)).cast("int")).alias("fits_group"), F.count("*").alias("units"))
    return fits.withColumn("scheme", F.when(F.col("fits_all") >= F.col("fits_group"), "all").otherwise("group"))


def resolve_labels(labels: DataFrame, vocabulary: DataFrame, text: str, word: str) -> DataFrame:
    """Each label with what it resolves to and how: the same key, else the same words without connecting ones (where
    only one vocabulary word has them), else nothing. Near spellings are a join of their own (fuzzy_variants)."""
    exact = vocabulary.select(norm_label(F.col(word)).alias("_k"), F.col(word).alias("_e")).groupBy("_k").agg(F.min("_e").alias("_e"))
    loose = vocabulary.select(norm_label(label_word_key(F.col(word))).alias("_l"), F.col(word).alias("_w")).groupBy("_l").agg(F.min("_w").alias("_w"), F.countDistinct("_w").alias("_n")).filter("_n = 1").drop("_n")
    keyed = labels.withColumns({"_k": norm_label(F.col(text)), "_l": norm_label(label_word_key(F.col(text)))})
    kind = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_w").isNotNull(), "connector").otherwise("unknown")
    return keyed.join(exact, "_k", "left").join(loose, "_l", "left").select(*labels.columns, F.coalesce("_e", "_w").alias("resolved"), kind.alias("kind"))


def label_groups(keys: DataFrame, doc: str, key: str, first: str, least: int = 12) -> DataFrame:
    """keys(doc, key, first: where it is seen first) -> doc, key, group: a key of `least` characters or more joins the
    earliest key seen before it that has the same digits and is within two edits and in no other group; else it is a
    group of its own."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    long = keys.filter(F.char_length(key) >= least)
    near = fuzzy_variants(long, long.select(F.col(key).alias("_other")), key, "_other", least=1, long=0)
    pairs = near.filter(digits(F.col(key)) == digits(F.col("_other"))).select(key, "_other")
    earlier = keys.select(doc, F.col(key).alias("_other"), F.col(first).alias("_before"))
    found = keys.join(pairs, key).join(earlier, [doc, "_other"]).filter(F.col("_before") < F.col(first)).select(doc, key, "_other", "_before")
    joined = found.select(doc, key).distinct()
    heads = found.join(joined.withColumnRenamed(key, "_other"), [doc, "_other"], "left_anti")
    chosen = heads.groupBy(doc, key).agg(F.min(F.struct("_before", "_other")).alias("_h"))
    return keys.join(chosen, [doc, key], "left").select(doc, key, F.coalesce("_h._other", F.col(key)).alias("group"))


def recurring_unknown(labels: DataFrame, doc: str, unit: str, order: str, text: str, share: float = 0.8) -> DataFrame:
    """Unknown labels that stand in at least max(2, share of a document's units) units: one LABEL_NOT_IN_STRUCTURE each
    instead of one finding per unit (INFO where all units have it, else NEEDS_REVIEW), and one LABEL_TEXT_VARIANT for each
    unit that spells it in another way than most. Columns: doc, code, unit (null for the document), label, units, severity.
    """
    keyed = labels.withColumns({"_key": label_word_key(F.col(text)), "_norm": norm_label(F.col(text))}).filter("_key <> ''")
    seen = keyed.groupBy(doc, "_key").agg(F.min(F.struct(order, text)).alias("_first"))
    grouped = keyed.join(label_groups(seen, doc, "_key", "_first"), [doc, "_key"])
    total = labels.groupBy(doc).agg(F.countDistinct(unit).alias("_units"))
    counts = grouped.groupBy(doc, "group").agg(F.countDistinct(unit).alias("units")).join(total, doc)
    kept = counts.filter(F.col("units") >= F.greatest(F.lit(2), F.ceil(F.lit(int(share * 100)) * F.col("_units") / 100)))
    main = first_seen_mode(grouped, [doc, "group"], "_norm", [order, text]).select(doc, "group", F.col("_norm").alias("_main"))
    spelled = grouped.join(kept, [doc, "group"]).join(main, [doc, "group"])
    whole = spelled.filter("_norm = _main").groupBy(doc, "group", "units", "_units").agg(F.min(F.struct(order, text)).alias("_f"))
    severity = F.when(F.col("units") == F.col("_units"), "INFO").otherwise("NEEDS_REVIEW")
    once = whole.select(doc, F.lit("LABEL_NOT_IN_STRUCTURE").alias("code"), F.lit(None).cast(labels.schema[unit].dataType).alias(unit), F.trim(F.col(f"_f.{text}")).alias("label"), "units", severity.alias("severity"))
    variants = spelled.filter("_norm <> _main").select(doc, F.lit("LABEL_TEXT_VARIANT").alias("code"), unit, F.col(text).alias("label"), F.lit(1).cast("long").alias("units"), F.lit("NEEDS_REVIEW").alias("severity"))
    return once.unionByName(variants)
