"""Matches that are no plain equality, each brought down to an equality join on something that a match has to share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions.keys import layer_key


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than max_rows rows; else as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def within_edits(labels: DataFrame, vocabulary: DataFrame, label: str, word: str, edits: int = 2, least: int = 8) -> DataFrame:
    """Different pairs of texts of `least` characters or more that are within `edits` edits, with their distance.

    Of edits + 1 pieces of a vocabulary word one is left whole by that many edits, at most that far from its place; so
    pieces are joined with the label's substrings at those places, and the distance is taken of what meets.
    """
    pieces = edits + 1
    v = vocabulary.select(word).distinct().filter(F.char_length(word) >= least)
    v = v.withColumn("_n", F.char_length(word)).select(word, "_n", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("_k"))
    v = v.withColumn("_from", F.floor(F.col("_k") * F.col("_n") / pieces).cast("int")).withColumn("_size", (F.floor((F.col("_k") + 1) * F.col("_n") / pieces) - F.col("_from")).cast("int"))
    v = v.withColumn("_piece", F.expr(f"substring({word}, _from + 1, _size)"))
    shapes = v.select("_n", "_k", "_from", "_size").distinct()
    a = labels.select(label).distinct().filter(F.char_length(label) >= least)
    a = a.withColumn("_n", F.explode(F.expr(f"sequence(char_length({label}) - {edits}, char_length({label}) + {edits})"))).join(F.broadcast(shapes), "_n")
    a = a.withColumn("_shift", F.explode(F.sequence(F.lit(-edits), F.lit(edits)))).filter("_from + _shift >= 0").withColumn("_piece", F.expr(f"substring({label}, _from + _shift + 1, _size)"))
    met = a.join(v.select(word, "_n", "_k", "_piece"), ["_n", "_k", "_piece"]).select(label, word).distinct()
    return met.withColumn("distance", F.levenshtein(F.col(label), F.col(word), edits)).filter("distance >= 0")


def fuzzy_variants(labels: DataFrame, vocabulary: DataFrame, label: str, word: str, edits: int = 2, least: int = 8, long: int = 12) -> DataFrame:
    """Pairs within `edits` edits but not equal, of texts of `least` characters or more; a label below `long` characters
    is allowed one edit alone, as two make another word of it."""
    met = within_edits(labels, vocabulary, label, word, edits, least)
    return met.filter((F.col("distance") > 0) & (F.col("distance") <= F.when(F.char_length(label) < long, 1).otherwise(edits)))


def begins_vocabulary(labels: DataFrame, vocabulary: DataFrame, label: str, word: str, edits: int = 2, least: int = 8) -> DataFrame:
    """Labels (of `least` characters or more) that are still being read: within `edits` edits of the beginning of a
    vocabulary word, a beginning as long as the label or one character longer or shorter. Each once.

    Beginnings are made for the lengths that labels have, of which there are few, and are equal for many words, so each is
    compared once.
    """
    lengths = labels.select(F.char_length(label).alias("_m")).filter(F.col("_m") >= least).distinct().select(F.explode(F.sequence(F.col("_m") - 1, F.col("_m") + 1)).alias("_m")).distinct()
    starts = vocabulary.select(word).distinct().join(F.broadcast(lengths), F.char_length(word) >= F.col("_m")).select(F.expr(f"substring({word}, 1, _m)").alias("_start")).distinct()
    met = within_edits(labels, starts, label, "_start", edits, least - 1).filter((F.char_length(label) >= least) & (F.abs(F.char_length(label) - F.char_length("_start")) <= 1))
    return met.select(label).distinct()


def unique_variant(variants: DataFrame, label: str, word: str) -> DataFrame:
    """Labels with exactly one candidate; the others stay open."""
    return variants.groupBy(label).agg(F.min(word).alias(word), F.min("distance").alias("distance"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def contained_phrases(texts: DataFrame, phrases: DataFrame, tokens: str, phrase: str, phrase_id: str, text_id: list[str], max_broadcast_phrases: int = 200_000) -> DataFrame:
    """Text rows that hold a phrase's tokens in a row: text_id (which names a row), phrase_id, at (place of the first,
    from 0). Both columns are token arrays.

    A phrase is looked for by its rarest token over all texts, so common words meet nothing. What goes through the joins
    is a token with its place; the tokens of a text come in again for the few places that are left.
    """
    p = phrases.filter(F.size(phrase) > 0).select(phrase_id, F.col(phrase).alias("_phrase"))
    spread = texts.select(*text_id, F.posexplode(tokens).alias("_pos", "_token"))
    placed = p.select(phrase_id, "_phrase", F.posexplode("_phrase").alias("_place", "_token"))
    counts = spread.join(small(placed.select("_token").distinct(), max_broadcast_phrases), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = placed.join(counts, "_token").groupBy(phrase_id, "_phrase").agg(F.count("*").alias("_found"), F.min(F.struct("_n", "_token", "_place")).alias("_r"))
    sought = rarest.filter(F.col("_found") == F.size("_phrase")).select(phrase_id, F.size("_phrase").alias("_size"), "_phrase", F.col("_r._token").alias("_token"), F.col("_r._place").alias("_place"))
    met = spread.join(small(sought.drop("_phrase"), max_broadcast_phrases), "_token").withColumn("at", F.col("_pos") - F.col("_place")).filter("at >= 0").select(*text_id, phrase_id, "at", "_size")
    checked = met.join(texts.select(*text_id, F.col(tokens).alias("_tokens")), text_id).withColumn("_here", F.expr("slice(_tokens, at + 1, _size)")).select(*text_id, phrase_id, "at", "_here")
    return checked.join(small(p, max_broadcast_phrases), phrase_id).filter("_here = _phrase").select(*text_id, phrase_id, "at")


def find_in_layer(values: DataFrame, pages: DataFrame, value_id: str, value: str, page_id: str, page: str, least: int = 12, max_broadcast_probes: int = 200_000) -> DataFrame:
    """Values found in a page's text layer, compared as layer_key gives both: value_id, page_id, at.

    Pages are cut into overlapping pieces of the length of a probe, the first `least` characters of a value's key, and
    meet the probes where they are cut; at is the first place in the page's key, from 1. A place goes on without its
    page's text, which comes in again for the places that are left.
    """
    v = values.select(value_id, layer_key(F.col(value)).alias("_key")).filter(F.char_length("_key") >= least).withColumn("_probe", F.substring("_key", 1, least))
    p = pages.select(page_id, layer_key(F.col(page)).alias("_page")).filter(F.char_length("_page") >= least)
    cut = p.select(page_id, F.posexplode(F.regexp_extract_all("_page", F.lit(f"(?s)(?=(.{{{least}}}))"), F.lit(1))).alias("_i", "_probe"))
    met = cut.join(small(v.select(value_id, "_probe"), max_broadcast_probes), "_probe").select(page_id, value_id, "_i")
    held = met.join(p, page_id).join(small(v.select(value_id, "_key"), max_broadcast_probes), value_id).filter(F.expr("substring(_page, _i + 1, char_length(_key)) = _key"))
    return held.groupBy(value_id, page_id).agg((F.min("_i") + 1).cast("int").alias("at"))
