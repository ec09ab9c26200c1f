"""Hierarchical codes such as `MAT.5.1.2.`: parsing, shapes and the cover relation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.keys import dehyphen

SEGMENT = r"\p{L}+[0-9]*|[0-9]+"
#: What parts the words that codes are looked for in: anything but letters, digits, low lines and full stops. A comma before
#: a digit parts nothing, as it may stand where a full stop should.
BETWEEN = r"[^\p{L}\p{N}_.,]+|,(?![0-9])"
#: Most letters of a code's prefix.
LETTERS = 5
PARENTHESES = r"\([^()]*\)"


def code_prefix(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"^\s*(\p{L}+)", 1), F.lit(""))


def code_segments(raw: Column) -> Column:
    """Segments after the prefix, numbers without leading zeros; null where there are none."""
    rest = F.regexp_replace(raw, r"^\s*\p{L}+", "")
    found = F.regexp_extract_all(rest, F.lit(SEGMENT), F.lit(0))
    clean = F.transform(found, lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+(?=[0-9])", "")).otherwise(x))
    return F.when(F.size(found) > 0, clean)


def segment_types(segments: Column) -> Column:
    """n for a number, a for anything else."""
    return F.transform(segments, lambda x: F.when(x.rlike("^[0-9]+$"), "n").otherwise("a"))


def normalized_code(prefix: Column, segments: Column) -> Column:
    return F.concat_ws(".", prefix, F.array_join(segments, "."))


def code_shape(raw: Column) -> Column:
    """Runs of capitals as A and of digits as N."""
    return F.regexp_replace(F.regexp_replace(raw, r"\p{Lu}+", "A"), "[0-9]+", "N")


def word_code(word: Column) -> Column:
    """The code that a word (without blanks) begins with: a piece of letters and digits, then pieces of digits between full
    stops; null without one, and where a comma stands for a full stop."""
    pieces = F.split(word, r"\.")
    head, rest = F.get(pieces, 0), F.slice(pieces, 2, F.size(pieces))
    letters = F.regexp_extract(head, r"^\p{L}*", 0)
    good = F.char_length(letters).between(1, LETTERS) & F.substring(head, F.char_length(letters) + 1, F.char_length(head)).rlike("^[0-9]+$")
    stop = F.array_position(F.transform(rest, lambda p: p.rlike("^[0-9]+$")), False).cast("int")
    n = F.when(stop == 0, F.size(rest)).otherwise(stop - 1)
    broken = F.coalesce(F.get(rest, n), F.lit("")).rlike("^[0-9]+,")
    return F.when(good & ~broken, F.array_join(F.concat(F.array(head), F.slice(rest, 1, n)), "."))


def used_codes(text: Column, known: list[str], lo_prefix: str | None = None) -> Column:
    """Codes of a text in its order: in parentheses those whose prefix is all capitals, anywhere those of a known prefix.

    Decided place by place on the text in which line ends break no code. Codes of outcomes (lo_prefix) and those with a
    comma for a full stop are left out; the latter are malformed_codes.
    """
    view, prefix = dehyphen(text), lambda x: F.regexp_extract(x, r"^\p{L}+", 0)
    outside, inside = F.split(view, PARENTHESES, -1), F.regexp_extract_all(view, F.lit(PARENTHESES), F.lit(0))
    found = lambda part: F.array_compact(F.transform(F.split(part, BETWEEN), word_code))
    is_known = lambda x: prefix(x).isin(*known) if known else F.lit(False)
    parts = F.transform(F.arrays_zip(outside.alias("o"), inside.alias("i")), lambda p: F.concat(F.filter(found(p["o"]), is_known), F.coalesce(F.filter(found(p["i"]), lambda x: is_known(x) | (F.upper(prefix(x)) == prefix(x))), F.array().cast("array<string>"))))
    return F.filter(F.flatten(parts), lambda x: prefix(x) != F.lit(lo_prefix or ""))


def malformed_codes(text: Column, known: list[str]) -> Column:
    """Broken spellings of codes in parentheses, as they stand: `KB2,4`, or a known prefix without a number at an entry's
    end."""
    entries = F.transform(F.regexp_extract_all(dehyphen(text), F.lit(PARENTHESES), F.lit(0)), lambda x: F.split(F.btrim(x, F.lit("()")), ",(?![0-9])"))
    letters = lambda w: F.regexp_extract(w, r"^\p{L}*", 0)
    comma = lambda w: F.contains(w, F.lit(",")) & (F.translate(F.substring(w, F.char_length(letters(w)) + 1, F.char_length(w)), "0123456789.,", "") == "")
    alone = lambda w, last: last & (letters(w) == w)

    def broken(entry):
        words = F.split(F.btrim(entry), r"[^\p{L}\p{N}_.,]+")
        marked = F.transform(words, lambda w, i: F.when(letters(w).isin(*known) & (comma(w) | alone(w, i == F.size(words) - 1)), w))
        return F.array_compact(marked)

    if not known:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.flatten(F.transform(F.flatten(entries), broken))


def sort_key(prefix: Column, segments: Column) -> list[Column]:
    """Order by prefix, numeric segments (anything else as 0), then the segments as text."""
    return [prefix, F.transform(segments, lambda x: F.coalesce(F.try_to_number(x, F.lit("9999999999")), F.lit(0)).cast("long")), segments]


def code_places(codes: DataFrame, prefix: str, segments: str) -> DataFrame:
    """Adds place, the dense rank of a code in the order of sort_key, equal codes sharing one.

    Distinct keys are ranked within their prefix and first number; each such group begins after those before it, whose
    sizes are one row a group.
    """
    order = {f"_s{i}": x for i, x in enumerate(sort_key(F.col(prefix), F.col(segments)))}
    own, names, group = codes.withColumns(order), list(order), ["_s0", "_g"]
    keys = own.select(*names).distinct().withColumn("_g", F.get("_s1", F.lit(0)))
    ranked = keys.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*names)))
    sizes = ranked.groupBy(*group).agg(F.max("_r").alias("_n"))
    before = sizes.select(*[F.col(g).alias(f"{g}_") for g in group], (F.sum("_n").over(Window.orderBy(*group)) - F.col("_n")).alias("_before"))
    placed = ranked.join(before, F.expr("_s0 <=> _s0_ and _g <=> _g_")).select(*[F.col(n).alias(f"{n}_") for n in names], (F.col("_r") + F.col("_before")).cast("int").alias("place"))
    return own.join(placed, F.expr(" and ".join(f"{n} <=> {n}_" for n in names)), "left").select(*codes.columns, "place")


def uncovered(used: DataFrame, declared: DataFrame, scope: list[str], prefix: str = "prefix", segments: str = "segments") -> DataFrame:
    """Rows of used that no declared code of the same scope covers (same prefix, its segments a leading part of theirs).

    Every leading part of a used code is one row, so the prefix relation becomes an equality join; the rows are as many
    as the codes have segments.
    """
    marked = used.withColumn("_row", F.struct(*[F.col(c) for c in used.columns]))
    parts = marked.select("_row", *scope, F.col(prefix).alias("_prefix"), F.explode(F.expr(f"transform(sequence(1, size({segments})), n -> slice({segments}, 1, n))")).alias("_part"))
    held = declared.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col(prefix).alias("_p"), F.col(segments).alias("_s")).distinct()
    same = (F.col("_prefix") == F.col("_p")) & (F.col("_part") == F.col("_s"))
    for c in scope:
        same = same & (F.col(c) == F.col(f"_{c}"))
    covered = parts.join(held, same, "left_semi").select("_row").distinct()
    return marked.join(covered, "_row", "left_anti").drop("_row")


def uncovering(declared: DataFrame, used: DataFrame, scope: list[str], prefix: str = "prefix", segments: str = "segments") -> DataFrame:
    """Rows of declared that cover no used code of the same scope."""
    parts = used.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col(prefix).alias("_p"), F.explode(F.expr(f"transform(sequence(1, size({segments})), n -> slice({segments}, 1, n))")).alias("_s")).distinct()
    same = (F.col(prefix) == F.col("_p")) & (F.col(segments) == F.col("_s"))
    for c in scope:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return declared.join(parts, same, "left_anti")
