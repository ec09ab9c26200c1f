"""Line-first cleaning rules, in DataFrame functions alone.

Each line is held against punctuation, navigation and boilerplate rules; lines that fail are removed, and a document
that loses too much of its text is rejected. The columns of a document are computed from its own row, so there is no
shuffle and no state that grows with the data; the work is linear in the text but for the sort of a text's windows.
"""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.text import BLANKS, blank_words

SYMBOLS = "#*$%&|<>"

# Phrases of notices and menus.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "use of cookies",
    "enable javascript",
    "lorem ipsum",
    "sign up for our newsletter",
    "subscribe to our",
    "click here",
    "read more",
    "skip to content",
)


@dataclass(frozen=True)
class LineRules:
    """min_line_words: a shorter line needs end punctuation. max_mark_share: marks among a line's non-blank characters.
    max_upper_share: capitals among the letters of a line with min_upper_letters or more. max_separators: menu
    separators in a line. min_kept_share: of the characters of a document's lines, what has to stay."""

    min_line_words: int = 4
    max_mark_share: float = 0.2
    max_upper_share: float = 0.7
    min_upper_letters: int = 20
    max_separators: int = 3
    min_kept_share: float = 0.5


def line_fails(line: Column, rules: LineRules = LineRules()) -> dict[str, Column]:
    """By rule, whether a line with a word fails it."""
    bare = F.btrim(line, F.lit(BLANKS))
    visible = F.regexp_replace(line, r"[ \t-\r]+", "")
    marks = F.char_length(F.regexp_replace(visible, r"[^#*$%&|<>!?{}=_~^+@\\]+", ""))
    letters = F.char_length(F.regexp_replace(visible, r"[^\p{L}]+", ""))
    capitals = F.char_length(F.regexp_replace(visible, r"[^\p{Lu}]+", ""))
    few = F.size(F.split(bare, r"[ \t-\r]+")) < rules.min_line_words
    return {
        "punctuation": (marks > rules.max_mark_share * F.char_length(visible)) | ((letters >= rules.min_upper_letters) & (capitals > rules.max_upper_share * letters)) | (few & ~bare.rlike(r"[.!?:;…。！？\"'”’)\]]$")),
        "navigation": F.regexp_count(bare, F.lit(r"\s[|»›>•·/]\s")) >= rules.max_separators,
        "boilerplate": reduce(or_, [F.lower(bare).contains(x) for x in BOILERPLATE]) | bare.rlike(r"^(©|\(c\) ?[0-9]{4})"),
    }


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), *, into: str = "cleaned") -> DataFrame:
    """Adds what is left of each text (lines joined by newlines), kept_chars and line_chars (of lines with a word).

    A null text stays null with 0 characters. Input columns are kept as they are; columns named like the added ones are
    replaced.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def stays(line: Column) -> Column:
        a, b, c = line_fails(line, rules).values()
        return ~(a | b | c)

    def chars(lines: str) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))

    out = df.withColumn("_lines", lines).withColumn("_good", F.filter("_lines", stays))
    return out.withColumns({into: F.when(F.col(text).isNotNull(), F.array_join("_good", "\n")), "kept_chars": chars("_good"), "line_chars": chars("_lines")}).drop("_lines", "_good")


def _with_repeats(df: DataFrame) -> DataFrame:
    """From _words: n_repeat_words, the words in windows of three that the text has twice or more.

    A window is one long, 40 bits of a hash above 24 bits of its place, so a sort of longs puts equal windows side by
    side. Those whose neighbour has the same 40 bits are sorted once more as text, which settles what is really equal.
    Texts of more than 2^24 windows take the second sort alone.
    """
    window = "concat_ws(' ', _words[{0}], _words[{0} + 1], _words[{0} + 2])"
    return (
        df.withColumn("_n", F.size("_words"))
        .withColumn("_packed", F.expr("if(_n < 4 or _n > 16777216, cast(array() as array<bigint>), sort_array(transform(sequence(0, _n - 3), i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & -16777216L) | i)))"))
        .withColumn("_like", F.expr("if(_n > 16777216, sequence(0L, _n - 3L), filter(_packed, (x, k) -> shiftright(x, 24) = shiftright(get(_packed, k + 1), 24) or shiftright(x, 24) = shiftright(get(_packed, k - 1), 24)))"))
        .withColumn("_exact", F.expr(f"sort_array(transform(transform(_like, x -> cast(x & 16777215L as int)), i -> struct({window.format('i')} as w, i as i)))"))
        .withColumn("_same", F.expr("filter(_exact, (x, k) -> x.w = get(_exact, k + 1).w or x.w = get(_exact, k - 1).w)"))
        .withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(_same, x -> array(x.i, x.i + 1, x.i + 2))))) as bigint)"))
        .drop("_packed", "_like", "_exact", "_same")
    )


def quality_rules(df: DataFrame, id_column: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    kept_chars, line_chars and cleaned (what the line rules leave).

    A null or empty text has no words and fails the base rule. Repeated rows give repeated results; an empty table gives
    none. Only the two named columns are read, so extra columns and their names do not matter.
    """
    source = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    made = _with_repeats(source.withColumn("_words", blank_words(F.col("_text"))))
    held = "filter(split(coalesce(_text, ''), '\n'), x -> btrim(x, ' \t\n\x0b\f\r') <> '')"
    counted = made.withColumn("_held", F.expr(held)).withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(F.coalesce("_text", F.lit("")), r"[ \t-\r]+", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(F.coalesce("_text", F.lit("")), r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_held") - F.size(F.array_distinct("_held"))).cast("long"),
    }).drop("_words", "_held")
    out = clean_lines(counted, "_text", rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("kept_chars") >= rules.min_kept_share * F.col("line_chars"))
    return out.select(F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "kept_chars", "line_chars", "cleaned")
