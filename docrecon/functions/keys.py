"""Match keys and text views as column expressions. The raw text is never changed; keys stand beside it.

Regular expressions are written with \\p classes, as Java's own classes are ASCII only.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose case differs in Turkish, letters that are folded to ASCII, connecting words,
# what counts as a hyphen and which quotes are one in a text layer, and a placeholder that empty cells of the spreadsheet
# carry.
DOTTED, DOTLESS = "İI", "iı"
FOLD_FROM, FOLD_TO = "ğşçöüı", "gscoui"
CONNECTORS = ("and", "ve", "ile")
HYPHENS = "-\u00ad–—"
QUOTES_FROM, QUOTES_TO = "“”„«»‘’ʻ`", '"' * 5 + "'" * 4
PLACEHOLDER = r"Sayfa\(lar\)/e-içerik\(ler\):"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: White space of any script, as Java's own class is ASCII only.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def composed(c: Column) -> Column:
    """Composed characters (NFC) by the library that Spark's own collations use. Texts below U+0300 are composed as they
    are, so few reach it; null stays null. Catalyst takes the call for one that may vary, so it stands in a projection,
    before an aggregate or a join that uses it."""
    def run(x):
        return F.when(x.rlike(r"[^\x00-\x{2ff}]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))).otherwise(x)

    # as the one element of an array, c is computed once, whatever stands in it
    return F.get(F.transform(F.array(c), run), 0)


def tr_lower(c: Column) -> Column:
    """Composed, in lower case as in Turkish: İ to i and I to ı before anything else."""
    return F.lower(F.translate(composed(c), DOTTED, DOTLESS))


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(composed(c), DOTLESS, DOTTED))


def norm_label(c: Column) -> Column:
    """Letters and digits alone, lower case, dotless i as i."""
    return F.translate(F.regexp_replace(tr_lower(c), r"[^\p{L}\p{N}]", ""), "ı", "i")


def ordinal_token(c: Column) -> Column:
    """Whether a token is a number or a Roman numeral of i, v and x."""
    return c.rlike(r"^(\p{Nd}+|[ivx]+)$")


def label_tokens(c: Column) -> Column:
    """The words of a text, each as norm_label gives it; the text is folded once, not word by word."""
    folded = F.translate(tr_lower(c), "ı_", "i")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def layer_key(c: Column) -> Column:
    """A text as it is looked for in a page's text layer: composed, without white space and hyphens, lower case, one kind
    of quotes, dotless i as i. Other punctuation stays."""
    bare = F.regexp_replace(F.translate(composed(c), HYPHENS, ""), f"{SPACE}+", "")
    return F.translate(F.lower(F.translate(bare, DOTTED, DOTLESS)), QUOTES_FROM + "ı", QUOTES_TO + "i")


def squeeze(c: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def compare_key(c: Column) -> Column:
    """Composed, soft hyphens gone, words joined over a line's end, hyphens gone, white space squeezed."""
    joined = F.regexp_replace(F.translate(composed(c), "\u00ad", ""), rf"-[ \t]*\n{SPACE}*", "")
    return squeeze(F.translate(joined, "-", ""))


#: What a code may be broken by at a line's end: a hyphen after a letter or digit, or the line's end between a code's
#: full stop and its next number.
_NUMBER, _BROKEN = "[0-9]{1,9}", r"\.(?:[ \t]{0,3}\n\s{0,5})?"
_HEADS = "|".join(rf"\p{{L}}{{1,5}}{_NUMBER}{(_BROKEN + _NUMBER) * more}\." for more in range(5))
LINE_BREAK = rf"(?<=[\p{{L}}\p{{N}}])-[ \t]*\n[ \t]*|(?<=(?<![\p{{L}}\p{{N}}_.])(?:{_HEADS}))[ \t]*\n\s*(?=[0-9])"


def dehyphen(c: Column) -> Column:
    """The view in which codes are looked for: words and codes that a line's end breaks are joined; nothing else changes."""
    return F.when(F.contains(c, F.lit("\n")), F.regexp_replace(c, LINE_BREAK, "")).otherwise(c)


def dehyphen_places(c: Column) -> Column:
    """For each character of dehyphen(c), its place in the text (from 0)."""
    kept, left_out = F.split(c, LINE_BREAK, -1), F.regexp_extract_all(c, F.lit(LINE_BREAK), F.lit(0))
    sizes = F.arrays_zip(F.transform(kept, F.char_length).alias("n"), F.transform(left_out, F.char_length).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("runs"))

    def step(acc, x):
        return F.struct((acc["at"] + x["n"] + F.coalesce(x["gap"], F.lit(0))).alias("at"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), x["n"].alias("n")))).alias("runs"))

    runs = F.filter(F.aggregate(sizes, start, step)["runs"], lambda x: x["n"] > 0)
    broken = F.flatten(F.transform(runs, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    whole = F.when(F.char_length(c) > 0, F.sequence(F.lit(0), F.char_length(c) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.contains(c, F.lit("\n")), broken).otherwise(whole)


def visible(c: Column) -> Column:
    """Without control characters."""
    return F.regexp_replace(c, CONTROL, "")


def safe_cell(c: Column) -> Column:
    """Control characters as the replacement character, for spreadsheet writers."""
    return F.regexp_replace(c, CONTROL, "�")


def strip_parens(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))


def ascii_norm(c: Column) -> Column:
    return F.translate(tr_lower(c), FOLD_FROM, FOLD_TO)


def strip_placeholder(c: Column) -> Column:
    """Without the placeholder, trimmed; null as the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(c, PLACEHOLDER, "")), F.lit(""))


def short(c: Column, n: int = 60) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def label_word_key(c: Column) -> Column:
    """A label's words without connecting ones, joined, dotless i as i."""
    words = F.regexp_extract_all(tr_lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.translate(F.array_join(F.filter(words, lambda x: ~x.isin(*CONNECTORS)), ""), "ı", "i")


def without_name_suffix(c: Column) -> Column:
    """The text before a trailing " becerisi", else null."""
    low = tr_lower(c)
    return F.when(low.endswith(" becerisi"), F.substring(c, 1, F.char_length(c) - 9))


def marker_of(c: Column) -> Column:
    """A leading list marker such as `a)`, else the empty text."""
    return F.regexp_extract(c, r"^\s*([a-zçğıöşü]\))", 1)


def safe_name(c: Column, n: int = 80) -> Column:
    """A name that file systems take."""
    return F.rtrim(F.substring(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_"), 1, n))


def font_rank(font: Column) -> Column:
    low = F.lower(font)
    return F.when(low.rlike("bold|semibold|black|heavy"), 2).when(low.rlike("medium"), 1).otherwise(0)


def sentence_note(c: Column) -> Column:
    """Whether a text ends like a sentence (a full stop after something else than a digit) and has four words of two letters."""
    return c.rlike(r"[^0-9]\.\s*$") & (F.size(F.regexp_extract_all(c, F.lit(r"\p{L}{2,}"), F.lit(0))) >= 4)


def page_numbers(c: Column) -> Column:
    """`12-13, 15` as [12, 13, 15]; null where a part is no number or range."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x))
    good = F.forall(parts, lambda x: x.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$"))
    spread = F.flatten(F.transform(parts, lambda x: F.sequence(F.regexp_extract(x, r"^([0-9]+)", 1).cast("int"), F.regexp_extract(x, r"([0-9]+)$", 1).cast("int"))))
    return F.when(good, spread)
