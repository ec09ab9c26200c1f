"""Titles, labels and learned code shapes as column expressions.

Codes are read by cutting a line into parts at white space and full stops, giving each part a kind (n for a number, a for
a short word of capitals, which digits may follow), and looking at the kinds as a text: no pattern of whole codes is built.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.keys import DOTLESS, DOTTED, norm_label, tr_lower
from docrecon.operators.votes import first_seen_mode

# Words that connect the lines of a label, what columns and sections are named with, and the capitals that
# a segment of letters is made of.
CONNECTING = "(?:ve|ile|veya|ya da)"
LO_HINTS = (("öğrenme", "çıktı"), ("learning", "outcome"))
HOURS_HINTS = (("saat",), ("hour",))
ORDER_HINTS = (("sıra",), ("order",), ("sequence",))
FIELD_SKILL_HINTS = (("alan", "beceri"), ("field", "skill"))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜ"
#: Longest run of capitals in a segment, and the most segments that are looked at.
SHORT, MOST = 4, 12


def _lower(c: Column) -> Column:
    return F.lower(F.translate(c, DOTTED, DOTLESS))


def ends_with_connector(c: Column) -> Column:
    return _lower(c).rlike(rf"\s{CONNECTING}\s*$")


def starts_with_connector(c: Column) -> Column:
    return _lower(c).rlike(rf"^\s*{CONNECTING}\s")


def names_any(c: Column, hints: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text names one of the things that hints describe: holds every word of one of the groups, in any case and
    order, dotless i as i. A null names nothing."""
    folded = F.translate(tr_lower(F.coalesce(c, F.lit(""))), "ı", "i")
    groups = F.array(*(F.array(*(F.lit(w.replace("ı", "i")) for w in group)) for group in hints))
    return F.exists(groups, lambda group: F.forall(group, lambda word: F.contains(folded, word)))


def unit_title(c: Column, keyword: Column, keyword_first: Column) -> Column:
    """Struct of order, name and standard (written in the program's own way) of a title such as `3. TEMA: AD` or
    `TEMA 3: AD`; null for other texts and other keywords.

    What stands before the first colon is cut twice: at its only full stop (number, keyword) and at its last blank
    (keyword, number).
    """
    text = F.translate(c, "\n", " ")
    head, name = F.substring_index(text, ":", 1), F.trim(F.substring(text, F.instr(text, ":") + 1, F.char_length(text)))
    dotted, words = F.transform(F.split(head, r"\."), lambda x: F.trim(x)), F.split(F.trim(head), r"\s+")
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))
    same = lambda x: norm_label(x) == norm_label(keyword)
    before = F.when((F.size(dotted) == 2) & same(F.get(dotted, 1)), number(F.get(dotted, 0)))
    after = F.when((F.size(words) > 1) & same(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")), number(F.element_at(words, -1)))
    made = lambda order, standard: F.when(order.isNotNull(), F.struct(order.alias("order"), name.alias("name"), standard.alias("standard")))
    return F.when(F.contains(text, F.lit(":")) & (name != ""), F.coalesce(made(before, ~keyword_first), made(after, keyword_first)))


def code_run(c: Column) -> Column:
    """A text's head as it may name a code: struct of letters (of its first part), parts (what follows, up to MOST) and
    gaps (what stands before each part, empty where digits follow the letters at once; one more for what follows the last)."""
    bare = F.regexp_replace(c, r"^[\s]+", "")
    first = F.regexp_extract(bare, r"^[^\s.]*", 0)
    letters = F.regexp_extract(first, r"^\p{L}*", 0)
    glued = F.substring(first, F.char_length(letters) + 1, F.char_length(first))
    parts, gaps = F.split(bare, r"[\s.]+", MOST + 2), F.regexp_extract_all(bare, F.lit(r"[\s.]+"), F.lit(0))
    rest = F.slice(parts, 2, MOST)
    none = F.array().cast("array<string>")
    return F.struct(letters.alias("letters"), F.concat(F.when(glued != "", F.array(glued)).otherwise(none), rest).alias("parts"), F.concat(F.when(glued != "", F.array(F.lit(""))).otherwise(none), gaps).alias("gaps"))


def _capitals(part: Column) -> Column:
    """Whether a part is one to SHORT capitals, then digits or nothing."""
    word = F.rtrim(part, F.lit("0123456789"))
    return F.char_length(word).between(1, SHORT) & (F.translate(word, CAPITALS, "") == "")


def kinds(parts: Column) -> Column:
    """One character a part: n for a number, m for one that something else follows at once, a for capitals, - else."""
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), "n").when(p.rlike("^[0-9]"), "m").when(_capitals(p), "a").otherwise("-")), "")


def lo_shape(c: Column) -> Column:
    """Struct of prefix and types (n and a, joined) of a text that begins with an outcome's code, else null: letters, then
    two numbers or more, or numbers and a word of capitals; a word of capitals may also stand first, before a full stop.
    What follows a number at once ends the code."""
    run = code_run(c)
    own = kinds(run["parts"])
    found = F.regexp_extract(own, "^a?(?:n+a|n+m|nn+)", 0)
    opened = ~F.startswith(own, F.lit("a")) | F.contains(F.coalesce(F.get(run["gaps"], 1), F.lit("")), F.lit("."))
    return F.when((run["letters"] != "") & (found != "") & opened, F.struct(run["letters"].alias("prefix"), F.translate(found, "m", "n").alias("types")))


def _closed(part: Column) -> Column:
    """A part without what a mark after a code cuts off."""
    return F.regexp_extract(part, r"^[^;,)]*", 0)


def _spaced(gap: Column) -> Column:
    """Whether a gap may stand within a code: blanks of one line and one full stop at most."""
    return F.translate(gap, " \t", "").isin("", ".")


def _written(run: Column, n: Column) -> Column:
    """The code of the first n parts as it is written, with the full stop that ends it; its last part up to a mark."""
    body = F.array_join(F.transform(F.arrays_zip(F.slice(run["gaps"], 1, n).alias("g"), F.slice(run["parts"], 1, n).alias("p")), lambda x: F.concat(x["g"], x["p"])), "")
    last = F.get(run["parts"], n - 1)
    cut = F.char_length(last) - F.char_length(_closed(last))
    dot = F.when((cut == 0) & F.startswith(F.coalesce(F.get(run["gaps"], n), F.lit("")), F.lit(".")), ".").otherwise("")
    return F.concat(run["letters"], F.substring(body, F.lit(1), F.char_length(body) - cut), dot)


def _one_code(run: Column, n: Column, prefix: Column) -> Column:
    within = F.slice(run["gaps"], 1, n)
    return (run["letters"] == prefix) & (F.size(run["parts"]) >= n) & F.forall(within, _spaced)


def leading_code(c: Column, prefix: Column, types: Column) -> Column:
    """The code, as it is written, that a line begins with under a learned prefix and types (as lo_shape gives them), or
    null. Blanks and full stops between segments may vary."""
    run, n = code_run(c), F.char_length(types)
    shut = F.transform(F.slice(run["parts"], 1, n), lambda p, i: F.when(i == n - 1, _closed(p)).otherwise(p))
    return F.when(_one_code(run, n, prefix) & (kinds(shut) == types), _written(run, n))


def loose_leading_code(c: Column, prefix: Column, most: Column, least: int = 1) -> Column:
    """As leading_code, for the longest code of `least` to `most` segments of either kind."""
    run = code_run(c)

    def fits(n):
        shut = F.transform(F.slice(run["parts"], 1, n), lambda p, i: F.when(i == n - 1, _closed(p)).otherwise(p))
        return _one_code(run, n, prefix) & ~kinds(shut).rlike("[^na]")

    longest = F.array_max(F.filter(F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>")), fits))
    return F.when(longest.isNotNull(), _written(run, longest))


def outcome_code(c: Column, prefix: Column, types: Column, least: int = 2) -> Column:
    """The code of an outcome's heading: by the learned types, else one of up to as many segments of any kind if the line
    is that code and nothing else."""
    loose = loose_leading_code(c, prefix, F.char_length(types), least)
    return F.coalesce(leading_code(c, prefix, types), F.when(F.btrim(c) == loose, loose))


def learn_lo_shape(lines: DataFrame, doc: str, order: list[str], text: str, least: int = 3) -> DataFrame:
    """Per document the prefix and types that most lines of `least` segments or more begin with (ties to the first seen)."""
    shaped = lines.withColumn("_s", lo_shape(F.col(text))).filter(F.char_length("_s.types") >= least)
    return first_seen_mode(shaped, [doc], "_s", order).select(doc, "_s.prefix", "_s.types", "n")


def compound_subset(text: Column, parts: Column) -> Column:
    """Whether a text is two or more pieces between slashes that all are parts of a compound label, in its order. parts is
    the array of the label's keys."""
    pieces = F.transform(F.split(F.regexp_replace(text, r"/\s*$", ""), "/"), norm_label)
    places = F.transform(pieces, lambda p: F.array_position(parts, p))
    return (F.size(pieces) >= 2) & F.forall(places, lambda x: x > 0) & (places == F.array_sort(F.array_distinct(places)))
