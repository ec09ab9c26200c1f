"""Word views of a text column, shared by the operators of this subpackage.

All of them are column expressions, so they stay in the JVM and keep a null text null unless said otherwise.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
#: Everything that separates words of letters and digits: ASCII except 0-9, A-Z and a-z.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def plain_words(text: Column) -> Column:
    """Words of 0-9, a-z and characters beyond ASCII, after A-Z went to lower case; null has none.

    One translate() does both steps, and splitting at one fixed character needs no regular expression.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def blank_words(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def row_key(id_column: str, text_column: str) -> list[Column]:
    """What tells documents apart: the id and a hash of the text, so that a repeated id with another text is another document."""
    return [F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_hash")]


def with_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, with the columns of right where both columns of row_key agree (nulls equal), else nulls."""
    other = right.withColumnsRenamed({"_id": "_other_id", "_hash": "_other_hash"})
    return left.join(other, F.expr("_id <=> _other_id and _hash = _other_hash"), "left").drop("_other_id", "_other_hash")
