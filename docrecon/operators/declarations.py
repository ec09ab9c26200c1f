"""Sections that declare codes: their entries as rows, and what is wrong with them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.functions.codes import code_prefix, code_segments, normalized_code
from docrecon.functions.folds import declarations
from docrecon.functions.keys import dehyphen, dehyphen_places


def _scanned(sections: DataFrame, text: str) -> DataFrame:
    view = sections.withColumn("_view", dehyphen(F.coalesce(F.col(text), F.lit("")))).withColumn("_d", declarations("_view"))
    return view.withColumn("_at", dehyphen_places(F.coalesce(F.col(text), F.lit(""))))


def declared_codes(sections: DataFrame, text: str = "text") -> DataFrame:
    """sections with a row for each declared code: pos, start and end (places in the text as it is written), code, prefix,
    segments, parent (its code), entry (its text without marks at its end) and usual. A null or empty text, or one that does not
    begin with a code, declares nothing."""
    rows = _scanned(sections, text).select(*sections.columns, "_at", F.col("_d.entries").alias("_all"), F.explode("_d.entries").alias("_e"))
    place = lambda c: F.get("_at", c)
    rows = rows.select(
        *sections.columns, "_e.pos", place(F.col("_e.start")).alias("start"), (place(F.col("_e.end") - 1) + 1).alias("end"), "_e.code", code_prefix(F.col("_e.code")).alias("prefix"), code_segments(F.col("_e.code")).alias("segments"),
        F.get("_all", F.col("_e.parent"))["code"].alias("parent"), "_e.entry", "_e.usual",
    )
    return rows.withColumn("parent", F.when(F.col("parent").isNotNull(), normalized_code(code_prefix(F.col("parent")), code_segments(F.col("parent")))))


def declaration_findings(sections: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, code and detail: DECLARATION_NAME_MISSING (an entry is a code alone), CODE_FORMAT_ANOMALY (a code with a name is
    not written as usual) and DECLARATION_UNPARSED_CODE (what looks like a code begins no entry, and so is part of another
    one's text)."""
    found = _scanned(sections, text)
    entries = found.select(*keys, F.explode("_d.entries").alias("_e"))
    alone = F.btrim("_e.entry") == F.btrim("_e.code")
    kind = F.when(alone, "DECLARATION_NAME_MISSING").when(~F.col("_e.usual"), "CODE_FORMAT_ANOMALY")
    odd = entries.withColumn("code", kind).filter("code is not null").select(*keys, "code", F.col("_e.code").alias("detail"))
    rest = found.select(*keys, F.explode("_d.residue").alias("_r")).select(*keys, F.lit("DECLARATION_UNPARSED_CODE").alias("code"), F.col("_r.text").alias("detail"))
    return odd.unionByName(rest)
