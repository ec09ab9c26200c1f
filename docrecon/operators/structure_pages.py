"""The pages on which a document describes its own structure: a unit's page in small, before the units themselves.

Spans are (doc, page, idx, y0, text, size, color, is_title, marked, bold): is_title for what reads like a unit's title, marked
for what is not in the colour of body text. Per document:

* Its titles are those in the colour that most titles have (ties: seen first) or near it, in order of page, y0 and idx.
* Its structure heading is the last marked span that names the structure and is not after the first title's page; an earlier one
  is a line of the table of contents.
* The first title is the sample of a structure page if one of four holds: it stands on the heading's page; it is at most ten
  pages after it and the first title of a later page reads the same; it is smaller than nine tenths of the median title; its
  page's headings are smaller than 85 % of those on the first six other pages with titles (five or more on both).
* The structure goes on from the sample's page until a page without text, with a title, or with a text (codes apart) about as
  large as the heading (without heading, as the median title).

What is gathered per document is one row of sizes a page, so a document may have any share of all spans. Spans without document, page or text
are no content. A document without titles or sample has code STRUCTURE_PAGE_NOT_FOUND and null places; no spans give no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.keys import norm_label, tr_upper
from docrecon.functions.labels import lo_shape
from docrecon.operators.layout import color_distance
from docrecon.operators.scans import kept
from docrecon.operators.votes import first_seen_mode, upper_median

# Words that name the structure, how near and how small a sample is, and which pages it is compared with.
HINTS = ("YAPISI", "STRUCTURE")
REACH, SMALL, SCALED, LARGE, OTHERS, ENOUGH = 10, 0.9, 0.85, 0.95, 6, 5


def names_structure(text: Column) -> Column:
    upper = tr_upper(text)
    return F.contains(upper, F.lit(HINTS[0])) | F.contains(upper, F.lit(HINTS[1]))


def document_titles(content: DataFrame, tolerance: int = 10) -> DataFrame:
    """Titles in the document's title colour or near it: doc, page, y0, idx, size, key."""
    titles = content.filter("is_title")
    colour = first_seen_mode(titles, ["doc"], "color", ["page", "y0", "idx"]).select("doc", F.col("color").alias("_color"))
    near = titles.join(colour, "doc").filter(color_distance(F.col("color"), F.col("_color")) <= tolerance)
    return near.select("doc", "page", "y0", "idx", "size", "text", norm_label(F.col("text")).alias("key"))


def scaled_down(content: DataFrame, titles: DataFrame, first: DataFrame) -> DataFrame:
    """Documents whose first title's page has smaller headings (marked, bold, with a letter, no titles) than their next pages
    with titles: doc."""
    at = titles.select("doc", "page").distinct().join(first.select("doc", "at"), "doc")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    others = at.filter(F.col("page") != F.col("at")).withColumn("_n", nth).filter(F.col("_n") <= OTHERS).select("doc", "page", F.lit(False).alias("here"))
    pages = others.unionByName(first.select("doc", F.col("at").alias("page"), F.lit(True).alias("here")))
    own = titles.select("doc", "page", "idx")
    headings = content.filter(F.col("marked") & F.col("bold") & F.col("text").rlike(r"\p{L}")).join(pages, ["doc", "page"]).join(own, ["doc", "page", "idx"], "left_anti")
    middle = upper_median(headings, ["doc", "here"], "size").filter(F.col("n") >= ENOUGH)
    here, there = (middle.filter("here" if own_page else "not here").select("doc", F.col("median").alias(name)) for own_page, name in ((True, "_small"), (False, "_usual")))
    return here.join(there, "doc").filter(F.col("_small") < F.lit(SCALED) * F.col("_usual")).select("doc")


def structure_pages(spans: DataFrame) -> DataFrame:
    """doc, heading_page, heading, title_page, title, why (heading_page, repeated, small, scaled: the first that holds),
    first_page, last_page, code."""
    content = spans.filter("doc is not null and page is not null and trim(text) <> ''")
    titles = kept(document_titles(content), "titles")
    at = F.struct("page", "y0", "idx")
    first = titles.groupBy("doc").agg(F.min("page").alias("at"), F.min_by("text", at).alias("title"), F.min_by("key", at).alias("_key"), F.min_by("size", at).alias("_size"))
    first = kept(first.join(upper_median(titles, ["doc"], "size").select("doc", F.col("median").alias("_median")), "doc", "left"), "first")
    hints = content.filter(F.col("marked") & names_structure(F.col("text"))).join(first.select("doc", "at"), "doc").filter("page <= at")
    last = F.struct("page", "idx")
    heading = hints.groupBy("doc").agg(F.max("page").alias("heading_page"), F.max_by("text", last).alias("heading"), F.max_by("size", last).alias("_large"))
    later = titles.join(first.select("doc", "at"), "doc").filter(F.col("page") > F.col("at")).groupBy("doc").agg(F.min_by("key", at).alias("_next"))
    scaled = scaled_down(content, titles, first).withColumn("_scaled", F.lit(True))
    reached = F.col("at") - F.col("heading_page") <= REACH
    why = (
        F.when(F.col("at") == F.col("heading_page"), "heading_page").when(reached & (F.col("_next") == F.col("_key")), "repeated")
        .when(F.col("_size") < F.col("_median") * SMALL, "small").when(F.col("_scaled"), "scaled")
    )
    found = kept(first.join(heading, "doc", "left").join(later, "doc", "left").join(scaled, "doc", "left").withColumn("why", why), "sample")
    sample = found.filter("why is not null").select("doc", "at", (F.coalesce("_large", "_median") * LARGE).alias("_stop"))

    # of each page from the sample's on: its largest text, and whether a title or no text follows
    sizes = content.groupBy("doc", "page").agg(F.max(F.when(lo_shape(F.col("text")).isNull(), F.col("size"))).alias("_top"))
    pages = kept(sizes.join(sample, "doc").filter(F.col("page") >= F.col("at")), "pages")
    titled = titles.select("doc", "page").distinct().withColumn("_titled", F.lit(True))
    stops = pages.filter(F.col("page") > F.col("at")).join(titled, ["doc", "page"], "left").filter(F.col("_titled") | (F.col("_top") >= F.col("_stop"))).select("doc", (F.col("page") - 1).alias("end"))
    ends = pages.select("doc", F.col("page").alias("end")).join(pages.select("doc", (F.col("page") - 1).alias("end")), ["doc", "end"], "left_anti")
    until = stops.unionByName(ends).groupBy("doc").agg(F.min("end").alias("last_page"))

    all_documents = spans.filter("doc is not null").select("doc").distinct()
    ok = F.col("why").isNotNull()
    rows = all_documents.join(found, "doc", "left").join(until, "doc", "left")
    return rows.select(
        "doc", "heading_page", "heading", F.when(ok, F.col("at")).alias("title_page"), F.when(ok, F.col("title")).alias("title"), "why", F.when(ok, F.col("at")).alias("first_page"), "last_page",
        F.when(~ok, "STRUCTURE_PAGE_NOT_FOUND").alias("code"),
    )
