"""Units, sections and what lies outside them, from the spans of documents in reading order.

Spans are (doc, page, idx, row, text, x0, y0, x1, y1, size, kind) where idx is the place in a page's reading order and row the
line that a span stands on. Kinds: title (in the colour of unit titles), label (a label's first span), part (its further ones),
heading (looks like a heading but is in none of the colours), note (a sentence in a label's colour), body. label names the
label that a label or part belongs to.

The rules, by what a document's reader sees:

* A run of title spans ends what was open. Its first span that reads like a unit's title opens a unit; those before it are
  a context, which holds for this unit and all later ones until the next context or heading; those after it continue the
  title where each stands next to its predecessor, and are a subtitle from the first on that does not.
* A label opens a section of the open unit; without one it is an orphan.
* A heading closes the unit; what follows is outside.
* Body text belongs to the open section, or, before the first label, to a section without label; outside a unit to none.
  Body text of a line without label that starts more than 20 to the left of where the page's side labels end is a note of
  the page, unless the section's label stands above its text.

All of this is state that runs on in reading order, written as scans by page (scans.py): a document of any size is spread over its
pages.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.operators.scans import carried, counted, kept

KEYS, ORDER = ["doc"], ["idx"]
#: How far text may start left of the side labels' edge, and what counts as one line and as next to it.
MARGIN, LINE, NEXT = 20.0, 3.0, 0.8


def heading_like(text: Column, font_rank: Column, size: Column, body_size: Column) -> Column:
    """Whether a span in no known colour looks like a heading: it has a letter or digit, and is bold or larger than body
    text by 15 %."""
    return text.rlike(r"[\p{L}\p{N}]") & ((font_rank >= 2) | (size >= body_size * 1.15))


def _middle(y0, y1):
    return (y0 + y1) / 2


def _next_to(before: Column) -> Column:
    """Whether a span stands next to one before it: on the same line, or on the next one and partly under it."""
    same = F.abs(_middle(F.col("y0"), F.col("y1")) - _middle(before["y0"], before["y1"])) < LINE
    lead = F.col("y0") - before["y1"]
    under = lead.between(0, NEXT * before["size"]) & (F.least(F.col("x1"), before["x1"]) > F.greatest(F.col("x0"), before["x0"]))
    return (F.col("page") == before["page"]) & (same | (under & (F.abs(F.col("size") - before["size"]) < 0.5)))


def side_edges(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels(doc, page, label, top), edges(doc, page, edge)): whether a label stands above its text, as no other span
    begins right of it on one of its lines, and how far right the page's other labels reach."""
    member = F.col("kind").isin("label", "part")
    lines = spans.groupBy("doc", "page", "row").agg(F.max(F.when(~member, F.col("x0"))).alias("_other"))
    own = spans.filter(member).join(lines, ["doc", "page", "row"])
    labels = own.groupBy("doc", "page", "label").agg(F.max("x1").alias("_right"), F.max("_other").alias("_other")).withColumn("top", ~F.coalesce(F.col("_other") >= F.col("_right") - 2, F.lit(False)))
    return labels.select("doc", "page", "label", "top"), labels.filter("not top").groupBy("doc", "page").agg(F.max("_right").alias("edge"))


def span_roles(spans: DataFrame, reads_as_title: str = "is_title") -> DataFrame:
    """Every span with role (title, subtitle, context, heading, label, orphan, part, content, outside, note), unit (its number
    in the document from 1, null outside), section (from 1 by labels, 0 for what stands before the first; null for titles
    and outside) and context (number of the context that its unit has, null without). A null document is one of its own;
    no spans give none."""
    labels, edges = side_edges(spans)
    known = spans.withColumn("_labelled", F.max(F.col("kind").isin("label", "part")).over(Window.partitionBy("doc", "page", "row")))
    acting = known.filter(~F.col("kind").isin("note", "part")).join(labels, ["doc", "page", "label"], "left").join(edges, ["doc", "page"], "left")
    place = F.struct("page", "x0", "x1", "y0", "y1", "size")
    is_title = F.col("kind") == "title"
    acting = kept(acting, "acting")
    acting = carried(acting, KEYS, "page", ORDER, {"_before": F.col("kind"), "_stood": place}, inclusive=False)
    acting = kept(acting.withColumn("_starts", is_title & ~(F.coalesce("_before", F.lit("")) == "title")), "runs")
    # of the run at hand, whether its unit's title was read
    acting = carried(acting, KEYS, "page", ORDER, {"_opened": F.when(is_title & F.col(reads_as_title), 1).when(F.col("_starts"), 0)}, inclusive=False)
    after = is_title & ~F.col("_starts") & F.coalesce(F.col("_opened") == 1, F.lit(False))
    acting = acting.withColumns({"_after": after, "_opens": is_title & F.col(reads_as_title) & ~after})
    is_context = is_title & ~F.col("_after") & ~F.col("_opens")
    joins = F.coalesce((F.col("_before") == "title") & _next_to(F.col("_stood")), F.lit(False))
    # a context goes on with what stands next to it in its run
    acting = acting.withColumns({"_context": is_context, "_breaks": F.col("_after") & ~joins, "_new": is_context & (F.col("_starts") | ~joins)})
    acting = kept(acting, "titles")
    acting = counted(acting, KEYS, "page", ORDER, {"_unit": F.col("_opens"), "_labels": F.col("kind") == "label", "_contexts": F.col("_new"), "_broken": F.col("_breaks")})
    acting = carried(
        acting, KEYS, "page", ORDER,
        {
            "_state": F.when(F.col("_opens"), 1).when(F.col("_starts") | (F.col("kind") == "heading"), 0),
            "_at_open": F.when(F.col("_opens"), F.struct(F.col("_labels").alias("labels"), F.col("_broken").alias("broken"))),
            "_held": F.when(F.col("_context"), F.col("_contexts")).when(F.col("kind") == "heading", 0), "_under_top": F.when(F.col("kind") == "label", F.col("top")),
        },
    )
    acting = kept(acting, "states")
    acting = carried(acting, KEYS, "page", ORDER, {"_has": F.when(F.col("_opens"), F.col("_held"))})
    inside = F.coalesce(F.col("_state") == 1, F.lit(False))
    section = F.col("_labels") - F.col("_at_open.labels")
    noted = inside & ~F.col("_labelled") & ~((section > 0) & F.coalesce("_under_top", F.lit(False))) & F.coalesce(F.col("x0") < F.col("edge") - MARGIN, F.lit(False))
    role = (
        F.when(F.col("_opens"), "title").when(F.col("_after"), F.when(F.col("_broken") > F.col("_at_open.broken"), "subtitle").otherwise("title")).when(F.col("_context"), "context")
        .when(F.col("kind") == "heading", "heading").when(F.col("kind") == "label", F.when(inside, "label").otherwise("orphan"))
        .when(noted, "note").when(inside, "content").otherwise("outside")
    )
    of_unit = inside & ~F.col("role").isin("heading", "orphan", "note", "context")
    of_section = F.col("role").isin("label", "content")
    found = acting.withColumn("role", role).withColumns({
        "unit": F.when(of_unit, F.col("_unit")).cast("int"), "section": F.when(of_section, section).cast("int"),
        "context": F.when(F.col("role") == "context", F.col("_contexts")).when(of_unit, F.nullif(F.col("_has"), F.lit(0))).cast("int"),
    })
    rest = known.filter(F.col("kind").isin("note", "part")).withColumns({"role": F.col("kind"), "unit": F.lit(None).cast("int"), "section": F.lit(None).cast("int"), "context": F.lit(None).cast("int")})
    names = [*spans.columns, "role", "unit", "section", "context"]
    return found.select(*names).unionByName(rest.select(*names))


def pulled_rows(roles: DataFrame) -> DataFrame:
    """Lines at a section's end that belong to the next label: role content, doc, unit, section (the one they are in) and page, row.

    Text may be centred beside its label and so begin above it. Of the lines of a section on the page of the next label, the
    last ones that stand no higher than the label's top (less half its size) and right of it move, if the first of them is nearer
    to the label than to what stands before it, and if it begins above the label, a paragraph's gap parts it from
    there. A section whose lines would all move keeps them, unless its own label is on that page.
    """
    key = ["doc", "unit", "section"]
    labels = roles.filter("role = 'label'").select("doc", "unit", "section", F.col("page").alias("_page"), *(F.col(c).alias(f"_{c}") for c in ("x1", "y0", "y1", "size")))
    following = labels.withColumn("section", F.col("section") - 1)
    own = labels.select("doc", "unit", "section", F.col("_page").alias("_own_page"), _middle(F.col("_y0"), F.col("_y1")).alias("_own_y"))
    lines = roles.filter("role = 'content'").groupBy(*key, "page", "row").agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.min_by(_middle(F.col("y0"), F.col("y1")), "idx").alias("y"))
    met = lines.join(following, key).filter("page = _page").join(own, key, "left")
    fits = (F.col("y") >= F.col("_y0") - 0.5 * F.col("_size")) & (F.col("left") >= F.col("_x1") - 2)
    block = Window.partitionBy(*key)
    met = met.withColumns({"_fits": fits, "_bottom": F.lag("bottom").over(block.orderBy("row")), "_above": F.lag("y").over(block.orderBy("row"))})
    met = met.withColumn("_last", F.coalesce(F.max(F.when(~F.col("_fits"), F.col("row"))).over(block), F.lit(-1)))
    tail = met.filter("row > _last").withColumn("_first", F.min("row").over(block))
    before = F.when(F.col("_above").isNotNull(), F.col("_above")).when(F.col("_own_page") == F.col("page"), F.col("_own_y"))
    parted = F.col("_above").isNull() | (F.col("y") >= F.col("_y0")) | (F.col("top") - F.col("_bottom") > 0.5 * F.col("_size"))
    nearer = F.abs(F.col("y") - _middle(F.col("_y0"), F.col("_y1"))) < F.abs(F.col("y") - before)
    good = tail.filter("row = _first").filter(before.isNotNull() & parted & nearer).select(*key, F.lit(True).alias("_good"))
    return tail.join(good, key).select(*key, "page", "row", (F.col("section") + 1).alias("to"))


def with_pulled(roles: DataFrame) -> DataFrame:
    """span_roles with the lines of pulled_rows in their new section."""
    moved = pulled_rows(roles)
    found = roles.join(moved, ["doc", "unit", "section", "page", "row"], "left")
    return found.withColumn("section", F.when(F.col("role") == "content", F.coalesce("to", "section")).otherwise(F.col("section"))).select(*roles.columns)


def joined_texts(roles: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of a group's spans in reading order, joined by blanks, with its first page and number of spans; a group is as
    large as a title or a heading of a page."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "idx", "text"))), lambda x: x["text"])
    return roles.groupBy(*keys).agg(F.array_join(ordered, " ").alias("text"), F.min("page").alias("page"), F.count("*").alias("spans"))


def units(roles: DataFrame) -> DataFrame:
    """doc, unit, title, context (its text), page, sections, content (spans), of span_roles."""
    titles = joined_texts(roles.filter("role = 'title'"), ["doc", "unit"]).select("doc", "unit", F.col("text").alias("title"), "page")
    contexts = joined_texts(roles.filter("role = 'context'"), ["doc", "context"]).select("doc", "context", F.col("text").alias("_text"))
    sizes = roles.filter("unit is not null").groupBy("doc", "unit").agg(F.max("context").alias("context"), F.count_distinct("section").alias("sections"), F.count_if(F.col("role") == "content").alias("content"))
    return titles.join(sizes, ["doc", "unit"]).join(contexts, ["doc", "context"], "left").select("doc", "unit", "title", F.col("_text").alias("context"), "page", "sections", "content")


def orphan_labels(roles: DataFrame) -> DataFrame:
    """ORPHAN_LABEL, and per page the notes that belong to nothing: doc, page, code, text, spans."""
    orphans = joined_texts(roles.filter("role = 'orphan'"), ["doc", "label"]).select("doc", "page", F.lit("ORPHAN_LABEL").alias("code"), "text", "spans")
    notes = roles.filter("role = 'note'").groupBy("doc", "page").agg(F.count("*").alias("spans")).select("doc", "page", F.lit("PAGE_NOTES").alias("code"), F.lit(None).cast("string").alias("text"), "spans")
    return orphans.unionByName(notes)
