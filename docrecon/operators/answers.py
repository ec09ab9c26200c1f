"""What a second reader of the pages saw (a model's answers, given as a relation), beside what was extracted.

extracted(page, kind, pos, unit, text) and seen(page, kind, pos, text) are what either found on a page, in order; kinds are
unit titles, section headings and codes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.keys import layer_key, norm_label
from docrecon.shipping import ship

# Kinds whose texts may differ by misread letters, the least length of those, statuses and findings.
READ_KINDS, LEAST_READ = ("unit_titles", "section_headings"), 6
AGREED, EXTRACTED_ONLY, SEEN_ONLY = "UYUMLU", "YALNIZCA_PDF_CIKARIMI", "YALNIZCA_GEMINI"
NOT_CONFIRMED, NOT_EXTRACTED = "GEMINI_NOT_CONFIRMED", "GEMINI_NOT_EXTRACTED"
#: Characters that an answer must have to be looked for in a page's text.
LEAST_ANSWER = 3


def answer_key(kind: Column, text: Column) -> Column:
    """Codes are compared without blanks and full stops at their end, other texts as labels."""
    return F.when(kind == "codes", F.rtrim(F.regexp_replace(text, r"\s+", ""), F.lit("."))).otherwise(norm_label(text))


def matched_answers(extracted: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs (page, kind, pos, seen_pos), one to one: in order, each extracted text takes the first text seen that is the same
    and not taken. Texts of READ_KINDS are the same within a tenth of their length in edits, one at least.

    What may be the same meets in a join within page and kind; the order is then followed along these pairs alone, page by page,
    and a page holds as many as stand on it.
    """
    side = lambda df, p: df.select("page", "kind", F.col("pos").alias(f"{p}pos"), answer_key(F.col("kind"), F.col("text")).alias(f"{p}key")).filter(f"{p}key is not null")
    read = F.col("kind").isin(*READ_KINDS) & (F.char_length("l_key") >= LEAST_READ)
    edits = F.greatest(F.lit(1), F.floor(F.char_length("l_key") / 10).cast("int"))
    same = (F.col("l_key") == F.col("r_key")) | (read & (F.levenshtein("l_key", "r_key") <= edits))
    met = side(extracted, "l_").join(side(seen, "r_"), ["page", "kind"]).filter(same).select("page", "kind", "l_pos", "r_pos")
    ordered = met.repartition("page", "kind").sortWithinPartitions("page", "kind", "l_pos", "r_pos")

    def run(batches):
        import pyarrow as pa

        group, done, taken = None, None, set()
        for batch in batches:
            keep = []
            for page, kind, left, right in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if (page, kind) != group:
                    group, done, taken = (page, kind), None, set()
                free = left != done and right not in taken
                if free:
                    done = left
                    taken.add(right)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ship(extracted.sparkSession)
    return ordered.mapInArrow(run, ordered.schema).select("page", "kind", F.col("l_pos").alias("pos"), F.col("r_pos").alias("seen_pos"))


def compared_pages(extracted: DataFrame, seen: DataFrame) -> DataFrame:
    """Every text of either side: page, kind, unit, status, code (of the finding, null where both agree), extracted, seen.
    A text seen alone has its page's unit, the first that something was extracted for there. Null texts agree with none."""
    pairs = matched_answers(extracted, seen)
    units = extracted.groupBy("page").agg(F.min_by("unit", F.struct("kind", "pos")).alias("unit"))
    left = extracted.join(pairs, ["page", "kind", "pos"], "left")
    theirs = seen.select("page", "kind", F.col("pos").alias("seen_pos"), F.col("text").alias("seen"))
    ours = left.join(theirs, ["page", "kind", "seen_pos"], "left")
    found = F.col("seen_pos").isNotNull()
    ours = ours.select("page", "kind", "unit", F.when(found, AGREED).otherwise(EXTRACTED_ONLY).alias("status"), F.when(~found, NOT_CONFIRMED).alias("code"), F.col("text").alias("extracted"), "seen")
    rest = theirs.join(pairs, ["page", "kind", "seen_pos"], "left_anti").join(units, "page", "left")
    return ours.unionByName(rest.select("page", "kind", "unit", F.lit(SEEN_ONLY).alias("status"), F.lit(NOT_EXTRACTED).alias("code"), F.lit(None).cast("string").alias("extracted"), "seen"))


def applied_answers(cells: DataFrame, answers: DataFrame, pages: DataFrame) -> DataFrame:
    """cells(cell, value) with what an answer gives them: cell, value, answer (where it stands in the page's own text), and
    unverified (an answer that does not, or is shorter than LEAST_ANSWER: kept for review, not applied). answers(cell, page,
    answer); pages(page, text). A cell's first answer on a page that has it counts."""
    asked = answers.filter("answer is not null").select("cell", "page", "answer", layer_key(F.col("answer")).alias("_key")).distinct()
    texts = pages.select(F.col("page").alias("_page"), layer_key(F.col("text")).alias("_text"))
    met = asked.join(texts, F.col("page") == F.col("_page"), "left").withColumn("_stands", (F.char_length("_key") >= LEAST_ANSWER) & F.coalesce(F.contains("_text", "_key"), F.lit(False)))
    told = met.groupBy("cell", "page", "answer").agg(F.max("_stands").alias("_stands"))
    good, bad = told.filter("_stands"), told.filter("not _stands")
    chosen = good.groupBy("cell").agg(F.min_by("answer", F.struct("page", "answer")).alias("answer"))
    rest = bad.groupBy("cell").agg(F.min_by("answer", F.struct("page", "answer")).alias("unverified"))
    return cells.join(chosen, "cell", "left").join(rest, "cell", "left").select("cell", "value", "answer", "unverified")


def page_tasks(cells: DataFrame) -> DataFrame:
    """cells(cell, pages) by page: page, cells (in order); a page has as many as stand on it."""
    return cells.select("cell", F.explode("pages").alias("page")).groupBy("page").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
