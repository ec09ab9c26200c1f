"""Labels over several lines: which lines of a page make one label.

Lines are (doc, page, line, text, x0, y0, x1, y1, size, color, rank), line being their order on the page. What decides is the
label read so far (its words, and an x range that grows with each line), so lines are folded; a fold runs within a page,
holds one label, and pages are dealt over all tasks. Keys of texts are made by column expressions before the fold.
"""

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.keys import norm_label
from docrecon.functions.labels import ends_with_connector, starts_with_connector
from docrecon.operators.votes import first_seen_mode
from docrecon.shipping import ship

# How far apart lines of a label may be, by the size of type: from line to line, and between them where they
# are close; how far their x ranges may miss each other; lengths and edits of misspelt beginnings.
LEADING, CLOSE, APART = 1.6, 0.6, 2.0
LEAST, EDITS = 8, 2


def within_edits(a: str, b: str, limit: int) -> bool:
    """Whether two texts are within a number of edits: how far each shift of one against the other gets with 0, 1, ...
    edits (equal characters are free)."""
    if abs(len(a) - len(b)) > limit:
        return False

    def slide(i: int, shift: int) -> int:
        while i < len(a) and i + shift < len(b) and a[i] == b[i + shift]:
            i += 1
        return i

    reached = {0: slide(0, 0)}
    goal = len(b) - len(a)
    for _ in range(limit):
        if reached.get(goal, -1) >= len(a):
            return True
        new = {}
        for shift in range(min(reached) - 1, max(reached) + 2):
            ways = (reached.get(shift, -2) + 1, reached.get(shift - 1, -2), reached.get(shift + 1, -2) + 1)
            at = min(max(ways), len(a), len(b) - shift)
            if at >= 0 and at + shift >= 0:
                new[shift] = slide(at, shift)
        reached = new
    return reached.get(goal, -1) >= len(a)


class Vocabulary:
    """A document's known label keys, in order, and its compound labels as lists of part keys."""

    def __init__(self, keys: list[str], compounds: list[list[str]]):
        self.keys, self.compounds = sorted(keys), compounds

    def begins(self, key: str) -> bool:
        at = bisect_left(self.keys, key)
        return at < len(self.keys) and self.keys[at].startswith(key)

    def begins_misspelt(self, key: str) -> bool:
        n = len(key)
        return n >= LEAST and any(len(k) >= m and within_edits(key, k[:m], EDITS) for k in self.keys for m in (n - 1, n, n + 1))

    def misspelt(self, key: str) -> bool:
        """Exactly one known key is within one edit, or two of a long one."""
        limit = 1 if len(key) < 12 else EDITS
        return len(key) >= LEAST and sum(len(k) >= LEAST and within_edits(key, k, limit) for k in self.keys) == 1

    def starts(self, key: str) -> bool:
        return key != "" and (self.begins(key) or self.begins_misspelt(key) or self.misspelt(key))

    def compound(self, pieces: list[str]) -> bool:
        """Whether of two pieces or more some are parts of one compound label, in its order; the last may be unfinished."""
        pieces = pieces[:-1] if pieces and not pieces[-1] else pieces
        if len(pieces) < 2 or not all(pieces):
            return False
        for parts in self.compounds:
            at, hits = 0, 0
            for n, piece in enumerate(pieces):
                fits = [i for i in range(at, len(parts)) if parts[i] == piece or (n == len(pieces) - 1 and parts[i].startswith(piece))]
                if fits:
                    at, hits = fits[0] + 1, hits + 1
            if hits:
                return True
        return False


class _Label:
    """The label at hand: its key, pieces between slashes, x range, and last line."""

    def __init__(self, line: dict):
        self.key, self.pieces, self.first = line["norm"], list(line["pieces"]), line["line"]
        self.x0, self.x1, self.last, self.y1 = line["x0"], line["x1"], line, line["y1"]

    def overlaps(self, line: dict) -> bool:
        return min(self.x1, line["x1"]) - max(self.x0, line["x0"]) > -APART

    def add(self, line: dict) -> None:
        self.key += line["norm"]
        self.pieces = [*self.pieces[:-1], (self.pieces[-1] if self.pieces else "") + (line["pieces"][0] if line["pieces"] else ""), *line["pieces"][1:]]
        self.x0, self.x1, self.last, self.y1 = min(self.x0, line["x0"]), max(self.x1, line["x1"]), line, max(self.y1, line["y1"])


def by_vocabulary(label: _Label, line: dict, known: Vocabulary) -> str | None:
    """Why a line goes on with a label, or None: prefix (what they read together begins a known label), variant (begins a
    misspelt one), compound, connector (close lines of one weight, and a connecting word between them), unknown (close lines
    of one weight, and neither begins a known label)."""
    prev, size = label.last, label.last["size"]
    gap, lead = (line["y0"] + line["y1"] - prev["y0"] - prev["y1"]) / 2, line["y0"] - prev["y1"]
    if line["color"] != prev["color"] or not gap > 0 or not (gap <= LEADING * size or lead <= CLOSE * size) or not label.overlaps(line):
        return None
    together = _Label(label.last)
    together.key, together.pieces = label.key, list(label.pieces)
    together.add(line)
    if known.begins(together.key):
        return "prefix"
    if known.begins_misspelt(together.key):
        return "variant"
    if known.compound(together.pieces):
        return "compound"
    if lead <= CLOSE * size and line["rank"] == prev["rank"]:
        if prev["ends"] or line["starts"]:
            return "connector"
        if not known.starts(label.key) and not known.starts(line["norm"]):
            return "unknown"
    return None


def by_leading(label: _Label, line: dict, known: Vocabulary) -> str | None:
    """Lines of one colour below one another, one weight or the second in parentheses."""
    prev = label.last
    gap = line["y0"] - prev["y0"]
    fits = line["color"] == prev["color"] and 0 < gap <= LEADING * prev["size"] and label.overlaps(line) and (line["rank"] == prev["rank"] or line["opens"])
    return "leading" if fits else None


def by_learned_leading(label: _Label, line: dict, known: Vocabulary) -> str | None:
    """As by_leading, with the limit that the document's own line spacing gives."""
    prev, lead = label.last, line["y0"] - label.y1
    fits = line["color"] == prev["color"] and (line["rank"] == prev["rank"] or line["opens"]) and label.overlaps(line) and -0.3 * prev["size"] <= lead <= prev["size"]
    return "leading" if fits and line["limit"] is not None and lead <= line["limit"] else None


RULES = {f.__name__: f for f in (by_vocabulary, by_leading, by_learned_leading)}


def learned_limits(lines: DataFrame) -> DataFrame:
    """doc, limit: 1.4 times the most frequent space between lines of one label (in halves, ties to the first seen, 0 at
    least) and 0.5; none for a document without such lines."""
    page = Window.partitionBy("doc", "page").orderBy("line")
    before = F.lag(F.struct("x0", "x1", "y1", "size", "color", "rank")).over(page)
    rows = lines.withColumn("_p", before).withColumn("_lead", F.col("y0") - F.col("_p.y1"))
    same = (F.col("color") == F.col("_p.color")) & ((F.col("rank") == F.col("_p.rank")) | F.col("text").rlike(r"^\s*\("))
    near = (F.least(F.col("x1"), F.col("_p.x1")) - F.greatest(F.col("x0"), F.col("_p.x0")) > -APART) & F.col("_lead").between(-0.3 * F.col("_p.size"), F.col("_p.size"))
    spaces = rows.filter(same & near).withColumn("_half", F.rint(F.col("_lead") * 2) / 2)
    return first_seen_mode(spaces, ["doc"], "_half", ["page", "line"]).select("doc", (F.greatest(F.col("_half"), F.lit(0.0)) * 1.4 + 0.5).alias("limit"))


def merged_lines(lines: DataFrame, rule: str = "by_vocabulary", known: DataFrame | None = None, compounds: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Every line with the label that it belongs to (the number of its first line) and why it does (first for a label's first
    line): doc, page, line, label, why.

    known(doc, key) and compounds(doc, parts) are a document's labels, as few as a structure page names; limits(doc, limit)
    is learned_limits. Null texts have no key. Repeated line numbers are in the order of their text. No lines give none.
    """
    rows = lines.select(
        *lines.columns, norm_label(F.coalesce("text", F.lit(""))).alias("norm"), F.transform(F.split(F.coalesce("text", F.lit("")), "/"), norm_label).alias("pieces"),
        F.coalesce(ends_with_connector(F.concat(F.lit(" "), "text")), F.lit(False)).alias("ends"), F.coalesce(starts_with_connector(F.col("text")), F.lit(False)).alias("starts"), F.coalesce(F.col("text").rlike(r"^\s*\("), F.lit(False)).alias("opens"),
    )

    def beside(table: DataFrame | None, value: Column, name: str, kind: str):
        nonlocal rows
        if table is None:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
        else:
            rows = rows.join(table.groupBy(F.col("doc").alias("_doc")).agg(value.alias(name)), F.expr("doc <=> _doc"), "left").drop("_doc")

    beside(known, F.array_sort(F.collect_set("key")), "_keys", "array<string>")
    beside(compounds, F.collect_set("parts"), "_compounds", "array<array<string>>")
    beside(limits, F.max("limit"), "limit", "double")
    ordered = rows.repartition("doc", "page").sortWithinPartitions("doc", "page", "line", "text")

    def run(batches):
        import pyarrow as pa

        decide, place, label, held, vocabulary = RULES[rule], object(), None, None, Vocabulary([], [])
        for batch in batches:
            found = []
            for line in batch.to_pylist():
                if (line["doc"], line["page"]) != place:
                    place, label = (line["doc"], line["page"]), None
                if (line["_keys"], line["_compounds"]) != held:
                    held = line["_keys"], line["_compounds"]
                    vocabulary = Vocabulary(held[0] or [], held[1] or [])
                why = decide(label, line, vocabulary) if label else None
                if why:
                    label.add(line)
                else:
                    label = _Label(line)
                found.append((label.first, why or "first"))
            labels, whys = zip(*found, strict=True) if found else ((), ())
            kind = batch.schema.field("line").type
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "page", "line")), pa.array(labels, kind), pa.array(whys, pa.string())], ["doc", "page", "line", "label", "why"])

    ship(lines.sparkSession)
    schema = lines.select("doc", "page", "line", F.col("line").alias("label"), F.lit("").alias("why")).schema
    return ordered.mapInArrow(run, schema)
