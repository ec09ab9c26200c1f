"""Units, sections and labels over several lines, against loops over a document's spans."""

import random

from pyspark.sql import functions as F

from docrecon.operators import label_lines as L
from docrecon.operators import scans
from docrecon.operators import units as U


def random_spans(draw, doc, pages):
    out = []
    for page in range(pages):
        idx = 0
        for row in range(draw.randint(1, 9)):
            for x in draw.choice([(60,), (60, 200), (20,), (200,)]):
                kind = draw.choice(["title", "title", "label", "body", "body", "body", "heading", "note"])
                y0 = row * 14.0 + draw.choice([0, 0, 3])
                width, size = draw.choice([60, 100, 160]), draw.choice([12.0, 12.0, 16.0])
                out.append(dict(doc=doc, page=page, idx=idx, row=row, text=f"{kind}{page}.{idx}", x0=float(x), y0=y0, x1=float(x + width), y1=y0 + 10, size=size, kind=kind, label=1000 * page + idx if kind == "label" else None, is_title=kind == "title" and draw.random() < 0.6))
                if kind == "label" and draw.random() < 0.4:
                    idx += 1
                    out.append(dict(out[-1], idx=idx, kind="part", text="part", x1=float(x + 150), label=1000 * page + idx - 1))
                idx += 1
    return out


def plain_roles(spans):
    """The rules as a loop over one document's spans in reading order."""
    rows = {}
    for s in spans:
        rows.setdefault((s["page"], s["row"]), []).append(s)
    tops, edges = {}, {}
    for s in spans:
        if s["kind"] in ("label", "part"):
            members = [m for m in spans if m["label"] == s["label"] and m["page"] == s["page"] and m["kind"] in ("label", "part")]
            right = max(m["x1"] for m in members)
            others = [o["x0"] for m in members for o in rows[m["page"], m["row"]] if o["kind"] not in ("label", "part")]
            tops[s["label"]] = not any(x >= right - 2 for x in others)
            if not tops[s["label"]]:
                edges[s["page"]] = max(edges.get(s["page"], right), right)

    def next_to(a, b):
        same = abs((b["y0"] + b["y1"]) / 2 - (a["y0"] + a["y1"]) / 2) < 3
        lead = b["y0"] - a["y1"]
        return a["page"] == b["page"] and (same or (0 <= lead <= 0.8 * a["size"] and min(a["x1"], b["x1"]) > max(a["x0"], b["x0"]) and abs(a["size"] - b["size"]) < 0.5))

    out, before, unit, opened, in_title, broken, section, context, held, top = {}, None, 0, False, False, False, 0, 0, None, False
    mine = None
    for s in spans:
        if s["kind"] in ("note", "part"):
            out[s["page"], s["idx"]] = (s["kind"], None, None, None)
            continue
        where = (s["page"], s["idx"])
        if s["kind"] == "title":
            starts = before is None or before["kind"] != "title"
            joins = before is not None and before["kind"] == "title" and next_to(before, s)
            if starts:
                opened, in_title = False, False
            if in_title:
                broken = broken or not joins
                out[where] = ("subtitle" if broken else "title", unit, None, mine)
            elif s["is_title"]:
                unit, opened, in_title, broken, section, mine = unit + 1, True, True, False, 0, held
                out[where] = ("title", unit, None, mine)
            else:
                if starts or not joins:
                    context += 1
                held = context
                out[where] = ("context", None, None, context)
        elif s["kind"] == "heading":
            opened, held = False, None
            out[where] = ("heading", None, None, None)
        elif s["kind"] == "label":
            top = tops[s["label"]]
            section += opened
            out[where] = ("label", unit, section, mine) if opened else ("orphan", None, None, None)
        else:
            labelled = any(o["kind"] in ("label", "part") for o in rows[s["page"], s["row"]])
            noted = opened and not labelled and not (section > 0 and top) and s["page"] in edges and s["x0"] < edges[s["page"]] - 20
            out[where] = ("note", None, None, None) if noted else ("content", unit, section, mine) if opened else ("outside", None, None, None)
        before = s
    return out


def test_roles_against_a_loop(spark):
    draw = random.Random(9)
    docs = {d: random_spans(draw, d, draw.randint(1, 6)) for d in range(30)}
    rows = [s for d in docs.values() for s in d]
    draw.shuffle(rows)
    schema = "doc long, page int, idx int, row int, text string, x0 double, y0 double, x1 double, y1 double, size double, kind string, label long, is_title boolean"
    found = U.span_roles(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc, {})[r.page, r.idx] = (r.role, r.unit, r.section, r.context)
    assert got == {d: plain_roles(s) for d, s in docs.items()} and len(found) == len(rows)
    roles = {r.role for r in found}
    assert roles == {"title", "subtitle", "context", "heading", "label", "orphan", "part", "content", "outside", "note"}
    assert U.span_roles(spark.createDataFrame([], schema)).collect() == []


def test_pulled_rows(spark):
    """Lines centred beside the next label move to it; a paragraph's last line, and all lines of a section, stay."""

    def span(idx, row, y, x, role, section, size=10.0):
        return (1, 1, idx, row, "t", float(x), float(y), float(x + 50), float(y + 8), size, role, 1, section)

    label = lambda idx, y, section: span(idx, idx, y, 20, "label", section)
    schema = "doc int, page int, idx int, row int, text string, x0 double, y0 double, x1 double, y1 double, size double, role string, unit int, section int"
    moved = [label(0, 0, 1), span(1, 1, 0, 100, "content", 1), span(2, 2, 40, 100, "content", 1), label(3, 41, 2), span(4, 4, 52, 100, "content", 2)]
    close = [label(0, 0, 1), span(1, 1, 24, 100, "content", 1), span(2, 2, 34, 100, "content", 1), label(3, 41, 2)]
    far = [label(0, 0, 1), span(1, 1, 0, 100, "content", 1), span(2, 2, 40, 30, "content", 1), label(3, 41, 2)]
    for spans, want in ((moved, [(1, 2, 2)]), (close, []), (far, [])):
        found = U.pulled_rows(spark.createDataFrame(spans, schema)).collect()
        assert [(r.section, r.row, r.to) for r in found] == want
    back = U.with_pulled(spark.createDataFrame(moved, schema)).filter("idx = 2").collect()
    assert [r.section for r in back] == [2]


def test_scans_of_one_large_key(spark):
    """A key with all rows is scanned by blocks: no task sees more than a few of them."""
    rows = spark.range(4000).select(F.lit(1).alias("doc"), (F.col("id") / 40).cast("int").alias("page"), F.col("id").alias("idx"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"))
    found = scans.counted(scans.carried(rows, ["doc"], "page", ["idx"], {"last": F.col("v")}), ["doc"], "page", ["idx"], {"n": F.col("v").isNotNull()}).orderBy("idx").collect()
    assert all(r.last == (None if r.idx < 3 else (r.idx - 3) // 700 * 700 + 3) and r.n == (r.idx + 697) // 700 for r in found)


def line(n, text, y, x0=60.0, x1=140.0, color=0, rank=2, size=10.0, doc=1, page=1):
    return (doc, page, n, text, x0, float(y), x1, float(y + 8), size, color, rank)


LINES = "doc int, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, color int, rank int"


def test_merged_lines(spark):
    """Each reason to merge, and each that keeps lines apart."""
    known = spark.createDataFrame([(1, "öğrenmeçıktilarivesüreçbileşenleri"), (1, "alanbecerileri"), (1, "öğrenmeöğretmeuygulamalari")], "doc int, key string")
    compounds = spark.createDataFrame([(1, ["genellemeler", "ilkeler", "anahtarkavramlar"])], "doc int, parts array<string>")
    lines = [
        line(0, "ALAN", 0), line(1, "BECERİLERİ", 15), line(2, "ALAN", 30), line(3, "BECERİLERİ", 50),
        line(4, "Öğrenme-Öğreme", 100), line(5, "Uygulamaları", 112), line(6, "Genellemeler/Anahtar", 200), line(7, "Kavramlar", 215),
        line(8, "ÖZEL BÖLÜM VE", 300), line(9, "EKLERİ", 312), line(10, "ÖĞRENCİ", 400), line(11, "PROFİLİ", 412), line(12, "BELİRSİZ", 500), line(13, "ALAN", 512), line(14, None, 600),
        line(15, "ALAN", 700), line(16, "BECERİLERİ", 712, color=3), line(17, "ALAN", 800), line(18, "BECERİLERİ", 812, x0=300.0, x1=400.0),
    ]
    found = L.merged_lines(spark.createDataFrame(lines, LINES), known=known, compounds=compounds).collect()
    got = {r.line: (r.label, r.why) for r in found}
    assert {n: got[n] for n in (1, 5, 7, 9, 11)} == {1: (0, "prefix"), 5: (4, "variant"), 7: (6, "compound"), 9: (8, "connector"), 11: (10, "unknown")}
    assert all(got[n] == (n, "first") for n in (0, 2, 3, 4, 6, 8, 10, 12, 13, 14, 15, 16, 17, 18))
    assert L.merged_lines(spark.createDataFrame([], LINES), known=known).collect() == []


def test_growing_range_decides(spark):
    """A third line that lies under the first alone joins only because the label's range has grown to both."""
    lines = spark.createDataFrame([line(0, "one", 0, 60.0, 300.0), line(1, "two", 12, 250.0, 320.0), line(2, "three", 24, 60.0, 120.0), line(3, "(four", 36, rank=1), line(4, "five", 48, rank=2)], LINES)
    assert {r.line: r.label for r in L.merged_lines(lines, "by_leading").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    limits = L.learned_limits(lines)
    assert [r.limit for r in limits.collect()] == [4.0 * 1.4 + 0.5]
    assert {r.line: r.label for r in L.merged_lines(lines, "by_learned_leading", limits=limits).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_within_edits():
    draw = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(4000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(0, 7))) for _ in range(2))
        for limit in range(4):
            assert L.within_edits(a, b, limit) == (distance(a, b) <= limit), (a, b, limit)


def test_headings(spark):
    df = spark.createDataFrame([("EK 1", 2, 12.0, True), ("•", 2, 20.0, False), ("büyük", 0, 14.0, True), ("gövde", 1, 13.0, False)], "t string, r int, s double, want boolean")
    assert df.filter(U.heading_like(F.col("t"), F.col("r"), F.col("s"), F.lit(12.0)) != F.col("want")).count() == 0
