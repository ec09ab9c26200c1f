"""Operators on hand-made rows: edge cases that the given tables do not have."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docrecon.operators import checks, diff, layout, sequences, votes
from docrecon.sources import sheets
from docrecon.streaming import ingest


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_votes(spark):
    df = spark.createDataFrame([("a", x, i) for i, x in enumerate([2, 1, 1, 2])] + [("b", 5, 0)], "k string, v int, pos int")
    assert rows(votes.first_seen_mode(df, ["k"], "v", ["pos"]), "k", "v", "n") == [("a", 2, 2), ("b", 5, 1)]
    nums = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 9.0)] + [("b", 4.0), ("c", None)], "k string, v double")
    assert rows(votes.upper_median(nums, ["k"], "v"), "k", "median") == [("a", 3.0), ("b", 4.0)]


def test_checks(spark):
    units, items = spark.createDataFrame([(1,), (2,), (3,)], "u int"), spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "u int, want int")
    assert rows(checks.count_check(units, items, "u", F.max("want")), "u", "found", "status") == [(1, 2, "PASS"), (2, 1, "FAIL"), (3, 0, "NEEDS_REVIEW")]
    found = spark.createDataFrame([(1, "INFO"), (2, "WARNING"), (2, "FAIL")], "u int, severity string")
    assert rows(checks.worst_status(units, found, "u"), "u", "status") == [(1, "PASS"), (2, "FAIL"), (3, "PASS")]
    parts = spark.createDataFrame([(1, 2), (1, None), (2, 3), (2, 4)], "t int, n int")
    totals = spark.createDataFrame([(1, 9), (2, 8)], "t int, total int")
    assert rows(checks.total_check(parts, totals, "t", "n", "total"), "t", "parts") == [(2, 7)]
    letters = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "ç", 3), (2, "a", 0), (2, "c", 1)], "k int, l string, pos int")
    assert rows(checks.letter_sequence(letters, "k", "l", ["pos"]), "k", "letters", "good") == [(1, "abcç", True), (2, "ac", False)]


def test_diff(spark):
    a = spark.createDataFrame([(1, "k1", "x"), (1, "k2", "y"), (1, "k3", "z"), (1, "k3", "z")], "u int, key string, text string")
    b = spark.createDataFrame([(1, "k1", "X"), (1, "k4", "y"), (1, "k3", "z")], "u int, key string, text string")
    assert rows(diff.keyed_diff(a, b, ["u", "key"], "text"), "key", "status") == [("k1", "SADECE_BİÇİM_FARKI"), ("k2", "PDF_DE_VAR_EXCELDE_YOK"), ("k3", "İNCELEME_GEREKLİ"), ("k4", "EXCELDE_VAR_PDF_DE_YOK")]
    assert rows(diff.rematch(a, b, ["u"], "key", "text"), "left_key", "right_key") == [("k2", "k4")]
    units = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h")], "unit int, g string")
    assert rows(diff.default_scope(units, units.filter("unit = 1"), "g", "unit"), "unit") == [(1,), (2,)]
    assert diff.default_scope(units, units.limit(0), "g", "unit").count() == 3


def test_layout(spark):
    spans = spark.createDataFrame([(1, y, 0.0) for y in (0.0, 2.0, 4.0, 6.0)], "page int, y double, x double")
    assert rows(layout.group_rows(spans, ["page"], "y", "x"), "y", "row") == [(0.0, 1), (2.0, 1), (4.0, 2), (6.0, 2)]
    lines = spark.createDataFrame([(1, p, f"{p}99848461 - 2899848461") for p in range(1, 6)] + [(1, 1, "EBRU.I.1.1.")], "doc int, page int, line string")
    assert rows(layout.repeated_lines(lines, "doc", "page", "line"), "shape", "n") == [("# - #", 5)]
    colors = spark.createDataFrame([(0x0A0A0A,), (0x141414,), (0x151414,), (0xFFFFFF,)], "c int")
    assert rows(layout.near_colors(colors, spark.createDataFrame([(0x0A0A0A,)], "b int"), "c", "b"), "color") == [(0x0A0A0A,), (0x141414,)]


def test_sequences(spark):
    df = spark.createDataFrame([("t", 1, 5), ("t", 2, 7), ("s", 3, 4), ("s", 4, 4)], "title string, tab int, hours int")
    assert rows(sequences.expected_alternatives(df, "title", "tab", "hours"), "tab", "role") == [(1, "ALTERNATIVE"), (2, "SUMMARY"), (3, "SUMMARY"), (4, "SUMMARY")]


def book() -> bytes:
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Tema</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="AB2" t="inlineStr"><is><t>in</t></is></c><c r="C2"/></row></sheetData></worksheet>')
    return made.getvalue()


def test_sheets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(book())
    (tmp_path / "in/bad.xlsx").write_bytes(b"no zip")
    cells = sheets.read_sheets(spark, str(tmp_path)).cache()
    assert rows(cells.filter("error is null"), "address", "col", "raw") == [("A1", 1, "Tema"), ("A2", 1, "ab"), ("AB1", 28, "7"), ("AB2", 28, "in")]
    assert cells.filter("error is not null").count() == 1
    assert rows(sheets.with_headers(cells.filter("error is null")), "header", "raw") == [("7", "in"), ("Tema", "ab")]
    answers = spark.createDataFrame([('{"titles": ["a"], "x": 1}',), ("[1]",), ("no",)], "a string").select(sheets.parse_answer(F.col("a")).alias("p")).collect()
    assert [r.p and r.p.titles for r in answers] == [["a"], None, None]


def test_ingest(spark, tmp_path):
    source, done = str(tmp_path / "files"), str(tmp_path / "done")
    rows_in = spark.range(10).withColumn("ts", F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, id))"[:-1]))
    rows_in.coalesce(1).write.parquet(source)
    batches = []

    def sink(batch, number):
        batches.append(batch.count())
        batch.write.mode("append").parquet(done)

    for want in (10, 10, 20):
        if want == 20:
            rows_in.coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_stream(spark, source, rows_in.schema, str(tmp_path / "ck"), sink)
        assert spark.read.parquet(done).count() == want
    assert rows(ingest.drift_counts(spark.read.parquet(done), "ts", "id"), "n") == [(2,)] * 10
    pending = ingest.pending_files(spark, source, None, "v1", "*.parquet")
    assert pending.count() == 2 and ingest.pending_files(spark, source, pending, "v1", "*.parquet").count() == 0 and ingest.pending_files(spark, source, pending, "v2", "*.parquet").count() == 2


def test_ingest_changed(spark, tmp_path):
    """A rerun does nothing; a changed file is read again, and so is everything under other settings; a failed run adds nothing."""
    source, state, taken = tmp_path / "in", str(tmp_path / "state"), []
    source.mkdir()
    for name in "ab":
        (source / f"{name}.txt").write_text("one")

    def sink(files):
        taken.append(sorted((r.path.rsplit("/", 1)[1], r.status) for r in files.collect()))

    def failing(files):
        raise OSError("full")

    with pytest.raises(OSError):
        ingest.ingest_changed(spark, str(source), state, failing)
    run = lambda settings="": ingest.ingest_changed(spark, str(source), state, sink, settings)
    assert [run(), run()] == [2, 0]
    (source / "a.txt").write_text("other")
    (source / "c.txt").write_text("new")
    assert [run(), run(), run("v2"), run("v2")] == [2, 0, 3, 0]
    assert taken == [[("a.txt", "new"), ("b.txt", "new")], [("a.txt", "changed"), ("c.txt", "new")], [("a.txt", "changed"), ("b.txt", "changed"), ("c.txt", "changed")]]


def test_learn_labels_of_long_documents(spark, tmp_path):
    """Units past the 1000th of a document are not those of the next one."""
    from docrecon.plans import structure_queries

    long = "\n".join(["head", "x", "x"] * 1000 + ["late", "y", "y"] * 60)
    short = "\n".join(["late", "y", "y"] * 60)
    spark.createDataFrame([(1, "s", long), (2, "s", short)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = structure_queries.q_learn_labels(spark, str(tmp_path))
    assert rows(found, "label", "units", "place") == [("head", 1000, 1), ("late", 120, 3), ("x", 1000, 2), ("y", 120, 4)]


def test_rows_of_one_large_key(spark):
    """Rows of any size are folded without holding a key: its plan gathers no list, and the rows are those of a loop."""
    n = 60_000
    spans = spark.range(n).selectExpr("id % 3 div 2 as page", "cast(id * 7919 % 60000 as double) / 8 as y", "id as x").unionAll(spark.createDataFrame([(9, None, 1), (9, None, 2), (9, 1.0, 3)], "page long, y double, x long"))
    grouped = layout.group_rows(spans, ["page"], "y", "x")
    assert "collect_list" not in grouped._jdf.queryExecution().toString()
    want, at = [], {}
    for r in sorted(spans.collect(), key=lambda r: (r.page, r.y is not None, r.y or 0.0, r.x)):
        first, number = at.get(r.page, (None, 0))
        if first is None or abs(r.y - first) > 3.0:
            first, number = r.y, number + 1
        at[r.page] = first, number
        want.append((r.x, r.page, number))
    assert rows(grouped, "x", "page", "row") == sorted(want)
    # no number stands after all others, one row each; repeated spans share their row
    odd = spark.createDataFrame([(1, float("nan"), 1), (1, 5.0, 2), (1, 5.0, 2), (1, None, 3), (1, 9.0, 4)], "page long, y double, x long")
    assert rows(layout.group_rows(odd, ["page"], "y", "x"), "x", "row") == [(1, 4), (2, 2), (2, 2), (3, 1), (4, 3)]


def test_near_colors_make_no_pairs(spark):
    """Every colour of a dense cube against a dense base: counts as by all pairs, over slabs and at the cube's sides, and no
    join makes the pairs."""
    cube = spark.range(0, 18 * 18).selectExpr("id % 18 * 15 as a", "id div 18 * 15 as b").selectExpr("cast(a * 65536 + b * 256 + (a + b) % 256 as int) as c")
    some = cube.filter("c % 3 = 0").withColumnRenamed("c", "b").unionAll(spark.createDataFrame([(None,), (0xFFFFFF,), (0xFFFFFF,)], "b int"))
    for tolerance in (0, 10, 40, 300):
        pairs = cube.crossJoin(some.filter("b is not null").distinct()).filter(layout.color_distance(F.col("c"), F.col("b")) <= tolerance)
        found = layout.near_colors(cube.unionAll(spark.createDataFrame([(None,), (0,)], "c int")), some, "c", "b", tolerance)
        assert "Join" not in found._jdf.queryExecution().toString()
        assert rows(found, "color", "near") == rows(pairs.groupBy("c").agg(F.count("*").alias("near")), "c", "near")
    assert layout.near_colors(cube, some, "c", "b", -1).count() == 0


def test_points_in_boxes_by_cells_of_both_axes(spark):
    """Pairs as by all pairs; points of cells without a box, and boxes of other heights, reach no candidate."""
    points = spark.range(4000).selectExpr("id as p", "id % 3 as page", "cast(id * 37 % 101 as double) - 50 as x", "cast(id * 53 % 97 as double) / 3 - 4 as y", "id % 2 as kind").unionAll(spark.createDataFrame([(-1, 0, None, 1.0, 0), (-2, 0, 1.0, float("nan"), 0)], "p long, page long, x double, y double, kind long"))
    boxes = spark.range(60).selectExpr("id as box", "id % 3 as page", "cast(id as double) - 30 as x0", "cast(id as double) - 22.5 as x1", "cast(id % 9 as double) as y0", "cast(id % 9 as double) + 4 as y1", "id % 2 as kind").unionAll(spark.createDataFrame([(99, 1, -1000.0, 1000.0, 7.0, 9.0, 1)], "box long, page long, x0 double, x1 double, y0 double, y1 double, kind long"))
    inside = "x between x0 - 1.5 and x1 + 1.5 and y between y0 - 1.5 and y1 + 1.5"
    want = points.drop("kind").join(boxes, "page").filter(inside)
    met = layout.points_in_boxes(points.drop("kind"), boxes, "page", "x", "y", 8.0, 1.5, cell_y=4.0)
    assert rows(met, "p", "box") == rows(want, "p", "box") == rows(layout.points_in_boxes(points.drop("kind"), boxes, "page", "x", "y", 8.0, 1.5), "p", "box")
    assert rows(layout.points_in_boxes(points, boxes, "page", "x", "y", 8.0, 1.5, 4.0, ("kind",)), "p", "box") == rows(points.join(boxes, ["page", "kind"]).filter(inside), "p", "box")
    near = layout.points_near_boxes(points, boxes.filter("box < 60"), "page", "x", "y", 8.0, 1.5, 4.0)
    assert 0 < near.count() < points.count() // 2 and near.filter("p >= 0").agg(F.max("y")).head()[0] < 16
    assert layout.points_near_boxes(points, boxes, "page", "x", "y", 8.0, 1.5, 4.0, max_broadcast_cells=3).count() == points.count()


def test_code_words_meet_by_equality(spark):
    """What code_starts offers equals a code's bare form exactly where is_code_word holds."""
    from docrecon.operators import learn

    words = spark.createDataFrame([(w,) for w in ("D1.0", "(D1.0)", "“D1.0.Merak", "D1.0,", "D1.00", "D1.0.1", "[\"D1.0x", "D1", "'D1.", "D10", "", "D1.0_", "xD1", None)], "word string")
    codes = spark.createDataFrame([(c,) for c in ("D1.0.", "D1;", " D1.0.1 ", "", None)], "code string")
    want = words.crossJoin(codes).filter(learn.is_code_word(F.col("word"), F.col("code")))
    found = learn.code_starts(words, codes, "word", "code").join(codes, F.col("start") == learn.bare_code(F.col("code")))
    assert rows(found, "word", "code") == rows(want, "word", "code") and found.count() == 8


def test_fields_are_dealt_out_once(spark):
    """Offsets, texts and places of needles by a loop over spans with white space at their ends, gaps and blanks; all of them
    read one exchange of the spans."""
    import random

    from docrecon.operators import fields

    rng = random.Random(3)
    spans = []
    for i in range(600):
        text = rng.choice(["", " ", "\t"]) + rng.choice(["a", "bb", "c d", "", "ab"]) + rng.choice(["", " ", "\n", " \n"])
        x0 = float(rng.randrange(60))
        spans.append((rng.choice([1, 2, 3, None]), rng.randrange(12), x0, x0 + rng.randrange(5), 10.0, i, rng.randrange(3), text))
    df = spark.createDataFrame(spans, "field long, row int, x0 double, x1 double, size double, id long, page int, text string")
    offsets, want, texts = fields.span_offsets(df), [], {}
    white = " \t\n\x0b\f\r"
    for field in (1, 2, 3):
        at, lines = 0, []
        for row in range(12):
            held, line, places = sorted((s for s in spans if s[:2] == (field, row) and s[7].strip(white)), key=lambda s: (s[2], s[5])), "", []
            for before, s in zip([None, *held], held):
                gap = before is not None and s[2] - before[3] > 0.15 * s[4] and not before[7].removesuffix("\n").endswith((" ", "\t")) and not s[7].startswith((" ", "\t"))
                line += " " * gap + s[7]
                places.append((s[5], len(line) - len(s[7]), len(line)))
            lead, size = len(line) - len(line.lstrip(white)), len(line.strip(white))
            want += [(field, k, min(max(a - lead, 0), size) + at, min(max(b - lead, 0), size) + at) for k, a, b in places]
            if held:
                at += size + 1
                lines.append(line.strip(white))
        texts[field] = "\n".join(lines)
    assert rows(offsets, "field", "id", "start", "end") == sorted(want)
    found = fields.field_texts(offsets)
    assert {r.field: r.text for r in found.collect()} == texts
    assert all(set(r.ids) == {k for f, k, _, _ in want if f == r.field} and r.pages == sorted(set(r.pages)) for r in found.collect())
    needles = [(f, n) for f, t in texts.items() for n in (t[5:11], t[20:24], t[:3], "zz")]
    met = fields.text_places(offsets, found, spark.createDataFrame(needles, "field long, needle string"))
    hits = []
    for f, n in needles:
        a = texts[f].find(n)
        a, b = a + len(n) - len(n.lstrip(white)), a + len(n.rstrip(white))
        hits += [(f, n, k) for g, k, s, e in want if g == f and texts[f].find(n) >= 0 and a < b and s < b and e > a]
    assert rows(met, "field", "needle", "id") == sorted(hits) and hits
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    dealt = [line for line in plan if "REPARTITION_BY_COL" in line]
    assert len(dealt) > 1 and sum("ReusedExchange" not in line for line in dealt) == 1
