"""Cells, tables, labels, fields and skewed keys on hand-made rows. Codes, names and labels are fixed values."""

import pytest
from pyspark.sql import functions as F

from docrecon.functions import labels
from docrecon.functions.keys import label_tokens
from docrecon.operators import cells, diff, expected, layout, learn, matching, schema, segment, sheets, tables


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("sheet", "document", "want"),
    [
        ("KB2.2. Gözlemleme Becerisi", "KB2.2. Gözlemleme", "AYNI"), ("KB2.2. Gözlemleme BECERİSİ", "KB2.2. Gözlemleme", "AYNI"), ("KB2.4. Çözümleme Becerisi", "KB2.4 Çözümleme", "BİÇİM"),
        ("OB5. Kültür Okuryazarlıği", "OB5. Kültür Okuryazarlığı", "FARKLI"), ("KB2.2. Gözlemleme Becerileri", "KB2.2. Gözlemleme", "FARKLI"), ("KB2.2. Becerisi Gözlemleme", "KB2.2. Gözlemleme", "FARKLI"),
        ("KB2.2. Gözlemleme Becerisi", "KB2.2. Gözlem", "FARKLI"), ("KB2.2. Gözlemleme Becerisi", "KB2.2. Gözlemleme Becerisi", "AYNI"), ("", "", "BOŞ"), ("yok", "", "BOŞ"), ("E1. Merak", "", "YALNIZCA_SİSTEM"), ("", "E1. Merak", "YALNIZCA_PDF"),
    ],
)
def test_code_cells(spark, sheet, document, want):
    found = cells.code_cells(spark.createDataFrame([(1, sheet, document)], "id int, s string, d string"), ["id"], "s", "d").collect()
    assert [r.status for r in found] == [want]


def test_cells_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a\nb", "A, b"), (3, "a", "a, c")], "id int, s string, d string")
    assert rows(cells.item_cells(df, ["id"], "s", "d"), "id", "status", "only_document") == [(1, "BOŞ", ""), (2, "BİÇİM", ""), (3, "FARKLI", "c")]
    assert rows(cells.code_cells(df, ["id"], "s", "d"), "id", "status") == [(1, "BOŞ"), (2, "FARKLI"), (3, "FARKLI")]
    assert cells.code_cells(df.limit(0), ["id"], "s", "d").count() == 0 and cells.item_cells(df.limit(0), ["id"], "s", "d").count() == 0
    schema_of = "theme int, lo int, pos int, header string, value string"
    one = spark.createDataFrame([(1, None, None, "Tema", "Ad"), (1, 0, None, "Çıktı", "x"), (1, 0, 1, "Bileşen", "y"), (2, None, None, "Tema", "Tek")], schema_of)
    grid = cells.grid_cells(one, one.filter("theme = 1"), [])
    assert rows(cells.grid_rows(grid, "Bileşen"), "theme", "lo", "pos", "first_of_theme", "status") == [(1, 0, 1, True, "AYNI"), (2, None, 0, True, "YALNIZCA_PDF")]
    assert cells.grid_rows(grid.limit(0), "Bileşen").count() == 0


def test_context_in_title(spark):
    cases = {("9. SINIF", "FİZİK DERSİ 9. SINIF"): True, ("9. SINIF", "9. SINIF BİYOLOJİ DERSİ"): True, ("1. SINIF", "11. SINIF"): False, ("9. SINIF TEMALARI", "9. SINIF KİMYA DERSİ"): True, ("SINIF TEMALARI", "SINIF KİMYA"): False, ("", "x"): False}
    df = spark.createDataFrame([(c, t, w) for (c, t), w in cases.items()], "c string, t string, w boolean")
    assert df.filter(tables.context_in_title(label_tokens(F.col("c")), label_tokens(F.col("t"))) != F.col("w")).count() == 0
    assert rows(df.limit(1).select(tables.row_name_key(F.lit("MAT.1.3. Nesneler")).alias("k"), tables.row_name_key(F.lit("1. Sayılar")).alias("n")), "k", "n") == [("nesneler", "sayilar")]
    names = {"MAT.1 Nesneler": "nesneler", "2. MAT. 1 . 3 . Nesneler": "nesneler", "MAT. Nesneler": "matnesneler", "1.": "1", "MAT.1.3.": None, "A.B. 1. x": "ab1x", "MAT.1.3 Sayı 5. Adım": "sayi5adim", "12": "12"}
    df = spark.createDataFrame(list(names.items()), "t string, want string")
    assert df.filter(~tables.row_name_key(F.col("t")).eqNullSafe(F.col("want"))).collect() == []


def test_connectors_and_titles(spark):
    df = spark.createDataFrame([("ÖĞRENME ÇIKTILARI VE ", True, False), ("VE SÜREÇ ", False, True), ("Genellemeler/", False, False), ("ALAN BECERİLERİ", False, False), ("VERİLER", False, False)], "t string, e boolean, s boolean")
    assert df.filter((labels.ends_with_connector(F.col("t")) != F.col("e")) | (labels.starts_with_connector(F.col("t")) != F.col("s"))).count() == 0
    codes = spark.createDataFrame([(x,) for x in ("MÜZ.5.1.6. Müzik yazısı", "MÜZ. 5.1.6. ", "MÜZ 5.1.3.", "MÜZ.7.2.10.", "MÜZİK DERSİ", "MÜZ.5.1 eksik", "Bu MÜZ.5.1.3. satır")], "t string")
    got = {r.t: r.c for r in codes.withColumn("c", labels.leading_code(F.col("t"), F.lit("MÜZ"), F.lit("nnn"))).collect()}
    assert {t: c for t, c in got.items() if c} == {"MÜZ.5.1.6. Müzik yazısı": "MÜZ.5.1.6.", "MÜZ. 5.1.6. ": "MÜZ. 5.1.6.", "MÜZ 5.1.3.": "MÜZ 5.1.3.", "MÜZ.7.2.10.": "MÜZ.7.2.10."}
    shapes = {"EBRU.I.1.1.": ("EBRU", "ann"), "SBÇ.II.4.1": ("SBÇ", "ann"), "MAT.T.11.1.1.": ("MAT", "annn"), "MOY.1.1.": ("MOY", "nn"), "MAT1.1.": ("MAT", "nn"), "ARN.5.1.SÖS": ("ARN", "nna"), "MÜZ. 5.1.6.": ("MÜZ", "nnn"), "D7. Estetik": None, "MAT II 5.1": None, "MAT.5.1.2Sayı": ("MAT", "nnn"), "ENG.PREP.1.S3.": ("ENG", "ana"), "ENG.9.1.L1": ("ENG", "nna"), "ARN.5.1.SÖS, x": ("ARN", "nn"), "": None, "5.1.2": None}
    got = {r.t: tuple(r.s) if r.s else None for r in spark.createDataFrame([(x,) for x in shapes], "t string").withColumn("s", labels.lo_shape(F.col("t"))).collect()}
    assert got == shapes
    written = {("ARN.5.1.SÖS Metin", "nna"): "ARN.5.1.SÖS", ("ARN5.1.D; x", "nna"): "ARN5.1.D", ("ARN.5.1.2Telif", "nnn"): None, ("ARN.5.1.2.Telif", "nnn"): "ARN.5.1.2.", (" ARN.6.4.0. ", "nna"): "ARN.6.4.0.", ("ARN.6.4.0. metin", "nna"): None, ("ARN.6.4.", "nnn"): "ARN.6.4.", ("ARN..6.4", "nn"): None, ("BAŞKA.6.4.1", "nnn"): None}
    df = spark.createDataFrame([(*k, v) for k, v in written.items()], "t string, types string, want string")
    assert df.filter(~labels.outcome_code(F.col("t"), F.lit("ARN"), F.col("types")).eqNullSafe(F.col("want"))).collect() == []
    titles = {"3. TEMA: AD": (3, "AD", True), "TEMA 3: AD": (3, "AD", False), " 3 . Tema :\nAD ": (3, "AD", True), "3. TEMA:": None, "3. BÖLÜM: AD": None, "TEMA: AD": None, "3: AD": None, "3.1. TEMA: AD": None}
    df = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("u", labels.unit_title(F.col("t"), F.lit("Tema"), F.lit(False)))
    assert {r.t: tuple(r.u) if r.u else None for r in df.collect()} == titles
    parts = F.array(F.lit("genellemeler"), F.lit("ilkeler"), F.lit("anahtarkavramlar"))
    words = {"Genellemeler/Anahtar Kavramlar": True, "İlkeler/ Genellemeler": False, "Genellemeler": False, "Genellemeler/Başka": False}
    got = {r.t: r.s for r in spark.createDataFrame([(x,) for x in words], "t string").withColumn("s", labels.compound_subset(F.col("t"), parts)).collect()}
    assert got == words


def test_code_words(spark):
    cases = {("D1", "D1"): True, ("(D1,", "D1."): True, ("E1.1.Merak", "E1.1"): True, ("D10", "D1"): False, ("D1.1", "D1"): False, ("xD1", "D1"): False}
    df = spark.createDataFrame([(w, c, x) for (w, c), x in cases.items()], "w string, c string, x boolean")
    assert df.filter(learn.is_code_word(F.col("w"), F.col("c")) != F.col("x")).count() == 0


def test_recurring_label_is_reported_once(spark):
    texts = ["Learning-Teaching Practices"] * 4 + ["Leaning-Teaching Practices"]
    df = spark.createDataFrame([(1, f"U{i:02d}", i, t) for i, t in enumerate(texts, 1)], "doc int, unit string, at int, label string")
    assert rows(schema.recurring_unknown(df, "doc", "unit", "at", "label"), "code", "unit", "severity") == [("LABEL_NOT_IN_STRUCTURE", None, "INFO"), ("LABEL_TEXT_VARIANT", "U05", "NEEDS_REVIEW")]


def test_furniture(spark):
    spans = [(1, p, f"{p}99848461 - 2899848461", -35.0, 400.0, True) for p in range(1, 6)] + [(1, 1, "EBRU.I.1.1.", 400.0, 410.0, False)] + [(1, p, "body line", 300.0, 310.0, False) for p in range(1, 6)] + [(1, p, str(p), 800.0, 812.0, False) for p in (1, 2)]
    df = spark.createDataFrame([(*s, 842.0) for s in spans], "doc int, page int, text string, y0 double, y1 double, tilted boolean, height double")
    found = layout.furniture(df, "doc", "page", "text", "y0", "y1", "height", "tilted")
    assert rows(found, "text", "why") == sorted([(f"{p}99848461 - 2899848461", "tilted") for p in range(1, 6)] + [("1", "number"), ("2", "number")], key=repr)


def test_overrides(spark):
    df = spark.createDataFrame([("a.pdf", "1. TEMA: X", None, "12-13, 15", "7.0"), ("b.pdf", None, None, "yok", None), ("c.pdf", None, None, "x-2", None), ("d.pdf", None, None, None, "p7"), ("e.pdf", None, None, None, None), (None, "x", None, None, None)], "name string, title string, code string, pages string, start string")
    assert rows(sheets.read_overrides(df), "name", "pages", "start", "error") == [("a.pdf", [12, 13, 15], 7, None), ("b.pdf", [], None, None), ("c.pdf", None, None, "pages: x-2"), ("d.pdf", None, None, "start: p7")]


def test_hot_keys_meet_in_few_rows(spark):
    """One key with nearly all rows: what goes through each join stays in proportion."""
    many = spark.range(3000).select(F.lit(1).alias("doc"), F.col("id").alias("section"), F.lit("the very same line of a text").alias("key"))
    assert diff.found_elsewhere(many, many, "doc", "section", "key").filter("found_in = 0").count() == 2999
    units, given = spark.range(3000).select(F.lit("c").alias("k"), F.col("id").alias("u")), spark.range(3000).select(F.lit("c").alias("k"), F.col("id").alias("r"))
    assert expected.unique_match(units, given, ["k"], "u", "r").count() == 0 and expected.ambiguous_rows(units, given, ["k"], "u", "r").count() == 3000
    texts = spark.range(2000).select("id", F.split(F.concat(F.lit("the the of the "), F.col("id").cast("string"), F.lit(" end")), " ").alias("t"))
    phrases = spark.createDataFrame([(1, ["the", "1999", "end"]), (2, ["of", "the"]), (3, ["missing", "the"])], "p int, w array<string>")
    found = matching.contained_phrases(texts, phrases, "t", "w", "p", ["id"])
    assert found.filter("p = 1").select("id", "at").collect() == [(1999, 3)] and found.filter("p = 2").count() == 2000 and found.filter("p = 3").count() == 0
    spans = spark.range(5000).select(F.lit(1).alias("page"), "id", (F.col("id") % 100).alias("c"), F.lit("x").alias("t"))
    runs = segment.title_runs(spans, ["page"], "id", "c", "t").collect()
    assert [r.run for r in runs] == list(range(500)) and {len(r.text.split()) for r in runs} <= {1, 10, 11}


def test_title_runs_cut_and_counted(spark):
    """One key over many blocks against a loop: neighbours apart, near the first again, without colour and repeated."""
    colours = [(i * 7919 % 31) * 0x010203 if i % 11 else None for i in range(4000)]
    given = [(1, i, c, str(i)) for i, c in enumerate(colours)] + [(2, 5, 8, "a"), (2, 5, 8, "a"), (None, 1, 30, None)]
    runs = segment.title_runs(spark.createDataFrame(given, "page int, id int, c int, t string"), ["page"], "id", "c", "t", block=64)
    want, first = [], None
    for i, c in enumerate(colours):
        if c is not None and first is not None and max(abs((c >> s & 255) - (first >> s & 255)) for s in (16, 8, 0)) <= 10:
            want[-1] += f" {i}"
        else:
            want, first = [*want, str(i)], c
    found = {(r.page, r.run): r.text for r in runs.collect()}
    assert found == {(1, n): t for n, t in enumerate(want)} | {(2, 0): "a a", (None, 0): ""}
