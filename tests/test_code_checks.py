"""Declared and used codes by category, and applications without their label, on small cases."""

from pyspark.sql import functions as F

from docrecon.operators import code_checks as C
from docrecon.operators import segment

USED, DECLARED = "unit int, prefix string, segments array<string>", "unit int, place int, category string, prefix string, segments array<string>"


def test_code_checks(spark):
    used = spark.createDataFrame(
        [(1, "D", ["1"]), (1, "D", ["1"]), (1, "D", ["2", "4"]), (1, "KB", ["2", "1"]), (1, "KB", ["3", "9"]), (1, "X", ["1"]), (1, "SAB", ["9"]), (1, "E", ["1"]), (2, "D", ["7"]), (1, None, ["1"]), (1, "D", None)], USED
    )
    declared = spark.createDataFrame(
        [
            (1, 1, "DEĞERLER", "D", ["2"]), (1, 2, "DEĞERLER", "D", ["3"]), (1, 3, "DEĞERLER", "D", ["2"]), (1, 4, "A > KAVRAMSAL", "KB", ["2", "1"]), (1, 5, "İLİŞKİLER", "KB", ["3", "1"]), (1, 6, "ALAN BECERİLERİ", "SAB", ["1"]),
            (3, 1, "EĞİLİMLER", "E", ["1", "1"]), (1, 7, "EĞİLİMLER", "E", ["2", "1"]), (1, 8, "BOŞ", None, ["1"]),
        ],
        DECLARED,
    )
    found = {(r.unit, r.category): (r.declared, r.used, r.unused, r.undeclared) for r in C.code_checks(C.code_roles(used, declared, ["unit"]), ["unit"]).collect()}
    assert found == {
        (1, "DEĞERLER"): ("D2, D3", "D2.4, D1", "D3", "D1"), (1, "A > KAVRAMSAL"): ("KB2.1", "KB2.1", "", ""), (1, "İLİŞKİLER"): ("KB3.1", "KB3.9", "KB3.1", "KB3.9"), (1, "EĞİLİMLER"): ("E2.1", "", "E2.1", ""),
        (3, "EĞİLİMLER"): ("E1.1", "", "E1.1", ""), (1, C.UNPLACED): ("", "X1", "", "X1"), (2, C.UNPLACED): ("", "D7", "", "D7"),
    }
    missing = C.undeclared_codes(used, declared, ["unit"])
    assert {(r.unit, r.prefix, r.incomplete) for r in missing.collect()} == {(1, "D", False), (1, "KB", False), (1, "X", False), (1, "E", True), (2, "D", False)}
    more = missing.unionByName(spark.createDataFrame([(1, "KB", ["5", "5"], False)], missing.schema))
    places = {(r.unit, r.prefix, ".".join(r.segments), r.category, r.how) for r in C.declaring_sections(more, declared, ["unit"]).collect()}
    assert places == {
        (1, "D", "1", "DEĞERLER", "placed"), (1, "KB", "3.9", "İLİŞKİLER", "placed"), (1, "X", "1", None, None), (1, "E", "1", "EĞİLİMLER", "placed"), (2, "D", "7", None, None),
        (1, "KB", "5.5", "A > KAVRAMSAL", "prefix"), (1, "KB", "5.5", "İLİŞKİLER", "prefix"),
    }
    assert C.code_checks(C.code_roles(used.limit(0), declared.limit(0), ["unit"]), ["unit"]).count() == 0


def test_unlabelled_applications(spark):
    rows = spark.createDataFrame(
        [("a", u, 1, p, p == 1) for u in (1, 2) for p in (1, 2)] + [("a", 3, 4, 1, False), ("a", 3, 4, 2, True), ("a", 3, 4, 3, False), ("a", 3, 5, 1, False), ("a", 3, 6, 1, True), ("b", 9, 1, 1, False), ("b", 9, 1, 2, True)],
        "doc string, unit int, section int, pos int, m boolean",
    )
    sections = spark.createDataFrame(
        [("a", 1, 1, "applications", "uyg"), ("a", 2, 1, "applications", "uyg"), ("a", 3, 4, "applications", "giris"), ("a", 3, 5, "applications", None), ("a", 3, 6, "other", "x"), ("b", 9, 1, "applications", "y")],
        "doc string, unit int, section int, kind string, key string",
    )
    moved = segment.unlabelled_applications(rows, sections, "doc", "unit", "section", "pos", "m")
    assert sorted(tuple(r) for r in moved.collect()) == [("a", 3, 4, 2, True), ("a", 3, 4, 3, False)]
    assert segment.unlabelled_applications(rows.filter(F.lit(False)), sections, "doc", "unit", "section", "pos", "m").count() == 0
