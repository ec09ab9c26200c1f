"""Ranked and ordered matches on hand-made rows: codes to categories, headers to sections, answers to extracted texts."""

import random

from pyspark.sql import functions as F

from docrecon.operators import answers, cells
from docrecon.operators import code_columns as K


def test_code_categories(spark):
    """The last exact declaration wins over an earlier cover, the first cover over the first of the prefix; a longer declared code
    covers nothing, and another unit's codes count for nothing."""
    declared = spark.createDataFrame(
        [(1, 1, "A > DEĞERLER", "D", ["3"], "D3"), (1, 2, "EĞİLİMLER", "D", ["3", "1"], "D3.1 bir"), (1, 3, "DEĞERLER", "D", ["3", "1"], "D3.1 iki"), (1, 4, "ALAN BECERİLERİ", "E", ["1", "2"], "E1.2"), (2, 1, "BAŞKA", "F", ["1"], "F1")],
        "unit int, place int, category string, prefix string, segments array<string>, entry string",
    )
    used = spark.createDataFrame([(1, 1, "D", ["3", "1"]), (1, 1, "D", ["3", "1"]), (1, 1, "D", ["3", "2"]), (1, 1, "D", ["9"]), (1, 1, "E", ["1"]), (1, 2, "F", ["1"])], "unit int, lo int, prefix string, segments array<string>")
    found = K.code_categories(used, declared, ["unit"])
    got = {(r.prefix, ".".join(r.segments)): (r.category, r.entry, r.how) for r in found.collect()}
    assert got == {("D", "3.1"): ("DEĞERLER", "D3.1 iki", "exact"), ("D", "3.2"): ("A > DEĞERLER", None, "cover"), ("D", "9"): ("A > DEĞERLER", None, "prefix"), ("E", "1"): ("ALAN BECERİLERİ", None, "prefix"), ("F", "1"): (None, None, None)}
    assert found.count() == 5 and {r.header for r in K.column_codes(found).collect()} == {"Erdem-Değer-Eylem Çerçevesi"}
    assert [r.entry for r in K.declared_entries_of(used.filter("array_join(segments, '.') = '3.1'").distinct(), declared, ["unit"]).collect()] == ["D3.1 bir"]
    assert [r.prefix for r in K.field_skill_prefixes(declared).collect()] == ["E"]
    lost = spark.createDataFrame([(1, "D", ["14"]), (1, "D", ["3", "9"]), (1, "E", ["1"]), (1, "F", ["1"])], "unit int, prefix string, segments array<string>")
    one = declared.filter("place = 1")
    assert [(r.prefix, r.category) for r in K.placed_undeclared(lost, one, ["unit"]).orderBy("segments").collect()] == [("D", "A > DEĞERLER")] * 2
    assert K.placed_undeclared(lost, declared, ["unit"]).collect() == []  # three categories have D3
    split = declared.filter("place = 1").unionByName(one.withColumns({"category": F.lit("KAVRAMSAL"), "segments": F.array(F.lit("14"))}))
    assert [(r.segments, r.category) for r in K.placed_undeclared(lost.filter("prefix = 'D'"), split, ["unit"]).orderBy("segments").collect()] == [(["14"], "KAVRAMSAL"), (["3", "9"], "A > DEĞERLER")]


def test_code_categories_are_dealt_out_once(spark):
    """Codes of any depth, copies, nulls and empty codes against a loop; either side is dealt out once, for one join."""
    rng = random.Random(5)
    code = lambda: [rng.choice("12") for _ in range(rng.randrange(5))]
    used = [(rng.choice([1, 2, None]), rng.randrange(2), rng.choice("DE"), code()) for _ in range(300)] + [(1, 0, "D", None), (1, 0, None, ["1"]), (1, 0, "D", ["1", "2", "1", "1", "2", "2", "1"])]
    declared = [(rng.choice([1, 2, None]), place, f"c{place % 7}", rng.choice("DEF"), code(), f"e{place}") for place in range(25)] + [(1, 99, "none", None, ["1"], "x"), (1, 98, "none", "D", None, "x")]
    kinds = "unit int, lo int, prefix string, segments array<string>", "unit int, place int, category string, prefix string, segments array<string>, entry string"
    want = {}
    for unit, lo, prefix, segments in used:
        known = [d for d in declared if unit is not None and (d[0], d[3]) == (unit, prefix) and prefix and d[4] is not None]
        exact, cover = [d for d in known if d[4] == segments], [d for d in known if segments is not None and segments[: len(d[4])] == d[4]]
        best = (max(exact), "exact") if exact else (min(cover), "cover") if cover else (min(known), "prefix") if known else ((0, 0, None), None)
        want[unit, lo, prefix, None if segments is None else tuple(segments)] = best[0][2], best[0][5] if exact else None, best[1]
    found = K.code_categories(spark.createDataFrame(used, kinds[0]), spark.createDataFrame(declared, kinds[1]), ["unit"])
    rows = found.collect()
    assert {(r.unit, r.lo, r.prefix, r.segments if r.segments is None else tuple(r.segments)): (r.category, r.entry, r.how) for r in rows} == want and len(rows) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("HashJoin") == 1 and "SortMergeJoin" not in plan


def test_header_sections(spark):
    sections = spark.createDataFrame(
        [(1, 1, "öğrenmeçiktilari", "other"), (1, 2, "öğrenmeçiktilarivesüreç", "other"), (1, 3, "kisa", "other"), (1, 4, "öğrenmeçiktilari", "other"), (1, 5, "gruplamalar", "group"), (1, 6, None, "applications"), (2, 1, None, "applications"), (2, 2, "öğrenmeöğretmeuygulamalari", "other")],
        "unit int, pos int, key string, kind string",
    )
    headers = ["ÖĞRENME ÇIKTILARI (ek)", "Öğrenme çıktıları ve süreç bileşenleri", "Kısa ek", "Kısa", "Gruplamalar", "Öğrenme-Öğretme Uygulamaları / Programlar", "Başka"]
    found = K.header_sections(spark.createDataFrame([(h,) for h in headers], "header string"), sections, ["unit"])
    assert {(r.unit, r.header): r.pos for r in found.collect()} == {(1, headers[0]): 1, (1, headers[1]): 2, (1, headers[3]): 3, (1, headers[5]): 6, (2, headers[5]): 2}


def test_answers_against_a_loop(spark):
    """One-to-one in the order of either side, with repeats and near spellings."""
    draw = random.Random(2)
    words = ["değerler", "degerler", "eğilimler", "egilimler", "D1", "D1.", "D1.1", "kısa", "kise", None, "okuryazarlık", "okuryazarlik"]
    left = [(p, k, i, 7, draw.choice(words)) for p in range(60) for k in ("codes", "section_headings") for i in range(draw.randint(0, 6))]
    right = [(p, k, i, draw.choice(words)) for p in range(60) for k in ("codes", "section_headings") for i in range(draw.randint(0, 6))]
    e, s = spark.createDataFrame(left, "page int, kind string, pos int, unit int, text string"), spark.createDataFrame(right, "page int, kind string, pos int, text string")
    key = {(k, w): r for k in ("codes", "section_headings") for w in words if w for r in [spark.createDataFrame([(k, w)], "k string, w string").select(answers.answer_key(F.col("k"), F.col("w"))).head()[0]]}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def same(kind, a, b):
        if a is None or b is None:
            return False
        a, b = key[kind, a], key[kind, b]
        return a == b or (kind != "codes" and len(a) >= 6 and distance(a, b) <= max(1, len(a) // 10))

    want, taken = set(), set()
    for p, k, i, _, text in left:
        for p2, k2, j, other in right:
            if (p2, k2) == (p, k) and (p, k, j) not in taken and same(k, text, other):
                taken.add((p, k, j))
                want.add((p, k, i, j))
                break
    assert {tuple(r) for r in answers.matched_answers(e, s).collect()} == want
    pages = answers.compared_pages(e, s).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in pages} == {"UYUMLU": len(want), "YALNIZCA_PDF_CIKARIMI": len(left) - len(want), "YALNIZCA_GEMINI": len(right) - len(want)}


def test_applied_answers(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "cell int, value string")
    given = spark.createDataFrame([(1, 9, "Uzun  Metin"), (1, 8, "uzun metin"), (2, 9, "yok"), (3, 9, "uz"), (4, 7, "uzun")], "cell int, page int, answer string")
    pages = spark.createDataFrame([(9, "bir UZUN-\nMETİN var"), (8, "başka")], "page int, text string")
    found = {r.cell: (r.answer, r.unverified) for r in answers.applied_answers(table, given, pages).collect()}
    assert found == {1: ("Uzun  Metin", "uzun metin"), 2: (None, "yok"), 3: (None, "uz"), 4: (None, "uzun")}


def test_diff_items(spark):
    rows = [
        ("t1", None, None, "Theme", "x", "x", "AYNI"), ("t1", 1, None, "Outcome", "o", "p", "FARKLI"), ("t1", 1, 1, "Component", "", "", "BOŞ"), ("t1", 2, None, "Outcome", "only", "", "YALNIZCA_SİSTEM"), ("t1", 2, 1, "Component", "c", "", "YALNIZCA_SİSTEM"),
        ("t2", None, None, "Theme", "", "doc", "YALNIZCA_PDF"), ("t2", 1, None, "Outcome", "", "d", "YALNIZCA_PDF"),
    ]
    found = cells.diff_items(spark.createDataFrame(rows, "theme string, lo int, pos int, header string, sheet string, document string, status string")).collect()
    assert sorted(((r.theme, r.lo, r.header, r.status, r.sheet, r.document) for r in found), key=str) == sorted([("t1", 1, "Outcome", "FARKLI", "o", "p"), ("t1", 2, "*", "YALNIZCA_SİSTEM", "only", ""), ("t2", None, "*", "YALNIZCA_PDF", "", "doc")], key=str)


def test_declarations_against_a_slow_version(spark):
    """Entries by looking at every place and, for each, ahead over the whole text."""
    from docrecon.functions.folds import _declarations

    draw = random.Random(4)
    pieces = ["E1.1. Merak", "E1.2 Soru", "KB2.14,", "E.3. Üç", "E3.8.Soru", "(BT1. bir", "BT1.2. iki)", ")", "(", ", ", "; ", " ", "UZUNAD1. x", "x-K1", "cm3", "A", "1", ".", "_E1. y", "D9."]

    def head(text, i):
        n = i
        while n < len(text) and text[n].isalpha():
            n += 1
        if not 1 <= n - i <= 5:
            return None
        best = None
        for end in range(n + 1, len(text) + 1):
            body = text[n:end].removeprefix(".")
            if body and all(x.isdigit() and x for x in body.split(".")):
                best = end
        return best

    def slow(text):
        depth, now = [], 0
        for c in text:
            depth.append(now)
            now = now + 1 if c == "(" else max(0, now - 1) if c == ")" else now
        starts, loose = [], []
        for i, c in enumerate(text):
            before = text[i - 1] if i else ""
            if not c.isalpha() or (before and (before.isalnum() or before in "._")):
                continue
            end = head(text, i)
            if end is None:
                continue
            after, then = text[end : end + 1], text[end + 1 : end + 2]
            dot = after == "." and (then.isspace() or then.isalpha())
            if (dot or after.isspace() or after == ",") and (not before or before.isspace() or before in ",;("):
                starts.append((i, text[i : end + dot]))
            else:
                loose.append((i, text[i:end]))
        if not starts or starts[0][0] != 0:
            return [], []
        entries = []
        for k, (i, code) in enumerate(starts):
            end = next((j for j, _ in starts[k + 1 :] if depth[j] <= depth[i]), len(text))
            if depth[i]:
                end = next((j for j in range(i, end) if text[j] == ")" and depth[j] == depth[i]), end)
            parent = next((j for j in range(k - 1, -1, -1) if all(depth[starts[m][0]] >= depth[i] for m in range(j + 1, k)) and depth[starts[j][0]] < depth[i]), None)
            entries.append((i, end, code, parent))
        return entries, loose

    seen = 0
    for _ in range(3000):
        text = "".join(draw.choice(pieces) + draw.choice(["", " ", ", ", "; "]) for _ in range(draw.randint(0, 9)))
        found = _declarations(text)
        got = [(e["start"], e["end"], e["code"], e["parent"]) for e in found["entries"]], [(r["start"], r["text"]) for r in found["residue"]]
        assert got == slow(text), text
        seen += len(got[0]) > 2
    assert seen > 200


def test_declared_codes(spark):
    from docrecon.operators import declarations as D

    text = "BTYAB2. Düşünme (BTYAB2.1. Alt,\nBTYAB2.2. Üst), KB2.\n14. Yapı, KB2.15, E.1.1. Merak x-E9"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "önce E1. bir")], "unit int, text string")
    found = D.declared_codes(rows).orderBy("pos").collect()
    assert [(r.code, r.parent, r.usual) for r in found] == [("BTYAB2.", None, True), ("BTYAB2.1.", "BTYAB.2", True), ("BTYAB2.2.", "BTYAB.2", True), ("KB2.14.", None, True), ("KB2.15", None, False), ("E.1.1.", None, False)]
    assert text[found[0].start : found[0].end].startswith("BTYAB2. Düşünme (BTYAB2.1.") and text[found[3].start : found[3].end] == "KB2.\n14. Yapı, " and found[3].entry == "KB2.14. Yapı"
    bad = {(r.code, r.detail) for r in D.declaration_findings(rows, ["unit"]).collect()}
    assert bad == {("DECLARATION_NAME_MISSING", "KB2.15"), ("CODE_FORMAT_ANOMALY", "E.1.1."), ("DECLARATION_UNPARSED_CODE", "E9")}
