"""Literal cases of keys, codes and statuses, and scans of one text. The codes, labels and texts are fixed values."""

import pytest
from pyspark.sql import functions as F

from docrecon.functions import codes, folds, keys, status


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).head().r


@pytest.mark.parametrize(
    ("raw", "prefix", "segments", "types"),
    [
        ("MÜZ.5.1.6.", "MÜZ", ["5", "1", "6"], "nnn"), ("MÜZ. 5.1.6.", "MÜZ", ["5", "1", "6"], "nnn"), ("MÜZ 5.1.3.", "MÜZ", ["5", "1", "3"], "nnn"), ("EBRU.I.1.1.", "EBRU", ["I", "1", "1"], "ann"),
        ("SBÇ.II.4.1", "SBÇ", ["II", "4", "1"], "ann"), ("MAT.T.11.1.1.", "MAT", ["T", "11", "1", "1"], "annn"), ("MOY.1.1.", "MOY", ["1", "1"], "nn"), ("MAT1.1.", "MAT", ["1", "1"], "nn"),
        ("ARN.5.1.SÖS", "ARN", ["5", "1", "SÖS"], "nna"), ("ARN.5.3. SÖS", "ARN", ["5", "3", "SÖS"], "nna"), ("AB.05.00", "AB", ["5", "0"], "nn"), ("", None, None, None),
    ],
)
def test_codes(spark, raw, prefix, segments, types):
    got = one(spark, lambda c: F.struct(codes.code_prefix(c), codes.code_segments(c), F.array_join(codes.segment_types(codes.code_segments(c)), "")), raw)
    assert tuple(got) == (prefix, segments, types)


@pytest.mark.parametrize(("declared", "used", "covered"), [("D.11", "D.11.2", True), ("E.1.1", "E.1.1", True), ("D.11.2", "D.11", False), ("D.1", "D.11", False), ("E.1.1", "E.1.6", False), ("SB.1", "SAB.1", False)])
def test_cover(spark, declared, used, covered):
    def row(x):
        p, *s = x.split(".")
        return spark.createDataFrame([(1, p, s)], "unit int, prefix string, segments array<string>")

    assert (codes.uncovered(row(used), row(declared), ["unit"]).count() == 0) == covered
    assert (codes.uncovering(row(declared), row(used), ["unit"]).count() == 0) == covered


def test_used_codes(spark):
    text = "sorular sorulur (E1.1). Fikir birliğine varılır (D11.2, D14.3,\nD19.1). MÜZ.1.1.2 ile A4 kağıt kullanılır."
    assert one(spark, lambda c: codes.used_codes(c, ["D", "E"]), text) == ["E1.1", "D11.2", "D14.3", "D19.1"]
    assert one(spark, lambda c: codes.used_codes(c, []), "(XY3.1)") == ["XY3.1"]


def test_keys(spark):
    assert one(spark, keys.compare_key, "Müziksel Ha-\nreket Becerisi") == "Müziksel Hareket Becerisi"
    same = {one(spark, keys.norm_label, x) for x in ("Öğrenme-Öğretme Yaşantıları", "ÖĞRENME ÖĞRETME YAŞANTILARI", "öğrenme (öğretme) yaşantıları")}
    assert len(same) == 1 and one(spark, keys.norm_label, "Değerler") != one(spark, keys.norm_label, "Değerlendirme")
    assert one(spark, keys.tr_lower, "IĞDIR İZMİR") == "ığdır izmir" and one(spark, keys.tr_upper, "ığdır izmir") == "IĞDIR İZMİR"
    assert one(spark, keys.dehyphen, "(KB2.\n14, OB2)") == "(KB2.14, OB2)" and one(spark, keys.dehyphen, "BT-\nYAB3.\n 3 -\nx") == "BTYAB3.3 -\nx" and one(spark, keys.dehyphen, "sayfa 3.\n4 satır") == "sayfa 3.\n4 satır"
    assert one(spark, keys.page_numbers, "12-13, 15") == [12, 13, 15] and one(spark, keys.page_numbers, "12-x") is None
    assert one(spark, keys.without_name_suffix, "Dinleme Becerisi") == "Dinleme" and one(spark, keys.without_name_suffix, "Dinleme") is None
    assert one(spark, keys.label_word_key, "Öğrenme ve Öğretme") == "öğrenmeöğretme" and one(spark, keys.marker_of, " ç) bir") == "ç)"
    assert one(spark, keys.strip_placeholder, "a\nSayfa(lar)/e-içerik(ler):") .strip() == "a" and one(spark, keys.safe_cell, "a\x07b") == "a�b"
    assert one(spark, keys.font_rank, "Arial-BoldMT") == 2 and one(spark, keys.font_rank, "X Medium") == 1 and one(spark, keys.safe_name, "a/b:c ") == "a_b_c"


@pytest.mark.parametrize(
    ("document", "sheet", "want"),
    [
        ("a  b\nc", "a b c\nSayfa(lar)/e-içerik(ler):\n", "AYNI"), ("izleme-\nye hazırlık", "izlemeye hazırlık", "SADECE_BİÇİM_FARKI"), ("Beden Eğitimi ve Spor", "Beden Eğitimi Ve Spor", "SADECE_BİÇİM_FARKI"),
        ("OB5. Kültür\nOkuryazarlığı", "OB5. Kültür Okuryazarlıği", "METİN_FARKLI"), ("yansıtır", "yansıtır.", "METİN_FARKLI"), ("", "x", "METİN_FARKLI"),
    ],
)
def test_text_status(spark, document, sheet, want):
    assert one(spark, status.text_status, document, sheet) == want


def test_cell_and_merged_status(spark):
    cases = {("", ""): "BOŞ", ("", "x"): "YALNIZCA_SİSTEM", ("x", ""): "YALNIZCA_PDF", ("x", "x"): "AYNI", ("X", "x"): "BİÇİM", ("x", "y"): "FARKLI"}
    for (a, b), want in cases.items():
        assert one(spark, status.cell_status, a, b) == want
    for cells, want in {"BOŞ": "BOŞ", "AYNI,BOŞ": "AYNI", "AYNI,BİÇİM": "BİÇİM", "AYNI,FARKLI": "FARKLI", "YALNIZCA_PDF,YALNIZCA_PDF": "YALNIZCA_PDF"}.items():
        assert one(spark, lambda c: status.merged_status(F.split(c, ",")), cells) == want


def test_folds(spark):
    entries = one(spark, folds.declared_entries, "E1.1. Merak, E1.5. Kendine İnanma (Öz Yeterlilik, güven), E3.2. Odaklanma")
    assert [e.entry for e in entries] == ["E1.1. Merak", "E1.5. Kendine İnanma (Öz Yeterlilik, güven)", "E3.2. Odaklanma"] and not any(e.open for e in entries)
    assert [e.entry for e in one(spark, folds.declared_entries, "a), b")] == ["a)", "b"] and one(spark, folds.declared_entries, None) is None
    diff = one(spark, folds.word_diff(), "a b c d", "a x c")
    assert [(d.op, d.word) for d in diff] == [("same", "a"), ("del", "b"), ("ins", "x"), ("same", "c"), ("del", "d")]
    assert one(spark, folds.word_diff(limit=3), "a b", "c d") is None
    key = one(spark, folds.indexed_key, "İki-üç é")
    assert key.norm == "ikiüçé" and key.idx == [0, 1, 2, 4, 5, 7]
    key = one(spark, folds.indexed_key, "C\u0327a “x”–y!")
    assert key.norm == 'ça"x"y!' and key.idx == [0, 1, 3, 4, 5, 7, 8]


def test_composed_keys(spark):
    assert one(spark, keys.norm_label, "C\u0327a") == "ça" and one(spark, keys.compare_key, "C\u0327a-\n \n b") == "Çab" and one(spark, keys.composed, None) is None
    assert one(spark, keys.tr_upper, "i\u0307") == "İ\u0307" and one(spark, keys.label_tokens, "9. SINIF_I C\u0327a") == ["9", "sinifi", "ça"]
    assert one(spark, keys.layer_key, "“A-b” c!\u00a0İ") == '"ab"c!i'
    assert [one(spark, keys.ordinal_token, x) for x in ("12", "iv", "i5", "v.")] == [True, True, False, False]


@pytest.mark.parametrize("text", ["(KB2.\n14, OB2)", "BT-\nYAB3.3 x", "plain", "", "a-\n b-\n c", "E1.\n 2.\n3 (", "cm_E1.\n2"])
def test_dehyphen_places(spark, text):
    view, places = one(spark, keys.dehyphen, text), one(spark, keys.dehyphen_places, text)
    assert "".join(text[i] for i in places) == view and places == sorted(places)
    assert "E1.2.3" in view if text.startswith("E1") else "E1.\n2" in view if "_" in text else True


def test_malformed_codes(spark):
    assert one(spark, lambda c: codes.malformed_codes(c, ["KB", "SDB"]), "KB9,9 (KB2,4, SDB, OB1,2) (KB2.1)") == ["KB2,4", "SDB"]
    assert one(spark, lambda c: codes.used_codes(c, ["KB"]), "(KB2,4) KB2,4 KB3.1") == ["KB3.1"]
    assert one(spark, lambda c: codes.used_codes(c, []), "(E1.1) x E1.1 y (cm3, E2)") == ["E1.1", "E2"]
    assert one(spark, lambda c: codes.used_codes(c, ["D"], "D"), "(D1) (KB2.\n14)") == ["KB2.14"]


def test_sentence_note(spark):
    cases = {"Bu bir uzun cümle olur.": True, "Sayfa on iki üç 4.": False, "Kısa not.": False, "Bu bir uzun cümle olur": False}
    assert all(one(spark, keys.sentence_note, x) == want for x, want in cases.items())


def test_word_diff_is_a_longest_common_subsequence(spark):
    import random

    draw = random.Random(6)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
        marks = folds._words(" ".join(a), " ".join(b), 10_000)
        assert [w for o, w in marks if o != "ins"] == a and [w for o, w in marks if o != "del"] == b
        assert sum(o == "same" for o, _ in marks) == best[-1][-1]
        assert all((x, y) != ("ins", "del") for (x, _), (y, _) in zip(marks, marks[1:], strict=False))
