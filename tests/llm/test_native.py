"""Operators in DataFrame functions alone, against plain Python and SQL."""

import hashlib
import random
import re

import pytest
from conftest import same_rows

from docrecon.llm import queries
from docrecon.llm.decontamination import decontaminate
from docrecon.llm.license_scan import TEMPLATES, license_scan
from docrecon.llm.quality_rules import LineRules, quality_rules

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, _id int, _hash int, w string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts():
    draw = random.Random(3)
    words = "the of a License MIT apache version 2 under cc by nc é straße İst x1 -- | © home page 日本".split(" ")
    made = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 90))) for _ in range(120)]
    made += [None, "", "   ", "\n\n", "a", "A\x00b\x1fc", "Under the MIT license", "under  THE mit\nlicense under the mit license", "cc by nc cc by nc", "Apache-License, version 2", "z " * 30_000, "one two three " * 40]
    made += ["Line one is here, and it ends.\nLine one is here, and it ends.\nHome | News | About | Contact\n" + "words that go on and on for a good while here. " * 12, "\U0001f600 " * 60]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2, "w") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, "under the mit license", "x", 1, 2, "w")], SCHEMA)


def by_id(df):
    found = {}
    for r in df.collect():
        assert found.setdefault(r[0], r) == r
    return found


def test_sql(spark, small, duck):
    for name in ("op3_license_scan", "op6_quality_rules", "op7_decontamination"):
        assert same_rows(queries.QUERIES[name](spark, small), duck, queries.ORACLE_SQL[name]) == 200


def test_quality_rules(docs):
    found = by_id(quality_rules(docs))
    for i, text in enumerate(texts()):
        words, r = BLANK.findall(text or ""), found[i]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w in set(windows)}
        repeat = len({p for k, w in enumerate(windows) if w in twice for p in (k, k + 1, k + 2)})
        lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeat)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words)) and not (r.kept and r.base_failed)
    assert quality_rules(docs).count() == docs.count()


def test_line_rules(spark):
    good = " ".join(f"Sentence {i} has a word{i} of its own and ends{i} as number{i} should." for i in range(12))
    menu = "\n".join(["Home | News | About | Contact"] * 3)
    rows = [(1, good + "\n" + menu), (2, "\n".join(f"BUY {'ABCDEFGHIJKLMNOPQRSTUVWXYZABCD'[i:]} AND SAVE A LOT OF MONEY!!" for i in range(30)) + "\nok"), (3, good), (4, " ".join(f"wo{i}### rd{i}*** le{i}$$$" for i in range(30)))]
    found = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), rules=LineRules()))
    assert found[1].kept and found[1].cleaned == good and found[3].kept and not found[4].kept and not found[2].kept


def test_license_scan(docs, spark):
    found = by_id(license_scan(docs))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, text in enumerate(texts()):
        words, r = PLAIN.findall(lower(text)), found[i]
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}
        assert 0 <= r.score <= 1
    assert found[None].labels == "mit"
    notice = "filler words here " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including the rights to use, copy, modify, publish, distribute, and/or sell copies of it" + " more words" * 50
    (row,) = license_scan(spark.createDataFrame([(1, notice)], "doc_id long, text string")).collect()
    assert row.labels == "mit" and row.base_labels == "" and 0.8 <= row.score < 1
    assert license_scan(docs.limit(0)).collect() == [] and license_scan(docs, templates=()).count() == docs.count()


def test_license_names(spark):
    """A notice of one licence never gets the label of another, whole or in a longer text, nor do notices without template."""
    others = {
        "Released under the Apache License.": "", "Released under the GPL License, version 3.": "", "Licensed under CC BY 4.0.": "", "Licensed under CC BY-SA 4.0.": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "cc-by-sa",
        "Permission hereby is granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software": "mit",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public Licence as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl",
    }
    wanted = [(text, label) for label, _, text in TEMPLATES] + list(others.items())
    filler = "some other words of a text " * 9
    rows = [(i, text) for i, (text, _) in enumerate(wanted)] + [(1000 + i, f"{filler}{text} {filler}") for i, (text, _) in enumerate(wanted)]
    found = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, label) in enumerate(wanted):
        assert found[i] == found[1000 + i] == label
    two = " ".join(text for label, _, text in TEMPLATES if label in ("cc-by", "cc-by-nc"))
    assert [r.labels for r in license_scan(spark.createDataFrame([(1, two)], "doc_id long, text string")).collect()] == ["cc-by,cc-by-nc"]


def test_license_blocks(spark):
    """Every block at the threshold is reported, also those whose label another block takes, in long texts full of notices."""
    notice = next(text for label, _, text in TEMPLATES if label == "cc-by-sa")
    rows = [(1, notice), (2, "x y z " * 30 + notice), (3, f"{notice} " * 700), (None, notice), (1, notice), (4, None)]
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in found) == [(0, "cc-by-sa"), (1, "cc-by-sa"), (1, "cc-by-sa"), (2, "cc-by-sa"), (3, "cc-by-sa"), (4, "")]
    for r in found:
        text = PLAIN.findall(lower(dict((i, t) for i, t in rows)[r.doc_id] or ""))
        want = []
        for i, (label, _, template) in enumerate(TEMPLATES):
            own = PLAIN.findall(lower(template))
            for k in range(0, max(len(text) - len(own), 1), len(own)):
                shared = len({*own} & {*text[k : k + 2 * len(own)]})
                if text and 10 * shared >= 8 * len({*own}):
                    want.append((k, i, f"{label}#{i}@{k}:{shared}/{len({*own})}"))
        assert r.blocks == ",".join(x for *_, x in sorted(want)) and (len(want) > 1) == (r.doc_id != 4)


def test_decontamination(docs, spark):
    draw = random.Random(5)
    source = [t for t in texts() if t and 12 < len(t.split()) < 100]
    items = [" ".join(t.split()[2 : 2 + draw.randint(1, 14)]) for t in source[:25]] + [None, "", "!!", "z", "z z z z z z z z z z z", items_repeat := "never seen words stand here in this item of the benchmark", items_repeat]
    bench = spark.createDataFrame([*((i, t, "q") for i, t in enumerate(items)), (0, items[0], "q")], "item_id long, text string, doc_id string")
    windows = {}
    for i, t in enumerate(items):
        w = PLAIN.findall(lower(t))
        windows[i] = {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    for limit in (1_000_000, 7):
        found = by_id(decontaminate(docs, bench, max_broadcast_windows=limit))
        for i, text in enumerate(texts()):
            words, hit, owners = PLAIN.findall(lower(text)), set(), set()
            places = {n: [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] for n in {len(w) for x in windows.values() for w in x}} if len(words) < 5000 else None
            if places is None:
                assert found[i].n_hit == len(words)
                continue
            for item, own in windows.items():
                for k, n in ((k, n) for n, at in places.items() for k, w in enumerate(at) if w in own):
                    hit |= {*range(k, k + n)}
                    owners.add(str(item))
            r = found[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(owners), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
    assert not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())
    assert decontaminate(docs.limit(0), bench).count() == 0
