"""Near-duplicates against exact sets of all pairs, and the pipeline's stages against plain versions."""

import random
import re
import uuid
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from docrecon.llm import near_duplicates as N
from docrecon.llm import queries
from docrecon.llm.components import connected_components


def exact(rows, words=5, percent=80):
    """Ids to (set size, smallest id within reach), from all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 4, 5, 6, 9, 40, 200]))]
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 45))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy) if draw.random() < 0.8 else "\t".join(copy).upper())
    rows += [None, "", " \n", None, "same text here"] + ["same text here"] * 30 + ["same text here", "w1 w2 " * 20_000]
    chain = [f"c{i}" for i in range(150)]  # each like the next, the ends unlike each other
    rows += [" ".join(chain[i : i + 100]) for i in range(0, 50, 5)]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [16, 1])
def test_against_all_pairs(spark, few):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_shingles string, _band int").repartition(3)
    found = N.near_duplicates(docs, N.Similarity(few=few)).collect()
    want = exact(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and len(found) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_defined_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        N.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_hot_groups(spark):
    """Two large groups of near copies with like bodies, many of them just too far from each other, and a group of copies:
    what meets is in proportion to the rows, and the components are those of all pairs."""
    draw = random.Random(12)
    body = [f"b{i}" for i in range(150)]
    second = body[:128] + [f"s{i}" for i in range(22)]
    rows = []
    for k in range(320):
        copy = list(body if k % 3 else second)
        for _ in range(draw.choice([0, 1, 2, 3, 5, 7])):
            copy[draw.randrange(150)] = f"e{draw.randrange(60)}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, "one and the same text of ten words or so") for k in range(300)]
    met, confirm = [], N._confirm

    def counting(pairs, *rest):
        met.append(pairs.count())
        return confirm(pairs, *rest)

    N._confirm = counting
    try:
        found = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Similarity(words=4)).collect()}
    finally:
        N._confirm = confirm
    assert found == {i: c for i, (_, c) in exact(rows, words=4).items()}
    assert sum(met) < 12 * len(rows)


def test_hot_group_without_its_base(spark):
    """A large group of near copies of a text that is not there itself, so that the centre lacks shingles that all others
    hold: most members are too far from each other, and what meets is in proportion to the rows all the same."""
    draw = random.Random(5)
    rows = []
    for k in range(400):
        copy = [f"b{i}" for i in range(150)]
        for at in draw.sample(range(150), draw.randint(2, 7)):
            copy[at] = f"e{k}x{at}"
        rows.append((k, " ".join(copy)))
    rows += [rows[7], (7, rows[9][1]), (None, rows[3][1])]
    met, confirm = [], N._confirm

    def counting(pairs, *rest):
        met.append(pairs.count())
        return confirm(pairs, *rest)

    N._confirm = counting
    try:
        found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Similarity(words=4)).collect()
    finally:
        N._confirm = confirm
    joined = exact([(i * 10, t) for i, t in rows[:400]] + [(71, rows[401][1])], words=4)
    parts = {i: c // 10 for i, (_, c) in joined.items()}
    low, high = sorted((parts[70], parts[71]))  # the two texts of id 7 are one document
    want = {i // 10: low if c == high else c for i, c in parts.items() if i % 10 == 0}
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want and len(found) == len(rows)
    assert len(set(want.values())) > 200
    assert met[-1] < 3 * len(rows)


def test_few_tables_where_nothing_is_left_to_meet(spark, tmp_path):
    """Without a large group apart or a further pair, none of their tables is written, so the driver plans no such jobs."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (3, "something else of five words or more"), (4, "ä")]
    docs, names = spark.createDataFrame(rows, "doc_id long, text string"), []

    def keep(df, name):
        names.append(name)
        df.write.parquet(path := f"file://{tmp_path}/{uuid.uuid4().hex}")
        return spark.read.schema(df.schema).parquet(path)

    for some, parts, tables in ((docs, {1: 1, 2: 1, 3: 3, 4: 4}, 16), (docs.filter("doc_id > 2"), {3: 3, 4: 4}, 10)):
        names.clear()
        found = N.similar_components(some, N.Similarity(), "doc_id", "text", keep).collect()
        assert {r._id: r._component for r in found} == parts
        assert "differences" not in names and len(names) <= tables, names


def test_recall_of_bands(spark):
    """Of the pairs of the given documents that are similar enough, all meet (a recall of 1): ids divisible by 20 against all
    rows of sf0.1, by counting shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs, N.Similarity(words=4)).collect()}
    sizes, holders = {}, {}
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {hash(tuple(w[k : k + 4])) for k in range(max(1, len(w) - 3))} if w else set()

    for i, t in texts:
        if i % 20 == 0:
            own = shingles(t)
            sizes[i] = len(own)
            for s in own:
                holders.setdefault(s, []).append(i)
    pairs = []
    for i, t in texts:
        own, shared = shingles(t), Counter()
        for s in own:
            shared.update(holders.get(s, ()))
        pairs += [(a, i) for a, n in shared.items() if a != i and 100 * n >= 80 * (sizes[a] + len(own) - n)]
    missed = [(a, b) for a, b in pairs if found[a] != found[b]]
    assert pairs and not missed


def test_register_agreement_is_the_similarity():
    """Also for short sets, whose buckets are filled in further turns."""
    draw = np.random.default_rng(5)
    for size in (5, 20, 100, 3000):
        share = []
        for _ in range(40):
            common, own, other = np.split(draw.integers(0, 1 << 63, 2 * size, np.uint64), [int(1.6 * size), int(1.8 * size)])
            a, b = (N.registers(N.bucket_minima(np.unique(np.concatenate([common, x])), 252)) for x in (own, other))
            share.append((np.mean(a == b) - N.COLLISION) / (1 - N.COLLISION))
        assert abs(np.mean(share) - 0.8) < 0.03
    assert len(set(N.bucket_minima(np.array([7], np.uint64), 252).tolist())) > 100


def test_sql(spark, small, duck):
    name = "op2_near_duplicates"
    assert same_rows(queries.QUERIES[name](spark, small), duck, queries.ORACLE_SQL[name]) == 200


def test_registers():
    values = np.array([0, 1, 2, 3, 5, 1 << 40, (1 << 53) + 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1], np.uint64)
    for v, r in zip(values.tolist(), N.registers(values).tolist(), strict=True):
        zeros = min(63, 64 - v.bit_length())
        rest = bin(v)[3:].ljust(N.MANTISSA_BITS, "0")[: N.MANTISSA_BITS] if v > 1 else "0" * N.MANTISSA_BITS
        assert r == zeros << N.MANTISSA_BITS | int(rest, 2)


def test_components(spark):
    links = [(i, i + 1) for i in range(200, 290)] + [(5, 3), (3, 9), (9, 9), (None, 4), (1000, 1001), (1001, 1000)]
    found = {r._node: r._component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(200, 291), 200), 3: 3, 5: 3, 9: 3, 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def clashing(spark, small):
    """The small documents, some of them twice, with odd rows and with columns that are named like the operators' own."""
    real = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "", None, None, 0), (900003, " \n 12 ", "de", "s", 0), (None, "a text of some words", "en", None, 0), (900004, "und so weiter " * 20_000, "de", "s", 0)], real.schema)
    docs = real.unionAll(odd).unionAll(real.filter("doc_id % 50 = 0")).unionAll(odd)
    return docs.withColumns({"score": F.lit(7.0), "kept": F.lit("no"), "lang_pred": F.lit("xx"), "row": F.col("doc_id"), "_words": F.lit(1), "_text": F.lit("t"), "runs": F.lit(2), "component_id": F.lit(3)}).persist()


def plain_stages(spark, small, docs):
    """What each stage keeps of docs, by plain means: stage -> the kept rows' (id, text)."""
    from collections import Counter

    from docrecon.llm.quality_classifier import classify_quality

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    bench = [r.text or "" for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[k : k + 10]) for w in map(words, bench) if w for k in range(max(1, len(w) - 9))}
    hit = {i for i, t in rows for w in [words(t)] if any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    want = exact([(i, t) for i, t in rows if i is not None])
    judged = classify_quality(docs.select("doc_id", "text", "source", "lang"), spark.read.parquet(f"{small}/labels.parquet"))
    good = Counter(r.doc_id for r in judged.filter("kept").collect())
    return {
        "quality": good,
        "near_dedup": Counter(i for i, _ in rows if i is None or want[i][1] == i),
        "decontamination": Counter(i for i, _ in rows if i is None or i not in hit),
    }


def test_pipeline(spark, small, clashing):
    from collections import Counter
    from hashlib import sha256

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    want = plain_stages(spark, small, clashing)
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, clashing, small)
        rows = kept.collect()
        assert kept.columns == clashing.columns and 0 < len(rows) < clashing.count()
        assert all((r.score, r.kept, r.lang_pred, r.row, r._words, r._text, r.runs, r.component_id) == (7.0, "no", "xx", r.doc_id, 1, "t", 2, 3) for r in rows)
        if name in want:
            assert Counter(r.doc_id for r in rows) == want[name]
        assert stage(spark, clashing.limit(0), small).count() == 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.STAGES[-1][1](spark, clashing, small).collect())
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in clashing.collect()]
    assert encoded == Counter((i, len(x), sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids)
    assert 0 < P.run(spark, small).count() < 200


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
]


def foreign_texts():
    draw = random.Random(3)
    texts = [" ".join(x.split()[k:] + x.split()[:k]) for x in FOREIGN for k in range(4)]
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"):
        texts += [" ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(60)) for _ in range(10)]
    return texts


def test_language_stage(spark):
    """Planted texts of other languages go, labelled or not, clean ones stay, and the rows are those of a plain version."""
    import corpus_pipeline as P
    from docrecon.llm import language_id as L

    clean = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").filter("doc_id < 5000").collect()]
    planted = [(10_000_000 + i, t, "en" if i % 14 == 0 else None) for i, t in enumerate(foreign_texts())]
    rows = clean + planted + [(20_000_000, None, "en"), (20_000_001, " 12 ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = sorted(r.doc_id for r in P.language(spark, docs, "").collect())

    vectors = L.Vectors(1024, 7)
    own = {i: vectors.bundle(*L.letter_runs(t)) for i, t, _ in rows}
    names = sorted({lang for _, _, lang in rows if lang})
    units = np.array([sum(own[i] for i, _, lang in rows if lang == n) for n in names])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scored, groups = {}, {}
    for i, t, lang in rows:
        if not own[i].any():
            continue
        cosines = units @ own[i] / np.linalg.norm(own[i])
        size = len(L.letter_runs(t)[0]).bit_length() - 1
        scored[i] = names[int(cosines.argmax())], size, max(0, cosines.max())
        if lang == scored[i][0]:
            for name in (lang, None):
                groups.setdefault((name, size), []).append(scored[i][2])
    low = {k: 0.5 * sorted(v)[-(-len(v) * 5 // 100) - 1] for k, v in groups.items() if len(v) >= 50}
    bound = lambda name, size: next((low[n, s] for s in range(size, -1, -1) for n in (name, None) if (n, s) in low), 0.0)
    assert kept == sorted(i for i, (name, size, score) in scored.items() if score >= bound(name, size))

    stay = set(kept)
    assert not stay & {i for i, _, _ in planted}
    assert sum(i not in stay for i, t, _ in clean) <= 0.002 * len(clean)


def test_language_stage_predicts_once(spark, small, monkeypatch):
    """Every row goes to language_of once, in batches of 1000 rows at most, and not again when the result is read."""
    from docrecon.llm import language_id as L

    docs, asked, real = spark.read.parquet(f"{small}/documents.parquet"), [], L.language_of
    monkeypatch.setattr(L, "language_of", lambda *a: asked.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or real(*a))
    kept = L.in_known_language(docs.unionAll(docs))
    assert [int(n) <= 1000 for n in asked] == [True]
    assert "EvalPython" not in kept._jdf.queryExecution().toString() and kept.count() > 0
