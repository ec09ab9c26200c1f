"""SimHash against all pairs, fill-in-the-middle and conversation repair against plain versions, SQL and round trips."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import same_rows

from docrecon.llm import conversation_repair as C
from docrecon.llm import fill_in_middle as M
from docrecon.llm import queries
from docrecon.llm import simhash as S


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Ids to the smallest id within reach, from all pairs of rows (id, fingerprint)."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in combinations(prints, 2):
        if bin(x ^ y).count("1") <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_fingerprints():
    draw = random.Random(3)
    texts = [None, "", " \t", "A", "a b", "A b\x0bC", "é É ß \x85x", "a b c d", "x y z x y z x y z"] + [" ".join(draw.choice("abcdefg") * draw.randint(1, 9) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    assert [S.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    long = "one two three four five " * (S.BLOCK // 4)
    assert S.fingerprint(long) == plain_fingerprint(long)


@pytest.mark.parametrize("few", [1, 3, 16])
def test_links_against_all_pairs(spark, few):
    """Groups of near fingerprints around shared centres, in the upper half, the lower half and both, some of them large."""
    draw = random.Random(few)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        base = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 3, 30])):
            own = base
            for _ in range(draw.randint(0, 4)):
                own ^= 1 << draw.choice([draw.randrange(64), draw.randrange(32), 32 + draw.randrange(32)])
            prints.add(own)
    rows = list(enumerate(draw.sample(sorted(prints), len(prints))))
    heads = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for _, x in rows], "_print long")
    found = S.links(heads, S.SimHash(few=few), lambda df, name: df).collect()
    number = {int(np.uint64(x).astype(np.int64)): (i, x) for i, x in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        (i, x), (j, y) = number[r.a], number[r.b]
        assert 0 < bin(x ^ y).count("1") <= 2
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i, _ in rows} == components(rows)


def test_large_groups_make_no_pairs(spark):
    """2,000 fingerprints that differ from one body in two of forty bits: the links are in proportion to the rows."""
    rows = sorted({(1 << 63) ^ (1 << a) ^ (1 << b) for a, b in combinations(range(12, 60), 2)})
    heads = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in rows], "_print long")
    assert S.links(heads, S.SimHash(), lambda df, name: df).count() < 70 * len(rows)


def test_simhash_rows(spark):
    rows = [(7, "a b c d e"), (3, "A b c  d e"), (3, "other words here now"), (9, None), (8, " "), (None, "a b c d e"), (4, "other words here now"), (4, "other words here now")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _print int")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()), key=str)
    want = {7: 3, 3: 3, 9: 8, 8: 8, None: None, 4: 3}
    assert found == sorted(((i, f"{plain_fingerprint(t):016x}", want[i]) for i, t in rows), key=str)
    assert S.simhash_components(docs.filter("false")).collect() == []
    with pytest.raises(ValueError):
        S.simhash_components(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_simhash_query(spark):
    """All documents of sf0.01 against all pairs."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = components(rows)
    found = queries.op11_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{x:016x}", want[i]) for i, x in rows} and len(found) == len(rows)
    assert len(set(want.values())) < len(rows)


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, g = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[k : k + 8], 16) for k in range(0, 32, 8)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcXYZ  <>PSM<\n\r\t.é中\U0001f600\x00İ") for _ in range(draw.randint(0, 80))) for _ in range(400)]
    texts += [None, "", "a", "<", "<P", "x<M>y", "é", "long words and more, " * 20_000, "q" * 200_000, "ü" * 200_000]
    rows = [*enumerate(texts), (None, "no id at all"), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, output string, n int")
    found = M.restore(M.fill_in_middle(docs)).collect()
    want = sorted(((i, *plain_middle(i, t), t or "") for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found), key=str) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert M.restore(M.fill_in_middle(docs.filter("false"))).collect() == []
    # blocks of a few bytes: tokens and reversals that cross them
    monkeypatch.setattr(M, "BLOCK", 5)
    for i, t in enumerate(texts[:400]):
        g = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        n, form, p, m, out = M.transform((t or "").encode(), [int(g[k : k + 8], 16) for k in range(0, 32, 8)], M.FillInMiddle())
        assert (n, form, p, m, out.decode()) == plain_middle(i, t) and M.invert(bytes(out), form, M.FillInMiddle()).decode() == (t or "")


def plain_damage(rows):
    """(conv, turn, role, text) to the rows after damage, by conversation in order."""
    held = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        own = held.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in held.items()}


def plain_repair(rows):
    """All audits over short conversations, one by one, for the least (cost, audit)."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # by rows done and roles so far; insertions only where they follow no other pair of insertions
    best, edge = None, [(0, "", ())]
    paths = {0: edge}
    for k, ((_, role, text), fault) in enumerate(zip(rows, faults, strict=True)):
        edge = [(c + 3 * len(x), a + "I" * len(x), o + tuple((y, "") for y in x)) for c, a, o in paths[k] for x in [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]]
        more, new = 3 * (fault == "truncated"), []
        for c, a, o in edge:
            new.append((c + 4, a + "D", o))
            if fault not in ("blank", "duplicate"):
                new += [(c + more, a + "K", (*o, (role, text))), *((c + 3 + more, a + "R", (*o, (r, text))) for r in ("user", "assistant"))]
        paths[k + 1] = [x for x in new if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] for r, _ in x[2])) and all(r[:1] for r, _ in x[2])]
    ends = [(c + 3 * len(x), a + "I" * len(x), o + tuple((y, "") for y in x)) for c, a, o in paths[len(rows)] for x in [(), ("user",), ("assistant",), ("user", "assistant")]]
    best = min((c, a, "\n".join(f"{r}:{t}" for r, t in o)) for c, a, o in ends if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in o)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


FIELDS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def test_repair_against_all_audits(spark):
    draw, rows = random.Random(6), []
    for conv in [*range(400), None]:
        for turn in range(draw.randint(0, 4)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, draw.choice(["Yes.", "No!", "open", " ", "", None, "Yes.\n", f"Own {turn}?"])))
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    found = C.repair_conversations(C.damaged(table), here="_here").collect()
    want = {k: plain_repair(v) for k, v in plain_damage(rows).items()}
    assert {r._conv: tuple(r[c] for c in FIELDS) for r in found} == want and len(found) == len(want)
    assert any(not v for v in plain_damage(rows).values())
    assert C.repair_conversations(C.damaged(table.filter("false")), here="_here").collect() == []


def test_long_conversations():
    """Settled blocks give what one number of full width gives."""
    draw = random.Random(7)
    for n in (63, 64, 65, 700):
        rows = [(draw.choice(["user", "assistant", "assistant", "system", "tool"]), f"t{i}", draw.choice([C.NONE, C.NONE, C.CUT, C.BLANK, C.DUPLICATE])) for i in range(n)]
        found, block = [], C.BLOCK_ROWS
        for C.BLOCK_ROWS in (block, 3, 1000):
            one = C.Repair()
            for r in rows:
                one.add(*r)
            found.append(one.best())
        C.BLOCK_ROWS = block
        assert found[0] == found[1] == found[2]


def test_repair_of_any_ids(spark):
    rows = [("b", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("b", 2, "assistant", "So."), ("a", 2, "user", "Hi."), ("a", 2, "user", "Hi.")]
    found = {r._conv: (r.duplicate, r.cost, r.audit) for r in C.repair_conversations(spark.createDataFrame(rows, "_conv string, _turn int, _role string, _text string")).collect()}
    assert found == {"a": (2, 11, "KDDI"), "b": (0, 0, "KK")}


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_conversation_repair"])
def test_same_rows_as_sql(spark, small, duck, name):
    assert same_rows(queries.QUERIES[name](spark, small), duck, queries.ORACLE_SQL[name]) > 0
