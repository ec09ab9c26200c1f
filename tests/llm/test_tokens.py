"""Token operators against the tokenizers library, and round trips."""

import io
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docrecon.llm import bpe_lexicon as B
from docrecon.llm import token_records as R
from docrecon.llm.storage import new_folder
from docrecon.llm.tokens import byte_encoder, pack

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    draw = random.Random(2)
    letters = "abcXYZ' 0129!?\t\n\r éÉßİıſ½²ªœ€™—“” ​　中文क्षñń'sn't'LL \x1c\x85ǅ\U0001f600"
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    return made + [None, "", "   ", "a<|endoftext|>b <|startoftext|>", "word " * 20_000, "q" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 7 % 1000, t, "clash", 1) for i, t in enumerate(texts())] + [(3, "twice", "x", 1)] * 2, "doc_id long, text string, n_tokens string, start int")


def test_bpe(docs):
    library = Tokenizer.from_file(WORDS)
    found = B.bpe_encode(docs, WORDS, max_words=50, with_ids=True).collect()
    by = {(r.doc_id, r.ids_sha256): r for r in found}
    assert len(found) == docs.count()
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = by[i * 7 % 1000, sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids == ids and r.decoded == decoded and r.decoded_sha256 == sha256(decoded.encode()).hexdigest()
    assert B.bpe_encode(docs.limit(0), WORDS).count() == 0


def test_frequent_words(spark):
    rows = [("a " * 9 + "b " * 8 + "c " * 8 + "d " * 4,), ("A b",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    assert B.frequent_words(df, WORDS, max_words=3) == ["a", "b", "c"] and B.frequent_words(df, WORDS, max_words=2) == ["a", "b"]
    assert B.frequent_words(df, WORDS, max_words=3, min_places=1) == ["a", "b", "c"] and B.frequent_words(df.limit(0), WORDS) == []


def test_driver_loads_no_vocabulary(docs, monkeypatch):
    """The lexicon's words are merged in tasks."""
    want = sorted(B.bpe_encode(docs, WORDS, max_words=50).collect())

    monkeypatch.setattr("tokenizers.Tokenizer", None)
    assert sorted(B.bpe_encode(docs, WORDS, max_words=50).collect()) == want
    monkeypatch.undo()
    merged = B.merged_words(docs.sparkSession.createDataFrame([("the",), ("zzqxy",), ("字",)], "word string"), WORDS)
    library = Tokenizer.from_file(WORDS)
    assert merged == {w: library.encode(w, add_special_tokens=False).ids for w in ("the", "zzqxy", "字")}


def test_lexicon(tmp_path):
    draw = random.Random(4)
    words = {"".join(draw.choice("abcdé") for _ in range(draw.randint(1, 7))): [draw.randint(0, 9) for _ in range(draw.randint(0, 4))] for _ in range(2000)}
    (tmp_path / "l").write_bytes(data := B.build_lexicon(words))
    found = B.Lexicon(str(tmp_path / "l"))
    assert all(found(w) == ids for w, ids in words.items()) and found("zz") is None and found("") is None and found("aaaaaaaaa") is None
    assert found.numbers([*words, "zz", ""]).tolist() == [*(sorted(words, key=str.encode).index(w) if w else -1 for w in words), -1, -1]
    # minimal: no two states accept the same endings
    states, edges = found.root + 1, {}
    for key, target in zip(found.keys.tolist(), found.targets.tolist(), strict=True):
        edges.setdefault(key >> 8, []).append((key & 255, target))
    endings = {}
    for s in range(states):
        endings[s] = hash((bool(found.finals[s]), tuple((b, endings[t]) for b, t in edges.get(s, ()))))
    assert len({*endings.values()}) == states
    assert len(data) < sum(len(w.encode()) for w in words) * 20
    (tmp_path / "e").write_bytes(B.build_lexicon({}))
    assert B.Lexicon(str(tmp_path / "e"))("a") is None


def test_records(docs, spark):
    library = Tokenizer.from_file(BYTES)
    folder = new_folder(spark, "records")
    found = R.token_records(docs, BYTES, end_id=0, folder=folder).collect()
    rows = sorted([(i * 7 % 1000, t) for i, t in enumerate(texts())] + [(3, "twice")] * 2, key=lambda x: (x[0], x[1] is not None, (x[1] or "").encode()))
    start, want = 0, []
    for doc_id, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == sorted(want)
    index = R.read_index(spark, folder)
    got = R.fetch_records(spark, folder, index.filter("doc_id % 3 = 0")).collect()
    crcs = {(r[0], r[3]) for r in want}
    assert len(got) == sum(r[0] % 3 == 0 for r in want) and all((r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) in crcs for r in got)
    assert R.token_records(docs.limit(0), BYTES).collect() == []


def test_frames_refuse_damage():
    made = R.frame(b"some payload") + R.frame(b"")
    assert [p for _, p in R.frames(io.BytesIO(made))] == [b"some payload", b""]
    for i in range(len(made)):
        with pytest.raises(ValueError):
            list(R.frames(io.BytesIO(made[:i] + bytes([made[i] ^ 1]) + made[i + 1 :])))
    for cut in (5, 14, 20, len(made) - 1):
        with pytest.raises(ValueError):
            list(R.frames(io.BytesIO(made[:cut])))
    wide = pack([1, 70_000])
    assert R.ids_of(R.payload_of(None, wide))[0] is None and R.ids_of(R.payload_of(-5, wide))[1].tolist() == [1, 70_000] and R.ids_of(R.payload_of(2, pack([])))[1].tolist() == []


def test_byte_encoder():
    library, encode = Tokenizer.from_file(BYTES), byte_encoder(BYTES, max_pieces=10)
    assert all(encode(t) == pack(library.encode(t or "", add_special_tokens=False).ids) for t in texts())


def test_automaton_answers():
    """Words of the lexicon come from the automaton in every block, those of other scripts among them; others are merged."""
    entries = {w: [i] for i, w in enumerate(["the", "слово", "字", "été"])}
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".bin") as f:
        f.write(B.build_lexicon(entries))
        f.flush()
        lexicon = B.Lexicon(f.name)
    asked, numbers = [], lexicon.numbers
    lexicon.numbers = lambda words: asked.append(words) or numbers(words)
    encode = B.encoder(WORDS, lexicon, block_chars=12)
    assert [ids for _, ids, _ in encode(["The слово", None, "字 the", "ÉTÉ 字"])] == ["0 1", "", "2 0", "3 2"]
    assert asked == [["the", "слово", "字"], ["été", "字"]]


def test_encoder_memory(spark, monkeypatch):
    """A worker holds one copy of the library's tokenizer, and no more than 1000 texts at a time."""
    import public_tokenizers
    import tokenizers

    from docrecon.llm import bpe_lexicon

    path, loaded = public_tokenizers.path("word_bpe_49k.json"), []

    class Counting:
        @staticmethod
        def from_file(name, load=tokenizers.Tokenizer.from_file):
            loaded.append(name)
            return load(name)

    with monkeypatch.context() as m:
        m.setattr(tokenizers, "Tokenizer", Counting)
        assert [n for n, _, _ in bpe_lexicon.encoder(path, None)(["some words", ""])][1] == 0
    assert loaded == [path]

    send = bpe_lexicon.map_batches

    def in_small_batches(df, run, schema):
        def checked(batches):
            def small(batch):
                if batch.num_rows > 1000:
                    raise ValueError(f"{batch.num_rows} texts at a time")
                return batch

            return run(map(small, batches))

        return send(df, checked, schema)

    monkeypatch.setattr(bpe_lexicon, "map_batches", in_small_batches)
    docs = spark.range(2500).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1)
    assert bpe_lexicon.bpe_encode(docs, path).count() == 2500
