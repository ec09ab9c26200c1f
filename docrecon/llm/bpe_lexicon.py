"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

Frequent words, counted over all documents, are compiled into an automaton whose equal endings are one state. An edge
carries a byte, a target and an output; the outputs along a word add up to its number, and the number leads to its ids.
The file is shipped to the executors and memory-mapped there, so the workers of a machine share its pages. The distinct
words of a block of texts walk the automaton together, a byte of all of them at a time. A word that the lexicon lacks is
merged exactly by the vocabulary's ranks. The lexicon's size is max_words, whatever the corpus.

Texts of any script are cut into words; where the cut depends on the Unicode version, the library's own normalizer and
cut are asked for the words, and only texts that hold a special token of the vocabulary are encoded by it as a whole.
"""

import mmap
import os
import re
import struct
import tempfile
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import Scratch, keep, map_batches
from docrecon.llm.tokens import WORD_PIECES, Pieces, byte_alphabet, cutter, special_tokens

HEADER = struct.Struct("<8sIIII")
MAGIC = b"DAWGBPE2"
#: States that an edge's key (state * 256 + byte, 32 bits) can name.
MAX_STATES = 1 << 24


class Merger:
    """Exact merges of one word by the vocabulary's own ranks: token ids, and the tokens as they are written."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, byte_alphabet()
        self.tokens = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}

    def __call__(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))]


def build_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The transducer file of words and their ids; words are added in byte order, so each finished ending is merged with
    an equal one at once and the automaton is minimal."""
    words = sorted((w.encode("utf-8"), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[list[int]]]] = []
    path: list[tuple[list[bool], list[list[int]]]] = [([False], [])]  # of the last word: final?, edges (byte, target)

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            (final,), edges = path.pop()
            key = (final, tuple(map(tuple, edges)))
            if key not in register:
                register[key] = len(states)
                states.append((final, edges))
            path[-1][1][-1][1] = register[key]

    last = b""
    for word, _ in words:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        for byte in word[common:]:
            path[-1][1].append([byte, -1])
            path.append(([False], []))
        path[-1][0][0] = True
        last = word
    settle(0)
    root = len(states)
    if root >= MAX_STATES:
        raise ValueError(f"a lexicon of {len(words)} words needs {root} states; {MAX_STATES} is the limit")
    states.append((path[0][0][0], path[0][1]))
    # How many words a state leads to; targets come before their sources, the root last.
    reach = [0] * len(states)
    edges_out = []
    finals = np.zeros(len(states), "<u1")
    for i, (final, edges) in enumerate(states):
        total = int(final)
        finals[i] = final
        for byte, target in edges:
            edges_out.append((i << 8 | byte, target, total))
            total += reach[target]
        reach[i] = total
    starts = np.cumsum([0, *(len(ids) for _, ids in words)]).astype("<u4")
    flat = np.array([i for _, ids in words for i in ids], "<u4")
    head = HEADER.pack(MAGIC, root, len(edges_out), len(words), max((len(w) for w, _ in words), default=0))
    keys, targets, outputs = np.array(edges_out, "<u4").reshape(-1, 3).T
    return head + keys.tobytes() + targets.tobytes() + outputs.tobytes() + starts.tobytes() + flat.tobytes() + finals.tobytes()


class Lexicon:
    """A memory-mapped transducer from words to their numbers, and the ids of a number."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, self.root, n_edges, self.n_words, self.longest = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        at = HEADER.size

        def view(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(self.data, kind, n, at)
            at += found.nbytes
            return found

        self.keys, self.targets, self.outputs = view("<u4", n_edges), view("<u4", n_edges), view("<u4", n_edges)
        self.starts = view("<u4", self.n_words + 1)
        self.ids = view("<u4", int(self.starts[-1]))
        self.finals = view("<u1", self.root + 1)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it."""
        raw = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        start, flat = np.cumsum(length) - length, np.frombuffer(b"".join(raw), np.uint8)
        state, number = np.full(len(raw), self.root, np.uint32), np.zeros(len(raw), np.int64)
        number[(length > self.longest) | (length == 0)] = -1
        walking = np.flatnonzero(number >= 0)
        for k in range(self.longest if len(self.keys) else 0):
            walking = walking[length[walking] > k]
            if not len(walking):
                break
            key = state[walking] << np.uint32(8) | flat[start[walking] + k]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[edge] == key
            number[walking[~goes]] = -1
            walking, edge = walking[goes], edge[goes]
            state[walking] = self.targets[edge]
            number[walking] += self.outputs[edge]
        number[self.finals[state] == 0] = -1
        return number

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()

    def __call__(self, word: str) -> list[int] | None:
        number = int(self.numbers([word])[0])
        return None if number < 0 else self.ids_of(number)


def word_cutter(tokenizer_path: str, library=None):
    """text -> words as the vocabulary normalizes and cuts it, or None if the text holds a special token. library: of the
    vocabulary, if it is loaded already."""
    from tokenizers import Tokenizer

    library, specials, cut = library or Tokenizer.from_file(tokenizer_path), special_tokens(tokenizer_path), cutter(WORD_PIECES, lower=True)
    bytes_of = {ord(c): chr(b) for b, c in byte_alphabet().items()}

    def words(text: str) -> list[str] | None:
        if any(s in text for s in specials):
            return None
        found = cut(text)
        if found is None:
            normal = library.normalizer.normalize_str(text)
            found = [w.translate(bytes_of).encode("latin-1").decode("utf-8") for w, _ in library.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    return words


def frequent_words(docs: DataFrame, tokenizer_path: str, text: str = "text", max_words: int = 50_000, min_places: int = 5) -> list[str]:
    """The words of frequent_word_rows, sorted."""
    return sorted(r["word"] for r in frequent_word_rows(docs, tokenizer_path, text, max_words, min_places).collect())


def frequent_word_rows(docs: DataFrame, tokenizer_path: str, text: str = "text", max_words: int = 50_000, min_places: int = 5) -> DataFrame:
    """The most frequent words of all documents (word), max_words at most, of those with min_places or more. Each task
    hands on its own counts of words; of the sums only how many words have which count reaches the driver."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        words = word_cutter(tokenizer_path)
        seen: Counter = Counter()

        def rows():
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for content in batch.column("_text").to_pylist():
                seen.update(words(content or "") or ())
                if len(seen) > 200_000:
                    yield rows()
        yield rows()

    counted = map_batches(docs.select(F.col(text).alias("_text")).filter("_text is not null"), run, "word string, n long")
    counts = keep(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_places), "words")
    # the smallest count above which no more than max_words words stand; ties at the edge stay out
    steps = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(max_words).collect()
    held, edge = 0, None
    for step in steps:
        held += step["words"]
        if held > max_words:
            break
        edge = step["n"]
    return counts.filter(F.lit(False) if edge is None else F.col("n") >= edge).select("word")


def merged_words(words: DataFrame, tokenizer_path: str) -> dict[str, list[int]]:
    """The ids of words(word), merged in tasks, so that the driver loads no vocabulary."""

    def run(batches):
        import pyarrow as pa

        merge = Merger(tokenizer_path)
        for batch in batches:
            ids = [merge(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    found = map_batches(words, run, "word string, ids array<int>").toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True))


def ship_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", max_words: int = 50_000) -> str:
    """Builds the lexicon of the documents' frequent words and hands it to all executors; returns its name there."""
    data = build_lexicon(merged_words(frequent_word_rows(docs, tokenizer_path, text, max_words), tokenizer_path))
    with tempfile.NamedTemporaryFile(prefix="lexicon-", suffix=".bin", delete=False, dir=os.path.realpath(tempfile.gettempdir())) as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(f.name)
    return os.path.basename(f.name)


def encoder(tokenizer_path: str, lexicon: Lexicon | None, max_pieces: int = 100_000, block_chars: int = 1 << 20):
    """texts -> per text (number of ids, ids joined by one space, decoded text), a block of texts at a time.

    Kept between blocks are the lexicon's words once met, and max_pieces of the words that it lacks.
    """
    merge = Merger(tokenizer_path)
    words = word_cutter(tokenizer_path, merge.library)
    names = {i: (f" {i}", f" {t}") for i, t in merge.tokens.items()}

    def written(ids: list[int]) -> tuple[int, str, str]:
        if len(ids) == 1:
            return 1, *names[ids[0]]
        numbers, tokens = zip(*[names[i] for i in ids], strict=True) if ids else ((), ())
        return len(ids), "".join(numbers), "".join(tokens)

    unseen = Pieces(lambda word: written(merge(word)), max_pieces)
    met: list[tuple[int, str, str] | None] = [None] * (lexicon.n_words if lexicon else 0)

    def look_up(distinct: list[str]) -> dict[str, tuple[int, str, str]]:
        found = {}
        numbers = lexicon.numbers(distinct).tolist() if lexicon else [-1] * len(distinct)
        for word, number in zip(distinct, numbers, strict=True):
            if number < 0:
                found[word] = unseen[word]
            else:
                if met[number] is None:
                    met[number] = written(lexicon.ids_of(number))
                found[word] = met[number]
        return found

    def rows(block: list[str]):
        cuts = [words(t) for t in block]
        get = look_up(list(dict.fromkeys(chain.from_iterable(c for c in cuts if c)))).__getitem__
        for text, cut in zip(block, cuts, strict=True):
            parts = [written(merge.library.encode(text, add_special_tokens=False).ids)] if cut is None else [*map(get, cut)]
            if parts:
                numbers, ids, tokens = zip(*parts, strict=True)
                yield sum(numbers), "".join(ids)[1:], "".join(tokens)[1:]
            else:
                yield 0, "", ""

    def encode(texts):
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= block_chars:
                yield from rows(block)
                block, size = [], 0
        yield from rows(block)

    return encode


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", max_words: int = 50_000, *, with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 and decoded_sha256; with_ids adds ids and decoded.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded text. Null texts are as empty
    ones and have no ids. Repeated rows give repeated results, an empty table none; other columns are not read. Texts reach
    the workers in small batches, for which the result is written here.
    """
    with Scratch(docs.sparkSession):
        name = ship_lexicon(docs, tokenizer_path, text, max_words)
        return keep(_encoded(docs, tokenizer_path, name, id_column, text, with_ids), "encoded")


def _encoded(docs: DataFrame, tokenizer_path: str, name: str, id_column: str, text: str, with_ids: bool) -> DataFrame:
    """The rows of bpe_encode, by the lexicon of that name."""

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        from pyspark import SparkFiles

        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {})
        encode = encoder(tokenizer_path, Lexicon(SparkFiles.get(name)))
        for batch in batches:
            rows = []
            for n, ids, decoded in encode(x.as_py() for x in batch.column("_text")):
                digests = n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()
                rows.append((*digests, [int(i) for i in ids.split()], decoded) if with_ids else digests)
            columns = [*zip(*rows, strict=True)] if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], [id_column, *kinds])

    chosen = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return map_batches(chosen, run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")

