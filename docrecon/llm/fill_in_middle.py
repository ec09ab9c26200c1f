"""Fill-in-the-middle by rotating blocks in place.

A text is cut into prefix, middle and suffix between tokens; sentinels are inserted before each of them in one bytearray, and
the blocks change places by three reversals (of the first, of the second, of both), so nothing but the text itself and one
small block is held. Restoring finds the sentinels, turns the same rotation back and takes the sentinels out: no cut is
stored beside the output.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.storage import map_batches

#: Bytes that a reversal or a scan holds beside the text.
BLOCK = 1 << 16
#: Bytes of texts that one batch of results holds before it goes out, and one text at least.
BATCH_BYTES = 1 << 23


@dataclass(frozen=True)
class FillInMiddle:
    """seed: stands before the id in what decides cuts and forms. plain_percent: texts that stay as they are. spm_percent:
    of the others, those with the suffix first. Sentinels end with a character that is nowhere else in them."""

    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"


def _starts(view: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether a token starts at each byte of a to b: at each character but letters A-Z and a-z that follow one."""
    own = view[max(0, a - 1) : b]
    letter = ((own | 32) - np.uint8(97)) < 26
    after = np.concatenate([[False], letter[:-1]]) if a == 0 else letter[:-1]
    own, letter = (own, letter) if a == 0 else (own[1:], letter[1:])
    return ((own & 0xC0) != 0x80) & ~(letter & after)


def scan(view: np.ndarray) -> list[int]:
    """Tokens that start before each block of BLOCK bytes, and their number."""
    before = [0]
    for a in range(0, len(view), BLOCK):
        before.append(before[-1] + int(np.count_nonzero(_starts(view, a, min(a + BLOCK, len(view))))))
    return before


def place(view: np.ndarray, before: list[int], k: int) -> int:
    """The byte that token k starts at; the text's end for the number of tokens."""
    if k >= before[-1]:
        return len(view)
    block = int(np.searchsorted(before, k, side="right")) - 1
    return block * BLOCK + int(np.flatnonzero(_starts(view, block * BLOCK, min(block * BLOCK + BLOCK, len(view))))[k - before[block]])


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverses bytes a to b, block by block from both ends."""
    while b - a > 1:
        step = min(BLOCK, (b - a) // 2)
        left = view[a : a + step].copy()
        view[a : a + step] = view[b - step : b][::-1]
        view[b - step : b] = left[::-1]
        a, b = a + step, b - step


def rotate(view: np.ndarray, a: int, m: int, b: int) -> None:
    """Exchanges the blocks a to m and m to b."""
    reverse(view, a, m)
    reverse(view, m, b)
    reverse(view, a, b)


def transform(text: bytes, h: list[int], how: FillInMiddle) -> tuple[int, str, int | None, int | None, bytearray]:
    """Number of tokens, form, characters of prefix and middle (None if plain), output; h are four draws."""
    buffer = bytearray(text)
    view = np.frombuffer(buffer, np.uint8)
    before = scan(view)
    n = before[-1]
    if not text or any(mark in text for mark in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= 100 - how.plain_percent:
        return n, "plain", None, None, buffer
    i, j = sorted(place(view, before, k % (n + 1)) for k in h[:2])
    chars = [int(np.count_nonzero((view[a:b] & 0xC0) != 0x80)) for a, b in ((0, i), (i, j))]
    del view  # else the buffer could not grow
    for at, mark in ((j, how.suffix), (i, how.middle), (0, how.prefix)):
        buffer[at:at] = mark
    view = np.frombuffer(buffer, np.uint8)
    m = len(how.prefix) + i
    s = m + len(how.middle) + j - i
    spm = h[3] % 100 < how.spm_percent
    rotate(view, 0 if spm else m, s, len(buffer))
    return n, "spm" if spm else "psm", *chars, buffer


def invert(output: bytes, form: str, how: FillInMiddle) -> bytearray:
    """The text that transform was given."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    p, s, m = (buffer.find(mark) for mark in (how.prefix, how.suffix, how.middle))
    view = np.frombuffer(buffer, np.uint8)
    if form == "spm":  # suffix, then prefix and middle
        rotate(view, 0, p, len(buffer))
        m, s = m - p, len(buffer) - p
    else:  # prefix, then suffix and middle
        rotate(view, s, m, len(buffer))
        m, s = s, s + len(buffer) - m
    del view
    for at, mark in ((s, how.suffix), (m, how.middle), (0, how.prefix)):
        del buffer[at : at + len(mark)]
    return buffer


def _in_parts(batch, column: str):
    """Slices of a batch of BATCH_BYTES of a column's texts, or one row, each."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + size > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _bytes(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def fill_in_middle(docs: DataFrame, how: FillInMiddle = FillInMiddle(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n (tokens), form, prefix_chars, middle_chars, output.

    Null and empty texts, and those that hold a sentinel, are plain: the output is the text (null: empty). Cuts and forms
    depend on the id and the seed alone, so repeated rows give repeated results; a null id draws as an empty one. An empty
    table gives no rows; other columns are not read. A text of any length is one output.
    """

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        for whole in batches:
            for batch in _in_parts(whole, "_text"):
                rows = []
                for name, content in zip(batch.column("_name").to_pylist(), _bytes(batch.column("_text")), strict=True):
                    drawn = sha256(f"{how.seed}:{name}".encode()).hexdigest()
                    n, form, p, m, out = transform(content, [int(drawn[k : k + 8], 16) for k in range(0, 32, 8)], how)
                    rows.append((n, form, p, m, bytes(out)))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *made[:4], made[4].cast(pa.string())], [id_column, "n", "form", "prefix_chars", "middle_chars", "output"])

    chosen = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_name"), F.col(text).alias("_text"))
    return map_batches(chosen, run, f"`{id_column}` {chosen.schema['_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, how: FillInMiddle = FillInMiddle(), output: str = "output", form: str = "form") -> DataFrame:
    """rows with restored, the text that each output was made of, from output and form alone."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in _in_parts(whole, output):
                made = [bytes(invert(x, f, how)) for x, f in zip(_bytes(batch.column(output)), batch.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    return map_batches(rows, run, rows.select("*", F.lit("").alias("restored")).schema)
