"""Scans of one text that no built-in function expresses, as Arrow-batched UDFs. All are small and per row."""

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from docrecon.functions import keys
from docrecon.functions.keys import HYPHENS, QUOTES_FROM, QUOTES_TO

QUOTES = dict(zip(QUOTES_FROM, QUOTES_TO, strict=True))
DOTTED = str.maketrans(keys.DOTTED, keys.DOTLESS)
ENTRIES = ArrayType(StructType([StructField("pos", IntegerType()), StructField("open", IntegerType()), StructField("entry", StringType())]))
MARKS = ArrayType(StructType([StructField("op", StringType()), StructField("word", StringType())]))
KEY = StructType([StructField("norm", StringType()), StructField("idx", ArrayType(IntegerType()))])


def _entries(text: str) -> list[tuple[int, int, str]]:
    found, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == "," and (depth == 0 or i == len(text)):
            if entry := text[start:i].strip():
                found.append((len(found), min(depth, 1), entry))
            start = i + 1
    return found


@F.pandas_udf(ENTRIES)
def declared_entries(text: pd.Series) -> pd.Series:
    """Comma-separated entries outside parentheses; the depth never falls below 0. open: a parenthesis was left open."""
    return text.map(lambda x: [{"pos": p, "open": o, "entry": e} for p, o, e in _entries(x)], na_action="ignore")


def _code_at(text: str, at: int) -> tuple[int, bool, bool]:
    """Of a word that begins at a place: how long the code-like part at its start is (0 without one), whether it stands as a
    declaration's code does, and whether that is the usual way to write one.

    A code is one to five letters, a full stop perhaps, and numbers between full stops. It declares where a full stop and then a
    blank or a letter, a blank, or a comma follow; written as usual, letters and numbers touch and a full stop and a blank end it.
    """
    n = at
    while n < len(text) and text[n].isalpha():
        n += 1
    if not 1 <= n - at <= 5:
        return 0, False, False
    touching = n < len(text) and text[n] != "."
    n += not touching
    end = 0
    while n < len(text) and text[n].isdigit():
        while n < len(text) and text[n].isdigit():
            n += 1
        end = n
        n += n < len(text) and text[n] == "."
    if not end:
        return 0, False, False
    after, then = text[end : end + 1], text[end + 1 : end + 2]
    if after == "." and (then.isspace() or then.isalpha()):
        return end + 1 - at, True, touching and then.isspace()
    return end - at, after.isspace() or after == ",", False


def _declarations(text: str) -> dict:
    """Entries and residue of a text of declared codes, in one pass; entries whose end is not known yet wait on a stack."""
    entries, waiting, parents, residue, depth = [], [], [], [], 0
    if not _code_at(text, 0)[1]:
        return {"entries": [], "residue": []}
    skip = 0
    for i, c in enumerate(text):
        before = text[i - 1] if i else " "
        if i >= skip and c.isalpha() and not (before.isalnum() or before in "._"):
            size, declares, usual = _code_at(text, i)
            if declares and (i == 0 or before.isspace() or before in ",;("):
                while waiting and waiting[-1]["depth"] >= depth:
                    waiting.pop()["end"] = i
                while parents and parents[-1]["depth"] >= depth:
                    parents.pop()
                entry = {"pos": len(entries), "start": i, "end": len(text), "depth": depth, "code": text[i : i + size], "parent": parents[-1]["pos"] if parents else None, "usual": usual}
                entries.append(entry)
                waiting.append(entry)
                parents.append(entry)
            elif size:
                residue.append({"start": i, "text": text[i : i + size].rstrip(".")})
            skip = i + size
        if c == "(":
            depth += 1
        elif c == ")":
            while waiting and depth > 0 and waiting[-1]["depth"] >= depth:
                waiting.pop()["end"] = i
            depth = max(0, depth - 1)
    for e in entries:
        e["entry"] = text[e["start"] : e["end"]].rstrip().rstrip(",;").rstrip()
    return {"entries": entries, "residue": residue}


DECLARED = StructType(
    [
        StructField("entries", ArrayType(StructType([StructField(n, t) for n, t in (("pos", IntegerType()), ("start", IntegerType()), ("end", IntegerType()), ("depth", IntegerType()), ("code", StringType()), ("parent", IntegerType()), ("usual", BooleanType()), ("entry", StringType()))]))),
        StructField("residue", ArrayType(StructType([StructField("start", IntegerType()), StructField("text", StringType())]))),
    ]
)


@F.pandas_udf(DECLARED)
def declarations(text: pd.Series) -> pd.DataFrame:
    """Declared codes of a text (as keys.dehyphen gives it) with their place, depth of parentheses, parent (the nearest entry
    before it at a smaller depth) and text, which ends where the next entry of no greater depth begins or its parentheses close;
    and residue, what looks like a code but begins no entry. A text that does not begin with an entry has none."""
    found = [_declarations(x or "") for x in text]
    return pd.DataFrame(found, columns=["entries", "residue"])


def _common_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How long the longest common subsequence of x and each leading part of y is; one row of the table at a time.

    With the row above known, an entry is the largest, so far in the row, of the entry above it and of one more than the
    entry above and before it where both items agree.
    """
    row = np.zeros(len(y) + 1, np.int32)
    for item in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == item, row[:-1] + 1, 0)))
    return row


def _keep(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: x is halved, y cut where both halves have most in common."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        at = np.flatnonzero(y == x[0])
        return [(0, int(at[0]))] if len(at) else []
    half = len(x) // 2
    cut = int(np.argmax(_common_lengths(x[:half], y) + _common_lengths(x[half:][::-1], y[::-1])[::-1]))
    return _keep(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _keep(x[half:], y[cut:])]


def _words(a: str, b: str, limit: int) -> list[tuple[str, str]] | None:
    x, y = a.split(), b.split()
    if len(x) * len(y) > limit:
        return None
    number = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    p, q = (np.array([number[w] for w in s], np.int64) for s in (x, y))
    short = min(len(p), len(q))
    head = short if (p[:short] == q[:short]).all() else int(np.argmin(p[:short] == q[:short]))
    p, q = p[head:], q[head:]
    short = min(len(p), len(q))
    same = p[len(p) - short :][::-1] == q[len(q) - short :][::-1]
    tail = short if same.all() else int(np.argmin(same))
    held = [*((i, i) for i in range(head)), *((i + head, j + head) for i, j in _keep(p[: len(p) - tail], q[: len(q) - tail])), *((len(x) - k, len(y) - k) for k in range(tail, 0, -1))]
    out, i, j = [], 0, 0
    for s, t in [*held, (len(x), len(y))]:
        out += [("del", w) for w in x[i:s]] + [("ins", w) for w in y[j:t]] + [("same", w) for w in x[s : s + 1]]
        i, j = s + 1, t + 1
    return out


def word_diff(limit: int = 1_500_000):
    """Words of two texts as same, del or ins along a longest common subsequence, between two same ones the deletions
    first; null where the product of their word counts is over the limit or a side is null. Memory grows with the longer
    side alone."""

    @F.pandas_udf(MARKS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or (d := _words(x, y, limit)) is None else [{"op": o, "word": w} for o, w in d] for x, y in zip(a, b, strict=True)], dtype=object)

    return run


@F.pandas_udf(KEY)
def indexed_key(text: pd.Series) -> pd.DataFrame:
    """The text as layer_key of keys.py gives it, and for each of its characters the place in the composed text."""
    rows = []
    for x in text:
        composed = unicodedata.normalize("NFC", x or "")
        found = [(c, i) for i, own in enumerate(composed) if not own.isspace() and own not in HYPHENS for c in QUOTES.get(own, own.translate(DOTTED).lower().replace("ı", "i"))]
        rows.append({"norm": "".join(c for c, _ in found), "idx": [i for _, i in found]})
    return pd.DataFrame(rows, columns=["norm", "idx"])
