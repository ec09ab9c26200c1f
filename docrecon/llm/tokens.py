"""Helpers inside tasks: texts to token ids, a word at a time, as the installed tokenizers library gives them.

Both tokenizers cut a text into short pieces before they merge, and the ids of a piece depend on that piece alone. So a
task keeps the ids of the pieces that it has met and joins them. Texts with a character outside SIMPLE are cut by the
library, as the cut could differ with the Unicode version there; those with a special token of the vocabulary are left to
it as a whole.
"""

import array
import json
import re
from functools import lru_cache

# How the two vocabularies cut a text, in terms that mean the same for the characters in SIMPLE, and under
# re.ASCII for those of ASCII.
BYTE_PIECES = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WORD_PIECES = r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+"
#: Characters whose class, case and normal form no Unicode version has changed; no digits or numbers but 0-9.
SIMPLE = "\t\n\r\x20-\x7e\xa0-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ſ‐-‧‰-›€™"


def byte_alphabet() -> dict[int, str]:
    """Bytes as the characters in which byte-level vocabularies write them: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Pieces(dict):
    """Ids of pieces, as bytes of unsigned 32-bit integers, least byte first. Emptied at max_pieces, so it stays bounded."""

    def __init__(self, encode, max_pieces: int):
        self.encode, self.max_pieces = encode, max_pieces

    def __missing__(self, piece: str):
        if len(self) >= self.max_pieces:
            self.clear()
        found = self[piece] = self.encode(piece)
        return found


if array.array("I", [1]).tobytes() != b"\x01\x00\x00\x00":
    raise ImportError("this platform's integers are not 32-bit little-endian")


def pack(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def special_tokens(tokenizer_path: str) -> list[str]:
    with open(tokenizer_path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def cutter(pieces: str, *, lower: bool = False):
    """text -> its pieces by the pattern, in lower case on demand, or None where it has a character outside both SIMPLE
    and ASCII."""
    ascii_cut, cut, odd = re.compile(pieces, re.ASCII).findall, re.compile(pieces).findall, re.compile(f"[^{SIMPLE}]").search

    def run(text: str) -> list[str] | None:
        plain = text.isascii()
        if not plain and odd(text):
            return None
        return (ascii_cut if plain else cut)(text.lower() if lower else text)

    return run


@lru_cache(1)
def byte_encoder(tokenizer_path: str, max_pieces: int = 800_000):
    """text -> packed ids under a byte-level vocabulary; None is as the empty text. A worker keeps the last one, so its
    later tasks know the pieces of its earlier ones."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    library.no_truncation()
    library.no_padding()
    specials = special_tokens(tokenizer_path)
    model, letters = library.model, byte_alphabet()

    def merged(piece: str) -> bytes:
        return pack([t.id for t in model.tokenize(piece.encode("utf-8").decode("latin-1").translate(letters))])

    cut, get = cutter(BYTE_PIECES), Pieces(merged, max_pieces).__getitem__

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        pieces = None if any(s in text for s in specials) else cut(text)
        if pieces is None:
            return pack(library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(get, pieces))

    return encode
