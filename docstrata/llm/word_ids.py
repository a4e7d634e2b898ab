"""Ids of a lower-casing BPE tokenizer with word ends, as 16-bit numbers in the machine's byte order.

Its pattern drops white space and no token spans it, so the ids of a text are those of its words one after another. Words
repeat: a worker keeps a bounded table of them. Words of ASCII and Latin-1 letters, digits and marks are merged by
tiktoken from the file's own vocabulary (the word end stands as a byte that UTF-8 never uses); every other word, and those
that may hold a special token, go to the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

#: The pattern that splits words before merging, for the characters of `PLAIN`, and its mark of a word's end.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
WORD_END = "</w>"

PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
END_BYTE = b"\xff"
KEPT_WORDS = 400_000
KEPT_LENGTH = 48


def byte_letters() -> list[str]:
    """The printable letter by which a byte-level vocabulary writes each byte: itself where it prints, else 256 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PieceTable(dict):
    """lower-case piece -> id bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encode = tiktoken.Encoding("word_ends", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        found = array("H", self.encode(piece.encode() + END_BYTE)).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[piece] = found
        return found


class WordTokenizer(dict):
    """word -> id bytes. `file`: path of the tokenizers file; ids fit in 16 bits."""

    def __init__(self, file: str):
        super().__init__()
        self.whole = Tokenizer.from_file(file)
        letters = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        with open(file, encoding="utf-8") as source:
            parts = json.load(source)
        special = {t["content"] for t in parts["added_tokens"]}
        ranks = {}
        for token, number in parts["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(WORD_END)
                ranks[b"".join(letters[c] for c in token.removesuffix(WORD_END)) + END_BYTE * ends] = number
        self.pieces = PieceTable(ranks)

    def __missing__(self, word: str) -> bytes:
        if not word:
            found = b""
        elif PLAIN.fullmatch(word) and "<|" not in word:
            found = b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        else:
            found = array("H", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def word_tokenizer(file: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(file)
