"""Ids of a byte-level tokenizer for whole texts, as little-endian 16-bit bytes.

A word and the space before it are tokenized alone, which gives the same ids as the whole text as long as no space is
followed by more white space; other texts are tokenized whole. Words repeat, so a worker keeps a bounded table of them.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import tiktoken

#: The pattern that splits texts before merging, and the special token of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256

KEPT_WORDS = 400_000
KEPT_LENGTH = 48


class ByteTokenizer:
    """`ranks`: path of the rank file of the vocabulary; ids fit in 16 bits."""

    def __init__(self, ranks: str):
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
        self.words: dict[str, bytes | None] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, allowed_special="all"), "<u2").tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a space and the word; None if white space meets the space."""
        found = None if not word or word[0].isspace() else self._encode(" " + word)
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        known, parts = self.words, [self._encode(first)]
        for word in rest:
            part = known.get(word)
            if part is None:
                part = self._word(word)
                if part is None:
                    return self._encode(text)
            parts.append(part)
        return b"".join(parts)


@functools.cache
def byte_tokenizer(ranks: str) -> ByteTokenizer:
    """One per worker process."""
    return ByteTokenizer(ranks)
