"""SentencePiece BPE encoding by a table of last tokens, and decoding.

Of a merge-type encoding every prefix has one last token: a piece that ends there, found by an automaton over all pieces,
is the one if it is compatible with the last token of the prefix before it, that is if merging the two alone leaves them as
they are. The ids are then read backwards from the whole text's last token. Adjacent pairs decide the whole sequence, since
a merge across a border would already happen with the two neighbours alone.

No piece goes on after white space, so a text is encoded in runs that each begin with white space; words repeat, and a
worker keeps a bounded table of them. The vocabulary file is read with the sentencepiece library; encoding and decoding are
not.

Defined cases: a null or empty text has no ids and decodes to the empty text. Characters without a piece become byte
pieces. Every row is encoded on its own,
whole, whatever its length; a run of letters without a space takes memory by its length. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import text_of

SPACE = "▁"
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 500_000, 1_000_000, 48


class PieceCodec:
    def __init__(self, model: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: library.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if library.is_byte(i)}
        self.bytes = {i: byte for byte, i in self.byte_ids.items()}
        self.silent = {i for i in range(len(self.pieces)) if library.is_control(i)}
        self.unknown = library.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after white space")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, str]] = {}

    def _merged(self, text: str) -> list[str]:
        """Merge the best pair, the leftmost of equals, as long as there is one."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self._merged(pair[0] + pair[1]) == [p for p in pair if p]
        return found

    def tokens(self, run: str) -> list[str]:
        """Pieces, and characters that have none, of a run of the escaped text."""
        last: list[str | None] = [""] + [None] * len(run)
        known, done = self.pairs, 0
        for end, piece in self.automaton.iter(run):
            while done < end:  # places that no piece has reached
                done += 1
                if last[done] is None:
                    last[done] = run[done - 1]
            if last[end + 1] is None:
                pair = (last[end + 1 - len(piece)], piece)
                fits = known.get(pair)
                if fits or (fits is None and self._compatible(pair)):
                    last[end + 1] = piece
        for place in range(done, len(run)):
            if last[place + 1] is None:
                last[place + 1] = run[place]
        out, place = [], len(run)
        while place:
            out.append(last[place])
            place -= len(last[place])
        return out[::-1]

    def _run_ids(self, run: str) -> list[int]:
        ids = []
        for token in self.tokens(run):
            if token in self.ids:
                ids.append(self.ids[token])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in token.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _run_text(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + pending.decode(errors="replace")

    def _run(self, run: str) -> tuple[str, str]:
        """Ids of a run, in decimal, and their text."""
        ids = self._run_ids(run)
        found = ",".join(map(str, ids)), self._run_text(ids)
        if len(run) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[run[1:]] = found
        return found

    def _runs(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        words, known = text.split(" "), self.words
        if SPACE not in text and "" not in words:
            return [known.get(w) or self._run(SPACE + w) for w in words]
        return [known.get(r[1:]) or self._run(r) for r in RUN.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self._runs(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return self._run_text(ids).removeprefix(" ")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids in decimal, sha256 of the text that they decode to."""
        runs = self._runs(text)
        ids = ",".join([ids for ids, _ in runs])
        decoded = "".join([t for _, t in runs]).removeprefix(" ")
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.cache
def piece_codec(model: str) -> PieceCodec:
    """One per worker process."""
    return PieceCodec(model)


def _digest_rows(model: str):
    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            rows = [codec.digests(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _id_rows(model: str):
    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([codec.encode(t.as_py()) for t in batch.column("t")], pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return run


def _text_rows(model: str):
    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids of every whole text."""
    return _texts(docs).mapInArrow(_id_rows(model), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of its ids; null ids as none."""
    return encoded.select("doc_id", "ids").mapInArrow(_text_rows(model), "doc_id long, text string")


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return _texts(docs).mapInArrow(_digest_rows(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
