import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from docstrata.llm import packing
from docstrata.llm.queries import QUERIES
from docstrata.llm.token_ids import ByteTokenizer
from tests.llm import edges


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, docs, tokenizer, window):
    """Every id of every document in one piece, sequences without gaps or overflow."""
    want = sorted((-1 if i is None else i, s, min(window, len(ids) - s), len(ids), zlib.crc32(np.array(ids[s : s + window], "<u4").tobytes())) for i, ids in ((i, ids_of(tokenizer, t)) for i, t in docs) for s in range(0, len(ids), window))
    assert sorted((-1 if p.doc_id is None else p.doc_id, p.start, p.length, p.doc_tokens, p.ids_crc32) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_ids_are_those_of_the_tokenizer(tokenizer_files):
    whole, own = Tokenizer.from_file(tokenizer_files("byte_bpe_50k.json")), ByteTokenizer(tokenizer_files("byte_bpe_50k.tiktoken"))
    random.seed(3)
    alphabet = ["a", "the", " ", " ", "\n", "\t", "'s", "1", "é", "日", "\U0001f600", ".", "!!", "<|endoftext|>", " ", "　"]
    for text in ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(2000)] + [t for _, t, _, _ in edges.EDGES if t]:
        assert np.frombuffer(own.ids(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tightest_window_is_taken():
    random.seed(4)
    lengths = np.array(sorted((random.randint(1, 60) for _ in range(500)), reverse=True))
    numbers, offsets = packing.best_fit_decreasing(lengths, 64)
    left = []
    for length, number, offset in zip(lengths.tolist(), numbers.tolist(), offsets.tolist(), strict=True):
        fitting = [x for x in left if x >= length]
        if fitting:
            assert number < len(left) and left[number] == min(fitting) and offset == 64 - left[number]
            left[number] -= length
        else:
            assert number == len(left) and offset == 0
            left.append(64 - length)


def test_odd_documents(spark, tokenizer_files):
    tokenizer, ranks = Tokenizer.from_file(tokenizer_files("byte_bpe_50k.json")), tokenizer_files("byte_bpe_50k.tiktoken")
    docs = edges.frame(spark)
    for window, group in ((64, 50_000), (1024, 3)):
        check(packing.pack_documents(docs, ranks, window, group).collect(), [(i, t) for i, t, _, _ in edges.EDGES], tokenizer, window)
    assert packing.pack_documents(docs.limit(0), ranks).count() == 0


def test_equal_rows_fill_all_groups(spark, tokenizer_files):
    docs = edges.frame(spark, [(1, "the same row", "en", "s")] * 5000)
    pieces = packing.pack_documents(docs, tokenizer_files("byte_bpe_50k.tiktoken"), 1024, 250).collect()
    groups = Counter(p.sequence_id >> 32 for p in pieces)
    assert len(groups) == 20 and max(groups.values()) < 400
    check(pieces, [(1, "the same row")] * 5000, Tokenizer.from_file(tokenizer_files("byte_bpe_50k.json")), 1024)


def test_query(spark, bundled, tokenizer_files):
    docs = spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()
    pieces = QUERIES["op10_packing"](spark, bundled).collect()
    sequences = check(pieces, docs, Tokenizer.from_file(tokenizer_files("byte_bpe_50k.json")), 1024)
    tokens = sum(p.length for p in pieces)
    assert sequences <= 1.02 * tokens / 1024 + 2
