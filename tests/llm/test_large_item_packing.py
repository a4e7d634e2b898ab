import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from docstrata.llm import large_item_packing
from docstrata.llm.queries import QUERIES
from docstrata.llm.word_ids import WordTokenizer
from tests.llm import edges


def check(pieces, docs, tokenizer, window):
    """Every id of every document in one piece, only long documents cut, sequences without gaps or overflow; their number."""
    want = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for number, start in enumerate(range(0, len(ids), window)):
            part = ids[start : start + window]
            want.append((doc_id, number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert edges.same([(p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces], want)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        assert sum(3 * length > window for _, length in parts) <= 2
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def plain_packing(lengths, window):
    """Sequences that matching and best fit need, piece by piece."""
    large, gaps = sorted(n for n in lengths if 3 * n > window), []
    while large:
        longest = large.pop()
        fitting = [n for n in large if n <= window - longest]
        if fitting:
            large.remove(max(fitting))
        gaps.append(window - longest - max(fitting, default=0))
    for n in sorted((n for n in lengths if 3 * n <= window), reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append(min(fitting, default=window) - n)
    return gaps


def test_plan_is_that_of_single_pieces():
    random.seed(11)
    for window in (1, 2, 7, 12, 30, 64, 100):
        for _ in range(60):
            lengths = [random.randint(1, window) for _ in range(random.randint(1, 120))]
            if random.random() < 0.3:
                lengths = [min(n, random.choice([1, 2, 5, window])) for n in lengths]
            counts = Counter(lengths)
            plan = large_item_packing.Plan(counts, window)
            used, left = defaultdict(list), dict(counts)
            rows = sorted(plan.rows)
            for k, (length, rank, sequence, offset, each) in enumerate(rows):
                last = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
                left[length] -= last - rank
                for i in range(last - rank):
                    used[sequence + i // each].append((offset + i % each * length, length))
            assert not any(left.values()) and sorted(used) == list(range(plan.used))
            gaps = []
            for parts in used.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                gaps.append(window - at)
            assert sorted(gaps) == sorted(plain_packing(lengths, window))


def test_plan_follows_lengths_not_rows():
    random.seed(12)
    counts = {n: random.randint(1, 10**9) for n in range(1, 2049)}
    plan = large_item_packing.Plan(counts, 2048)
    assert len(plan.rows) < 20_000
    assert plan.used <= 1.01 * max(sum(n * c for n, c in counts.items()) / 2048, sum(c for n, c in counts.items() if n > 1024))


def test_ids_are_those_of_the_tokenizer(tokenizer_files):
    file = tokenizer_files("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(file), WordTokenizer(file)
    random.seed(3)
    alphabet = ["a", "the", " ", " ", "\n", "\t", "'s", "'LL", "don't", "1", "é", "À", "ß", "ÿ", "×", "²", "日", "\U0001f600", ".", "!!", "<|endoftext|>", "<|", "|>"]
    alphabet += ["\x1c", "\x85", "\xa0", " ", "　", "́", "Σ", "ΑΣ", "İ", "ﬁ", "ǅ", "Ing", "er", "​", "_"]
    letters = "abcdefghijklmnopqrstuvwxyzéñßABC'"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(3000)] + [t for _, t, _, _ in edges.EDGES if t]
    for text in texts:
        assert np.frombuffer(own.ids(text), np.uint16).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_odd_documents(spark, tokenizer_files):
    file = tokenizer_files("word_bpe_49k.json")
    tokenizer, docs = Tokenizer.from_file(file), edges.frame(spark)
    for window in (3, 64, 2048):
        check(large_item_packing.pack_documents(docs, file, window).collect(), [(i, t) for i, t, _, _ in edges.EDGES], tokenizer, window)
    assert large_item_packing.pack_documents(docs.limit(0), file).count() == 0


def test_equal_rows_and_a_very_long_text(spark, tokenizer_files):
    file = tokenizer_files("word_bpe_49k.json")
    texts = [(1, "the same words again " * 30, "en", "s")] * 3000 + [(2, "word " * 1_200_000, "en", "s")]
    pieces = large_item_packing.pack_documents(edges.frame(spark, texts), file).collect()
    check(pieces, [(i, t) for i, t, _, _ in texts], Tokenizer.from_file(file), 2048)


def test_query(spark, bundled, tokenizer_files):
    docs = spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()
    pieces = QUERIES["op11_best_fit_packing"](spark, bundled).collect()
    sequences = check(pieces, docs, Tokenizer.from_file(tokenizer_files("word_bpe_49k.json")), 2048)
    assert sequences == len(plain_packing([p.length for p in pieces], 2048))
    assert sequences <= 1.01 * sum(p.length for p in pieces) / 2048 + 1
