import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docstrata.llm import training_order
from docstrata.llm.queries import QUERIES
from tests.llm import edges


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    slots = training_order.feistel(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 64 or slots.tolist() != training_order.feistel(np.arange(n), n, 6).tolist()


def round_trip(spark, docs, folder, tokenizer_files, length, shard):
    """The stream of ids, read back from the shards through the permutation."""
    written = training_order.write_training_order(docs, tokenizer_files("byte_bpe_50k.tiktoken"), folder, 17, length, shard).collect()
    n = len(written)
    sequences = list(training_order.read_sequences(folder, 0, n, length, shard))
    assert len(sequences) == n
    for row in written:
        assert row.ids_crc32 == zlib.crc32(sequences[row.slot].tobytes())
        assert (row.shard, row.byte_offset) == (row.slot // shard, row.slot % shard * length * 2)
    # a reader that starts again in the middle goes on as if it had not stopped
    again = list(training_order.read_sequences(folder, n // 2, n, length, shard))
    assert [s.tolist() for s in again] == [s.tolist() for s in sequences[n // 2 :]]
    return np.concatenate([sequences[s] for s in training_order.feistel(np.arange(n), n, 17)]).tolist() if n else []


def test_shards_hold_every_id_in_order(spark, tmp_path, tokenizer_files):
    tokenizer = Tokenizer.from_file(tokenizer_files("byte_bpe_50k.json"))
    docs = spark.createDataFrame(edges.rows(), edges.SCHEMA).coalesce(1)
    stream = round_trip(spark, docs, f"file://{tmp_path}/a", tokenizer_files, 32, 50)
    want = [i for r in docs.collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 50256]]
    assert stream[: len(want)] == want and set(stream[len(want) :]) <= {50256} and len(stream) - len(want) < 32


def test_several_partitions_and_none(spark, tmp_path, tokenizer_files):
    tokenizer = Tokenizer.from_file(tokenizer_files("byte_bpe_50k.json"))
    docs = edges.frame(spark)
    stream = round_trip(spark, docs, f"file://{tmp_path}/b", tokenizer_files, 16, 20)
    ids = sorted(i for r in docs.collect() for i in tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert sorted(i for i in stream if i != 50256) == [i for i in ids if i != 50256]
    assert training_order.write_training_order(docs.limit(0), tokenizer_files("byte_bpe_50k.tiktoken"), f"file://{tmp_path}/c").count() == 0


def test_query(spark, bundled):
    rows = QUERIES["op8_training_order"](spark, bundled).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
