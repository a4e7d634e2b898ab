import numpy as np
import pyarrow as pa
import pytest

from docstrata.llm import periodic_runs, spelling_variants, substring_dedup
from docstrata.llm.common import Words, slices
from docstrata.llm.sentencepiece_codec import piece_codec
from tests.llm import edges


def test_slices_hold_whole_texts():
    texts = ["a b", "", "x" * 50, "c", None, "d e f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["i", "t"])
    parts = list(slices([batch.slice(1), batch.slice(0, 0)], "t", 10))
    assert [v for p in parts for v in p.column("t").to_pylist()] == texts[1:] and len(parts) > 2


def test_large_offsets_are_refused(spark):
    """A session that sends them gets an error, not other results."""
    with pytest.raises(TypeError):
        Words(pa.array(["a"], pa.large_string()))
    docs = edges.frame(spark, edges.EDGES[:9])
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        for query in (substring_dedup.passage_digests, periodic_runs.run_digests, spelling_variants.count_words):
            with pytest.raises(Exception, match="useLargeVarTypes"):
                query(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
    assert substring_dedup.passage_digests(docs).count() == 9


def test_words_are_looked_up_beside_double_spaces(tokenizer_files):
    codec = piece_codec(tokenizer_files("piece_bpe_32k.model"))
    codec.encode("some words here")
    calls, run = [], type(codec)._run
    codec._run = lambda r: calls.append(r) or run(codec, r)
    try:
        assert codec.encode("some words  here") == [*codec.encode("some words"), *codec.encode(" here")]
    finally:
        del codec._run
    assert "▁some" not in calls and "▁words" not in calls


def test_hashes_of_words_do_not_depend_on_neighbours():
    texts = pa.array(["one two", "two", " one\ttwo "])
    words = Words(texts)
    assert words.counts.tolist() == [2, 1, 2] and np.array_equal(words.hashes[[0, 1]], words.hashes[[3, 4]])
