import hashlib
import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docstrata.llm import sentencepiece_codec as codec
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_ids_and_texts_are_the_library_s(tokenizer_files):
    model = tokenizer_files("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), codec.piece_codec(model)
    alphabet = "abcdeth in  ▁\t\n<>0x1é日本\U0001f600́​##..AS"
    random.seed(5)
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(3000)]
    for text in [*texts, "the " * 300, "a" * 3000, " " * 100, "=" * 50, "x▁▁y", *(t for _, t, _, _ in edges.EDGES if t)]:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), codec.piece_codec(model)
    if "\x00" not in text:
        assert own.encode(text) == library.encode(text)


def test_odd_documents(spark, tokenizer_files):
    model = tokenizer_files("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = edges.frame(spark)
    got = [tuple(r) for r in codec.token_digests(docs, model).collect()]
    assert edges.same(got, [(i, *expected(library, t)) for i, t, _, _ in edges.EDGES])
    texts = codec.decode_documents(codec.encode_documents(docs, model), model).collect()
    assert edges.same([tuple(r) for r in texts], [(i, library.decode(library.encode(t or ""))) for i, t, _, _ in edges.EDGES])
    assert codec.token_digests(docs.limit(0), model).count() == 0


def test_query_against_the_library(spark, bundled, tokenizer_files):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op1_sentencepiece"](spark, bundled).collect()]
    assert edges.same(got, [(i, *expected(library, t)) for i, t in docs])
