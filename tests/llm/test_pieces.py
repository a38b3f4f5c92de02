import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces
from tidemark.llm.registry import piece_model

from .util import SF, crowded, empty_docs, odd_docs, odd_rows, rows_of


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def ids_of(model, text):
    return model.encode(text or "", out_type=int, add_eos=True, add_bos=False)


def test_table_texts(spark, model):
    table = pieces.prefix_table(piece_model())
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = table.encode(r["text"])
        assert ids == ids_of(model, r["text"])
        assert table.decode(ids) == model.decode(ids)


def test_digests(spark, model):
    rows = rows_of(pieces.piece_digests(odd_docs(spark), piece_model()))
    want = []
    for i, text, *_ in odd_rows():
        ids = ids_of(model, text)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(want)
    assert pieces.piece_digests(empty_docs(spark), piece_model()).count() == 0


def test_columns_stay(spark, model):
    docs = crowded(odd_docs(spark)).drop("ids")
    out = pieces.encode_texts(docs, piece_model())
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for r in rows_of(out):
        assert r["ids"] == ids_of(model, r["text"]) and r["decoded"] == model.decode(r["ids"])


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    table = pieces.prefix_table(piece_model())
    assert table.encode(text) == ids_of(model, text)
    assert table.decode(table.encode(text)) == model.decode(ids_of(model, text))


def test_spaces_and_junk(model):
    table, rng = pieces.prefix_table(piece_model()), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice([" ", "  ", "▁", "\t", "\n", "the", "ing", "Über", "東", "🙂", "a", "'s", "==", "\x00", "​", "<s>", "</s>", "<0x41>", "é", "é"]) for _ in range(rng.randrange(12)))
        assert table.encode(text) == ids_of(model, text), repr(text)
        ids = table.encode(text)
        assert table.decode(ids) == model.decode(ids), repr(text)
    for n in (1, 2, 3, 15, 16, 17, 31, 100, 1000):
        assert table.encode(" " * n) == ids_of(model, " " * n)
        assert table.encode("x" * n) == ids_of(model, "x" * n)


def test_long_texts_are_taken_in_stretches(model, monkeypatch):
    """Cuts fall between units, wherever a stretch ends: in words, in runs of spaces, in texts without any."""
    table, rng = pieces.prefix_table(piece_model()), random.Random(8)
    texts = ["".join(rng.choice([" ", "  ", "word", "Ünï", ".", "\n", "▁", "x", "12", "東京"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    for stretch in (1, 3, 10):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        for text in [*texts, "a" * 50, " " * 50, ""]:
            assert table.encode(text) == ids_of(model, text)
            assert table.decode(table.encode(text)) == model.decode(ids_of(model, text))
