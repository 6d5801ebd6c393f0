"""Merge encoding by backtracking against the library."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quizgrove.llm import piece_texts, pieces
from quizgrove.llm.queries import PIECE_MODEL, QUERIES

MODEL = public_tokenizers.path(PIECE_MODEL)
PARTS = ["a", "b", "th", "e", " ", "  ", "   ", "\n", "\t", "é", "!!", "</s>", "<unk>", "12", "　", "漢字", "梦", "🙂", "'", "ing", "▁", "the",
         "\x00", "ation", "aaaaaa", " " * 17, "<0x0A>", "हि", "xyzzyq", "Ünï", ".", "\x85"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as file:
        return pieces.MergeEncoder(file.read())


def test_odd_texts(library, encoder, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 300)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 500)
    generator = random.Random(4)
    texts = ["".join(generator.choice(PARTS) for _ in range(generator.randint(0, 25))) for _ in range(8000)]
    assert [encoder.encode(text) for text in texts] == library.encode(texts, add_eos=True)
    encoder.older.clear()
    encoder.words.clear()
    assert encoder.encode_all(texts) == library.encode(texts, add_eos=True)


def test_long_words(library, encoder):
    for text in ("abcdefg漢字" * 20_000, "ab" * 50_000 + "a" * 50_001, " " * 30_001, "\n" * 20_000):
        assert encoder.encode(text) == library.encode(text, add_eos=True)


def test_every_piece_and_pairs_of_pieces(library, encoder):
    names = sorted(encoder.ids)
    generator = random.Random(8)
    texts = [name.replace("▁", " ") for name in names] + ["".join(generator.sample(names, 2)) for _ in range(10_000)]
    assert [encoder.encode(text) for text in texts] == library.encode(texts, add_eos=True)


def test_words_need_not_be_cut_apart(library, encoder, monkeypatch):
    """The row of a whole normalised text, no word cut off beforehand, is the same."""
    texts = ["the  cat's 12 hats.\nÜnïcode   漢字 ation", "  leading", "trailing  ", "a.b,c;d"]
    for text in texts:
        assert [*encoder.ids_of(encoder.row(encoder.normalized(text))), encoder.end_id] == library.encode(text, add_eos=True)


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[400].type = pieces.USER_DEFINED
    with pytest.raises(ValueError):
        pieces.MergeEncoder(model.SerializeToString())
    model.pieces[400].type = pieces.NORMAL
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.MergeEncoder(model.SerializeToString())


def test_models_with_other_normalisers(library):
    """No dummy prefix, extra spaces removed, no byte fallback: unknown characters beside each other are one id."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = True
    model.trainer_spec.byte_fallback = False
    for piece in model.pieces:
        if piece.type == pieces.BYTE:
            piece.type = pieces.CONTROL
    content = model.SerializeToString()
    own, theirs = pieces.MergeEncoder(content), sentencepiece.SentencePieceProcessor(model_proto=content)
    for text in ["", " ", "  a  b ", "x\n\n\ty", "🙂🙂 ok", "the cat \n 漢"]:
        assert own.encode(text) == theirs.encode(text, add_eos=True), text


def test_new_words_take_no_python_call_each(library, encoder):
    """New words are encoded together: a call or more for each was most of the operator's time (found at 1032 CPU seconds a GB)."""
    words = [" " + "".join(letters) for letters in itertools.product("abcdefghijkl", repeat=4)]
    texts = ["".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    encoder.encode_all(texts)  # the pairs of pieces are known from now on
    encoder.words.clear()
    encoder.older.clear()
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = encoder.encode_all(texts)
    finally:
        sys.setprofile(None)
    assert found == library.encode(texts, add_eos=True)
    assert calls < len(words) / 4


def test_runs_of_texts(library, encoder, monkeypatch):
    """Generations of kept words change between runs; words too long to be kept, lone characters and empty texts stand among others."""
    monkeypatch.setattr(pieces, "KEPT_WORDS", 40)
    generator = random.Random(5)
    parts = [*PARTS, "ab" * 40, "q" * 49, "q" * 48, "\U0010ffff", "ÿ", ""]
    texts = ["".join(generator.choice(parts) for _ in range(generator.randint(0, 6))) for _ in range(3000)]
    for size in (1, 7, 100):
        found = [ids for i in range(0, len(texts), size) for ids in encoder.encode_all(texts[i : i + size])]
        assert found == library.encode(texts, add_eos=True)
    bounds, ids = encoder.encode_arrays(["", "a cat", "", ""])
    assert bounds.tolist() == [0, 1, len(ids) - 2, len(ids) - 1, len(ids)] and encoder.decode_all(bounds, ids) == ["", "a cat", "", ""]
    assert encoder.encode_all([]) == [] and encoder.encode_all(["", ""]) == [[encoder.end_id]] * 2


def test_numbers_by_keys():
    generator = np.random.default_rng(6)
    keys = np.unique(generator.integers(0, 1 << 62, 5000))
    numbers = pieces.Numbers()
    for some in np.array_split(generator.permutation(len(keys)), 30):
        numbers.add(keys[some], some)
    assert numbers.get(keys).tolist() == list(range(len(keys))) and set(numbers.get(keys + 1)[~np.isin(keys + 1, keys)]) == {-1}
    assert numbers.get(keys[:0]).tolist() == []


def wanted(library, rows):
    for doc_id, text in rows:
        ids = library.encode(text or "", add_eos=True)
        yield doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    found = [tuple(row) for row in QUERIES["op13_piece_texts"](spark, sf_dir).collect()]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(found) == sorted(wanted(library, rows))


def test_edges(spark, library, monkeypatch):
    monkeypatch.setattr(piece_texts, "RUN_BYTES", 20)
    rows = [(1, "a cat"), (1, "a cat"), (2, None), (3, ""), (None, "x"), (None, None), (4, "long " * 50_000), (5, " \n ")]
    docs = spark.createDataFrame([(*row, "x", [1]) for row in rows], "doc_id long, text string, decoded string, ids array<int>")
    found = [tuple(row) for row in piece_texts.piece_table(docs, MODEL).collect()]
    assert sorted(found, key=repr) == sorted(wanted(library, rows), key=repr)
    whole = {row["doc_id"]: row for row in piece_texts.encoded(docs.filter("doc_id = 3 OR doc_id = 5"), MODEL).collect()}
    assert whole[3]["ids"] == [2] and whole[3]["decoded"] == "" and whole[5]["decoded"] == library.decode(library.encode(" \n "))
    assert piece_texts.piece_table(docs.limit(0), MODEL).collect() == []
