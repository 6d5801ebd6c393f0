"""Token counts, Simple-8b and token files."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quizgrove.llm import simple8b, token_counts, token_files, tokenizing
from quizgrove.session import new_folder
from tests.llm import brute

PARTS = ["a", "b", "'s", " ", "  ", "\n", "\t", "é", "!!", "<|endoftext|>", "12", "　", "\x1c", "\x85", "漢", "🙂", "'", " the", "ing", "'ll", " "]


def content(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def odd_texts(count):
    generator = random.Random(3)
    return ["".join(generator.choice(PARTS) for _ in range(generator.randint(0, 14))) for _ in range(count)]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenizing, "PIECES_AT_ONCE", 50)
    monkeypatch.setattr(tokenizing, "KEPT_PIECES", 500)
    monkeypatch.setattr(tokenizing, "BYTES_AT_ONCE", 2000)
    pieces = tokenizing.encoder_of(content("byte_bpe_50k.json"), "json")
    assert isinstance(pieces, tokenizing.Pieces)
    texts, coder = odd_texts(5000), brute.tokenizer()
    wanted = [found.ids for found in coder.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in pieces.ids(pa.array(texts))] == wanted
    assert pieces.counts(pa.array(texts)).tolist() == [len(ids) for ids in wanted]
    assert pieces.counts(pa.array([], type=pa.string())).tolist() == []


def test_known_pieces_are_looked_up_part_by_part(monkeypatch):
    monkeypatch.setattr(tokenizing, "PIECES_LOOKED_UP", 7)
    monkeypatch.setattr(tokenizing, "BYTES_AT_ONCE", 2000)
    pieces = tokenizing.encoder_of(content("byte_bpe_50k.json"), "json")
    texts, coder = odd_texts(3000), brute.tokenizer()
    wanted = [found.ids for found in coder.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in pieces.ids(pa.array(texts))] == wanted
    assert len(pieces.known) == len(set(pieces.known.to_pylist())) > 14
    assert pieces.places(pa.array([pieces.known[20].as_py(), "never seen", pieces.known[3].as_py()])).to_pylist() == [20, None, 3]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(name):
    encoder = tokenizing.encoder_of(content(name), name.rpartition(".")[2])
    assert not isinstance(encoder, tokenizing.Pieces)
    texts = ["The cat  sat.", "", "Ünïcode 漢"]
    assert encoder.counts(pa.array(texts)).tolist() == [len(ids) for ids in encoder.ids(pa.array(texts))]
    assert encoder.counts(pa.array(texts)).tolist()[1] == 0


def test_simple8b_round_trip():
    generator = np.random.default_rng(1)
    for trial in range(200):
        n = int(generator.integers(0, 1500))
        values = generator.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(trial % 2)
        values >>= generator.integers(0, 64, n).astype(np.uint64) if trial % 3 else np.uint64(48)
        words, begins = simple8b.pack(values)
        assert np.array_equal(simple8b.unpack(words), values)
        a, b = sorted(generator.integers(0, n + 1, 2).tolist())
        assert np.array_equal(simple8b.unpack_range(words, begins, a, b), values[a:b])
    # three ids a word, begun anew in each block: four blocks of 256 and one of 176
    assert len(simple8b.pack(np.full(1200, 50_000))[0]) == 4 * 86 + 59


def rows(spark):
    texts = [(5, "plain text"), (1, None), (2, ""), (3, "x " * 40_000), (5, "plain text"), (5, "other"), (4, "tail ")]
    return spark.createDataFrame([(d, t, 7) for d, t in texts], "doc_id long, text string, n_tokens int")


def test_counts_come_from_the_cache(spark, monkeypatch):
    folder, path = new_folder(spark, "cache"), public_tokenizers.path("byte_bpe_50k.json")
    found = sorted(tuple(r) for r in token_counts.token_counts(rows(spark), path, folder, 1024).collect())
    coder = brute.tokenizer()
    wanted = []
    for doc_id, text, _ in rows(spark).collect():
        n = len(coder.encode(text or "", add_special_tokens=False).ids)
        wanted.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert found == sorted(wanted)
    stored = spark.read.parquet(folder)
    assert stored.count() == 5  # null and empty are one text, and so are the copies
    again = token_counts.token_counts(rows(spark).filter("doc_id = 5"), path, folder, 1024).collect()
    assert len(again) == 3 and spark.read.parquet(folder).count() == 5
    assert token_counts.token_counts(rows(spark).limit(0), path, new_folder(spark, "cache"), 1024).collect() == []


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 30)
    folder, path = new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    docs = rows(spark).filter("NOT (doc_id = 5 AND text = 'other')")
    token_files.write_tokens(docs, path, folder)
    found = [tuple(r) for r in token_files.token_digests(spark, folder).collect()]
    assert sorted(found) == sorted(brute.token_rows([(r[0], r[1]) for r in docs.collect()]))
    coder = brute.tokenizer()
    for row in token_files.read_tokens(spark, folder).collect():
        texts = [t for d, t, _ in docs.collect() if d == row["doc_id"]]
        assert row["ids"] == [*coder.encode(texts[0] or "", add_special_tokens=False).ids, 0]


def test_token_files_of_shared_and_null_ids_and_of_nothing(spark):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "tokens")
    docs = spark.createDataFrame([(None, "b"), (7, "a"), (7, "c c"), (None, "b")], "doc_id long, text string")
    token_files.write_tokens(docs, path, folder)
    found = sorted((tuple(r) for r in token_files.token_digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 7, 7]
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found[:-1])]).tolist()
    empty = new_folder(spark, "tokens")
    token_files.write_tokens(docs.limit(0), path, empty)
    assert token_files.token_digests(spark, empty).collect() == []


def test_copies_are_reduced_before_texts_are_shuffled(spark, tmp_path, monkeypatch):
    """Between the scan and the first exchange stands a partial aggregate, whatever the cache holds."""
    plans = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[1])
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string")
    for _ in range(2):
        rows = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache"), 1)
        assert rows.count() == 30 and rows.filter("n_tokens = 2 AND over_limit").count() == 30
    encoding = [plan for plan in plans if "MapInArrow" in plan]
    assert len(encoding) == 2
    for plan in encoding:
        assert plan.index("partial_first(content") < plan.index("Scan ExistingRDD") if "Scan ExistingRDD" in plan else "partial_first(content" in plan
        assert "LeftAnti" not in plan
