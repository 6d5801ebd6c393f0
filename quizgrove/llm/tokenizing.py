"""Tokenizer files as parameters, and encoders that Python workers keep.

A tokenizer's file is read once on the driver and sent to the executors as a broadcast of a few MB at
most (the size of a vocabulary file, whatever the data's size).
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Pieces of text whose ids a worker keeps before it starts afresh (some 40 MB).
KEPT_PIECES = 900_000
#: Kept pieces that are looked up at once: the table made for that is some 10 MB.
PIECES_LOOKED_UP = 1 << 17
#: New pieces encoded in one call; the library needs some 150 bytes a token meanwhile.
PIECES_AT_ONCE = 10_000
#: Bytes of text encoded at once, so that a worker's memory doesn't follow the size of its batches.
BYTES_AT_ONCE = 1 << 23


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer's content, its kind (``json`` or ``model``) and a digest that names the version."""

    content: Broadcast
    kind: str
    version: str

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TokenizerFile:
        with open(path, "rb") as file:
            content = file.read()
        kind = "json" if path.endswith(".json") else "model"
        return cls(spark.sparkContext.broadcast(content), kind, version_of(content, kind))

    def encoder(self) -> Encoder:
        """The worker's encoder for this file, made at its first use in a process."""
        if self.version not in _encoders:
            _encoders[self.version] = encoder_of(self.content.value, self.kind)
        return _encoders[self.version]


_encoders: dict[str, object] = {}


def version_of(content: bytes, kind: str) -> str:
    """Digest of all that decides the ids: the file and the library's version."""
    if kind == "json":
        import tokenizers as library
    else:
        import sentencepiece as library
    return hashlib.sha256(f"{kind} {library.__version__} ".encode() + content).hexdigest()


def encoder_of(content: bytes, kind: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    if kind == "model":
        return Sentences(content)
    return Pieces(content) if splits_at_spaces(json.loads(content)) else Encoder(content)


def splits_at_spaces(setup: dict) -> bool:
    """Whether a single space before a visible character always begins a new word of this tokenizer.

    So it is for byte-level BPE with the usual pattern, no normalizer and no added token that holds or
    takes in white space: then the parts of a text between such spaces can be encoded one by one.
    """
    before = setup.get("pre_tokenizer") or {}
    model = setup["model"]
    added = setup.get("added_tokens") or []
    return (
        setup.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("add_prefix_space") is False
        and before.get("use_regex", True) is True
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added)
        and not any(any(c.isspace() for c in x["content"]) for x in added)
    )


def release_unused() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system: a worker waits long for its next task."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def slices(texts: pa.Array):
    """Runs of texts of about ``BYTES_AT_ONCE``; a longer text is a run of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, own in enumerate(sizes.tolist()):
        if size and size + own > BYTES_AT_ONCE:
            yield texts.slice(begin, i - begin)
            begin, size = i, 0
        size += own
    if begin < len(texts):
        yield texts.slice(begin)


class Encoder:
    """Any tokenizer of the ``tokenizers`` library: whole texts, nothing added, cut off or padded.

    Texts come as an Arrow array of strings without nulls.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: pa.Array):
        """An array of ids for each text, a few texts at a time."""
        for run in slices(texts):
            for found in self.whole(run.to_pylist()):
                yield np.asarray(found, dtype=np.uint32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.fromiter(map(len, self.ids(texts)), dtype=np.int64, count=len(texts))


class Sentences(Encoder):
    """A SentencePiece model, without begin and end."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Pieces(Encoder):
    """Same ids for tokenizers that ``splits_at_spaces``: each different piece is encoded once.

    A text is cut at its spaces. New pieces of a run are encoded in one call, joined by spaces; as only a
    piece's first token can begin with a space, that token's place tells where its ids begin. A text with
    a piece that is empty or begins with white space (two spaces, a space at the end, a space before a line
    end) is encoded whole.
    """

    def __init__(self, content: bytes):
        super().__init__(content)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(words.values()) + 1, dtype=bool)
        self.begins[[number for word, number in words.items() if word.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], type=pa.string())
        self.start = np.zeros(0, dtype=np.int32)
        self.length = np.zeros(0, dtype=np.int32)  # -1: the piece can't be encoded alone
        self.flat = np.zeros(0, dtype=np.uint32)

    def learn(self, new: pa.Array) -> None:
        pieces = new.to_pylist()
        alone = np.array([bool(piece) and not piece[0].isspace() for piece in pieces], dtype=bool)
        start, length = np.zeros(len(pieces), dtype=np.int32), np.full(len(pieces), -1, dtype=np.int32)
        if alone.any():
            fitting = pieces if alone.all() else [piece for piece, fits in zip(pieces, alone, strict=True) if fits]
            parts = [fitting[i : i + PIECES_AT_ONCE] for i in range(0, len(fitting), PIECES_AT_ONCE)]
            ids = np.concatenate([np.asarray(self.whole([" " + " ".join(part)])[0], dtype=np.uint32) for part in parts])
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != alone.sum():
                raise ValueError("the tokenizer doesn't begin a word at each space")
            start[alone] = begin + len(self.flat)
            length[alone] = np.diff(begin, append=len(ids))
            self.flat = np.concatenate([self.flat, ids])
        self.known = pa.concat_arrays([self.known, new])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])

    def places(self, pieces: pa.Array) -> pa.Array:
        """Where each piece stands among the known, null for new ones."""
        found = pa.nulls(len(pieces), pa.int32())
        for begin in range(0, len(self.known), PIECES_LOOKED_UP):
            here = pc.index_in(pieces, value_set=self.known.slice(begin, PIECES_LOOKED_UP))
            found = pc.coalesce(found, pc.add(here, pa.scalar(begin, pa.int32())))
        return found

    def encoded(self, run: pa.Array):
        """Each text's first ids, the bounds of its other pieces, and whether they can be put together; each piece's
        begin and length in ``flat`` (of no use for first pieces)."""
        cut = pc.split_pattern(run, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        words = cut.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds -= bounds[0]
        heads = self.whole(words.take(pa.array(bounds[:-1])).to_pylist())
        words = words.dictionary_encode()
        del cut  # the uncut copy of all words isn't needed while pieces are looked up
        places = self.places(words.dictionary)
        new = places.is_null().to_numpy(zero_copy_only=False)
        places = places.fill_null(0).to_numpy().copy()
        if new.any():
            places[new] = len(self.known) + np.arange(new.sum(), dtype=np.int32)
            self.learn(words.dictionary.filter(pa.array(new)))
        places = places[words.indices.to_numpy(zero_copy_only=False)]
        start, length = self.start[places], self.length[places]
        length[bounds[:-1]] = 0
        return heads, bounds, np.minimum.reduceat(length, bounds[:-1]) >= 0, start, length

    def ids(self, texts: pa.Array):
        for run in slices(texts):
            heads, bounds, fits, start, length = self.encoded(run)
            for i, head in enumerate(heads):
                if not fits[i]:
                    yield np.asarray(self.whole([run[i].as_py()])[0], dtype=np.uint32)
                    continue
                own = slice(bounds[i], bounds[i + 1])
                ends = np.cumsum(length[own], dtype=np.int64)
                found = np.empty(len(head) + int(ends[-1]), dtype=np.uint32)
                found[: len(head)] = head
                found[len(head) :] = self.flat[np.repeat(start[own] - ends + length[own], length[own]) + np.arange(ends[-1])]
                yield found
            self.bound()

    def counts(self, texts: pa.Array) -> np.ndarray:
        found = [np.zeros(0, dtype=np.int64)]
        for run in slices(texts):
            heads, bounds, fits, _, length = self.encoded(run)
            own = np.add.reduceat(length, bounds[:-1], dtype=np.int64) + [len(head) for head in heads]
            for i in np.flatnonzero(~fits):
                own[i] = len(self.whole([run[int(i)].as_py()])[0])
            found.append(own)
            self.bound()
        return np.concatenate(found)

    def bound(self) -> None:
        if len(self.known) > KEPT_PIECES:
            self.forget()
