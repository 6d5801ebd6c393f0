"""SentencePiece encoding and decoding of whole texts (operator 13).

``MergeEncoder`` finds the ids; Spark deals out the rows. Each task encodes runs of a few MB of text, so that a
worker's memory follows neither the size of its partition nor that of Spark's batches; a longer text is a
run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.llm.pieces import MergeEncoder
from quizgrove.llm.tokenizing import TokenizerFile

#: Bytes of text whose ids and decoded texts are sent back at once.
RUN_BYTES = 1 << 21

_encoders: dict[str, MergeEncoder] = {}


def encoder_of(file: TokenizerFile) -> MergeEncoder:
    """The worker's encoder for this file, made at its first use in a process."""
    if file.version not in _encoders:
        _encoders[file.version] = MergeEncoder(file.content.value)
    return _encoders[file.version]


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of about ``RUN_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    begin = size = 0
    for i, own in enumerate(sizes):
        if i > begin and size + own > RUN_BYTES:
            yield begin, i
            begin, size = i, 0
        size += own
    if begin < len(sizes):
        yield begin, len(sizes)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id) and decoded (the text that the ids decode to) of each row of ``docs``.

    Null and empty texts have the end id only and decode to the empty text. Every row is returned, rows that
    repeat or have a null id too; an empty table gives no rows; other columns are not read. A text of any
    length is encoded whole, by one task, in time that follows its length. Nothing is shuffled.
    """
    file = TokenizerFile.read(docs.sparkSession, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        for batch in batches:
            texts = batch.column("text")
            for begin, end in runs(texts):
                bounds, ids = encoder.encode_arrays([text or "" for text in texts.slice(begin, end - begin).to_pylist()])
                decoded = encoder.decode_all(bounds, ids)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column("doc_id").slice(begin, end - begin), lists, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def piece_table(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space) and decoded_sha256."""
    return encoded(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
