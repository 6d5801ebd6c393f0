"""Token ids in Simple-8b files (operator 2).

The file format is a Parquet folder whose rows are segments: whole documents in ascending order of id, about
``SEGMENT_IDS`` ids in all (a longer document is a segment of its own). A segment has the ids of its
documents packed by ``simple8b``, the words at which its blocks begin, the documents' ids and lengths, the
number of its part (ascending with the documents) and how many ids of that part come before it. Spark's own
writer commits the files, so lost executors leave neither half-written nor doubled segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizgrove.llm import simple8b
from quizgrove.llm.common import small_batches, text_key
from quizgrove.llm.tokenizing import BYTES_AT_ONCE, TokenizerFile, release_unused

SEGMENT_IDS = 1 << 19

SEGMENTS = pa.schema(
    [
        ("part", pa.int64()),
        ("part_offset", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
        ("words", pa.binary()),
        ("block_begins", pa.binary()),
    ]
)
SEGMENTS_DDL = (
    "part long, part_offset long, doc_ids array<long>, lengths array<long>, n_ids long, words binary, "
    "block_begins binary"
)


def segment(part: int, offset: int, doc_ids: list, pieces: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(pieces)
    words, begins = simple8b.pack(ids)
    row = [part, offset, doc_ids, [len(x) for x in pieces], len(ids), words.astype("<u8").tobytes(), begins.astype("<u4").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], type=kind) for x, kind in zip(row, SEGMENTS.types, strict=True)], schema=SEGMENTS)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> None:
    """Encodes every whole text, appends ``end_id`` to each document and writes the segments.

    Null texts are empty: only the end id. Rows with a null id come first; rows that share an id follow each
    other in order of a hash of their text, and equal rows are all written. Texts are dealt by ranges of (id,
    hash), so that no id's rows meet in one task because of its number of texts; each task encodes its
    documents in order and keeps at most a segment and a batch in memory. An empty table gives no segments.
    """
    file = TokenizerFile.read(docs.sparkSession, tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("content"))
    rows = rows.withColumn("tie", text_key(F.col("content")))
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(shares, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = file.encoder(), TaskContext.get().partitionId()
        offset = size = 0
        doc_ids, pieces = [], []
        for numbers, texts in gathered(batches):
            for number, ids in zip(numbers.to_pylist(), encoder.ids(texts), strict=True):
                if size and size + len(ids) > SEGMENT_IDS:
                    yield segment(part, offset, doc_ids, pieces)
                    offset, size, doc_ids, pieces = offset + size, 0, [], []
                pieces.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(number)
                size += len(ids) + 1
            release_unused()
        if size:
            yield segment(part, offset, doc_ids, pieces)

    with small_batches(docs.sparkSession):
        rows.select("doc_id", "content").mapInArrow(encode, SEGMENTS_DDL).write.parquet(folder)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches that hold about ``BYTES_AT_ONCE`` of text together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BYTES_AT_ONCE:
            joined = tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
            held, size = [], 0
            del batch
            yield joined
            del joined
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(2))


def placed_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``begin``, the ids of all segments before each.

    Sums by part are as many as the tasks that wrote (a bound that does not follow the rows), so they are
    added up in one task and broadcast.
    """
    stored = spark.read.schema(SEGMENTS_DDL).parquet(folder)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_begin"))
    placed = stored.join(F.broadcast(parts), "part")
    return placed.withColumn("begin", F.col("part_begin") + F.col("part_offset")).drop("part_begin")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and the ids (as an array of longs) of each document in the files."""
    placed = placed_segments(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, lengths = unpacked(row)
            ends = np.cumsum(lengths)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), type=pa.int32()), pa.array(ids.astype(np.int64)))
            starts = pa.array(row["begin"] + ends - lengths, type=pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], type=pa.int64()), starts, lists], ["doc_id", "start", "ids"])

    return placed.mapInArrow(decode, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, from the files."""
    placed = placed_segments(spark, folder)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, lengths = unpacked(row)
            data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
            sums = [zlib.crc32(data[4 * (end - n) : 4 * end]) for end, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [row["doc_ids"], row["begin"] + ends - lengths, lengths, sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=pa.int64()) for x in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return placed.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = simple8b.unpack(np.frombuffer(row["words"], dtype="<u8"))
    if len(ids) != row["n_ids"]:
        raise ValueError(f"a segment of {row['n_ids']} ids holds {len(ids)}")
    return ids, np.asarray(row["lengths"], dtype=np.int64)
