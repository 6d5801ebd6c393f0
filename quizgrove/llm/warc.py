"""WARC archives with revisits, and their capture index (operator 8).

Spark's text sink writes the archives: a row is a record, and its line separator is what ends a WARC record, so
files are committed like any other output. Reading gives each file's records as a run sorted by url key and
time; runs are dealt out by ranges of both, and each range merges its runs by a loser tree, so that the
rows of all ranges together are the captures in global order.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizgrove.llm.common import counted
from quizgrove.session import saved

END = "\r\n\r\n"
#: Payloads below this size are always stored.
REVISIT_BYTES = 100
#: Records in a file, at most.
FILE_RECORDS = 10_000
#: The second at which page 0 counts as captured, where no time is given: 2024-01-01T00:00:00Z.
EPOCH = 1_704_067_200
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CAPTURES = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("run", pa.string()),
        ("offset", pa.int64()),
    ]
)
CAPTURES_DDL = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, run string, offset long"
)


def record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def capture_time(page_id: Column) -> Column:
    """A time for pages that have none: as many seconds after ``EPOCH`` as their id says (50 years at most)."""
    second = F.lit(EPOCH) + F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(50 * 365 * 86_400))
    return F.timestamp_seconds(second)


def records(pages: DataFrame, time: Column | None = None) -> DataFrame:
    """One WARC record a row of ``pages``, without its end, in the column ``value``.

    Of rows with equal payloads of at least ``REVISIT_BYTES``, those with the least page_id are responses, the others
    revisits that refer to it (null ids last; without any id all are responses). A null html is an empty payload. A
    revisit keeps the HTTP header, and so the payload's length, but not the payload.
    """
    time = capture_time(F.col("page_id")) if time is None else time
    stamp = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        stamp.alias("stamp"),
        F.octet_length(payload).alias("size"),
        F.sha2(payload, 256).alias("digest"),
        payload.alias("payload"),
    )
    large = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest")
    shared = large.agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 AND first IS NOT NULL")
    shared = counted(saved(shared.select("digest", "first"), "shared-payloads"))
    rows = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.col("stamp")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),  # null: no such line
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write_archive(pages: DataFrame, folder: str, time: Column | None = None) -> None:
    """Gzipped WARC files of at most ``FILE_RECORDS`` records; other columns of ``pages`` are not read."""
    writer = records(pages, time).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, in lower case: what belongs to one site sorts together."""
    host, slash, rest = re.sub(r"^[^/?#]*://", "", (url or "").partition("#")[0].lower(), count=1).partition("/")
    host, question, query = host.partition("?")
    return ",".join(reversed(host.split("."))) + ")" + question + query + slash + rest


def parsed(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record of a gzipped WARC file, one at a time."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
    offset = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {offset}")
        header, size = {}, len(version)
        while (line := stream.readline()).strip():
            size += len(line)
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            header[name.lower()] = value
        length = int(header["content-length"])
        block, end = stream.read(length), stream.read(len(END))
        if len(block) != length or end != END.encode():
            raise ValueError(f"the record at {offset} is cut off")
        yield offset, header, block
        offset += size + len(line) + length + len(end)


def page_of(name: str) -> int | None:
    number = name[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def capture(run: str, offset: int, header: dict[str, str], block: bytes) -> tuple:
    """A row of ``CAPTURES``; a payload that doesn't have its digest is an error."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = header["warc-payload-digest"].removeprefix("sha256:")
    kind, refers = header["warc-type"], header.get("warc-refers-to")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload at {offset} of {run} doesn't have its digest")
    url = header.get("warc-target-uri")
    page = page_of(header["warc-record-id"])
    return (url_key(url), header["warc-date"], page, url, length, digest, kind, page_of(refers) if refers else None, run, offset)


def order(row: tuple) -> tuple:
    """Url key, time, page (null last), then the place in the archive."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        columns = zip(*rows[i : i + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(columns, CAPTURES.types, strict=True)], schema=CAPTURES)


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of each archive file, sorted: a run for each file."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.column(0)[i].as_py().rpartition("/")[2]
                rows = [capture(run, *found) for found in parsed(batch.column(1)[i].as_py())]
                yield from batches_of(sorted(rows, key=order))

    return files.mapInArrow(read, CAPTURES_DDL)


class LoserTree:
    """Merges sorted lists: each step replays one path of matches, from the last winner's leaf to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.heads = [self.next_of(i) for i in range(len(runs))]
        self.losers = [-1] * len(runs)  # by inner node; the first is not used
        self.winner = self.play(1) if runs else -1

    def next_of(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (order(row), row)

    def beats(self, a: int, b: int) -> bool:
        """An ended run loses; of equal heads the earlier run's wins."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self.play(2 * node), self.play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            yield self.heads[self.winner][1]
            winner = self.winner
            self.heads[winner] = self.next_of(winner)
            node = (winner + len(self.runs)) // 2
            while node:
                if self.beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.winner = winner


def merged_captures(runs: DataFrame) -> DataFrame:
    """All captures in order of url key, time and page: range after range, each merged from its slices of the runs.

    Ranges are cut by the whole order, so that a url with very many captures is spread too. A task holds
    the index rows of its range, no payloads.
    """
    shares = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(shares, "url_key", "captured", F.col("page_id").asc_nulls_last(), "run", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = defaultdict(list)
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                slices[row[8]].append(row)
        for own in slices.values():
            own.sort(key=order)  # in order already, but where a shuffle handed over blocks of a run late
        rows = []
        for row in LoserTree([slices[run] for run in sorted(slices)]):
            rows.append(row)
            if len(rows) == 10_000:
                yield from batches_of(rows)
                rows = []
        yield from batches_of(rows)

    return dealt.mapInArrow(merge, CAPTURES_DDL)


def capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of an archive in global order: url_key, captured, page_id, url, payload_bytes and payload_digest (of the
    full payload, also for revisits), record_type, refers_to, and the file and offset of the record.
    """
    return merged_captures(saved(capture_runs(spark, folder), "capture-runs"))
