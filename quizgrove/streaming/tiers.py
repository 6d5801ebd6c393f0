"""Refresh tiers as a stream (L28): counts and sums per time slot, emitted once, and late rows kept apart.

A slot is closed when the stream has seen an event ``delay`` later than its end. Its figures are then emitted once and its
state goes; rows that come for a closed slot are emitted as they are. What is emitted is only ever appended, so
final figures and late rows together are those of a batch over all events. A slot's rows are dealt to
``shares`` keys, so that one busy slot is no single task; the final rows of a slot's shares are added up by readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How far events may lie before the newest one. Spark drops (and counts in the stream's progress) those beyond.
KEEP = "3650 days"
FINAL, LATE = "final", "late"
EMITTED = "kind string, slot_start timestamp, n long, n_values long, total double, ts timestamp"
STATE = "n long, n_values long, total double"


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta(milliseconds=1))


def slot_start(every: str) -> Column:
    return F.window("ts", every)["start"]


def tier_stream(events: DataFrame, every: str, delay: str, shares: int = 16, keep: str = KEEP) -> DataFrame:
    """The stream of final slots and late rows of ``events`` (ts, value). Rows without a time are in no slot."""
    length, kept = milliseconds(every), milliseconds(keep)

    def slot(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = pd.Timestamp(key[0])
        # the stream's own watermark lies ``keep`` further back than the one that closes slots
        closes = start.tz_localize("UTC").value // 1_000_000 + length - kept if start.tz is None else start.value // 1_000_000 + length - kept
        watermark = state.getCurrentWatermarkMs()
        due = 0 < watermark and watermark >= closes
        n, n_values, total = state.get if state.exists else (0, 0, 0.0)
        if state.hasTimedOut or (due and state.exists):
            yield pd.DataFrame({"kind": [FINAL], "slot_start": [start], "n": [n], "n_values": [n_values], "total": [total], "ts": [pd.NaT]})
            state.remove()
        if state.hasTimedOut:
            return
        for part in parts:
            if due:
                values = part["value"]
                yield pd.DataFrame(
                    {"kind": LATE, "slot_start": start, "n": 1, "n_values": values.notna().astype("int64"), "total": values.fillna(0.0), "ts": part["ts"]}
                )
            else:
                n, n_values, total = n + len(part), n_values + int(part["value"].count()), total + float(part["value"].sum())
        if not due:
            state.update((n, n_values, total))
            state.setTimeoutTimestamp(max(closes, watermark + 1))

    rows = events.filter("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    allowed = f"{(milliseconds(delay) + kept) // 1000} seconds"
    share = F.pmod(F.xxhash64("ts", "value"), F.lit(shares)).cast("int")
    rows = rows.withWatermark("ts", allowed).select("ts", "value", slot_start(every).alias("slot_start"), share.alias("share"))
    return rows.groupBy("slot_start", "share").applyInPandasWithState(slot, EMITTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(stream: DataFrame, root: str):
    """Writes what a tier emits, by kind, once each; runs over all that is there."""
    sink = stream.writeStream.format("parquet").partitionBy("kind").outputMode("append")
    return sink.option("path", f"{root}/emitted").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def emitted(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.schema(EMITTED).parquet(f"{root}/emitted").filter(F.col("kind") == kind)


def final_slots(spark: SparkSession, root: str) -> DataFrame:
    """slot_start, n and mean_value as they were when the slot was closed."""
    return _added(emitted(spark, root, FINAL))


def refreshed(spark: SparkSession, root: str) -> DataFrame:
    """The same with the late rows added: what a batch over all events of closed slots gives."""
    return _added(emitted(spark, root, FINAL).unionByName(emitted(spark, root, LATE)))


def _added(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("slot_start").agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"))
    return sums.select("slot_start", "n", F.try_divide("total", "n_values").alias("mean_value"))
