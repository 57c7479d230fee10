"""Keyed state with a lifetime, and deduplication that accounts for late rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vacantia.functions.dates import interval_ms

#: State of these operators lives in RocksDB on the executors and in the query's checkpoint.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENTRY_STATE = "at long, tie string, entry string"


def well_formed_entry(text: str | None) -> str:
    """The entry's JSON object; what is no such object starts empty."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return "{}"
    return text if isinstance(value, dict) else "{}"


class LatestEntry(StatefulProcessor):
    """One value per key: its newest entry. A timer forgets it when the watermark has passed its lifetime."""

    def __init__(self, key: str, lifetime_ms: int):
        self.key, self.lifetime_ms = key, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", ENTRY_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        best = (held[0], held[1], held[2]) if held else None
        for frame in rows:
            for at, tie, entry in zip(frame["at"].tolist(), frame["tie"].tolist(), frame["entry"].tolist(), strict=True):
                if best is None or (at, tie) > best[:2]:
                    best = (at, tie, well_formed_entry(entry))
        if best is None or (held and best[:2] == (held[0], held[1])):
            return
        self.state.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] + self.lifetime_ms)
        yield pd.DataFrame({self.key: [key[0]], "at": [best[0]], "entry": [best[2]], "expired": [False]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({self.key: [key[0]], "at": [at], "entry": ["{}"], "expired": [True]})

    def close(self) -> None:
        pass


def latest_entries(stream: DataFrame, key: str, event_time: str, entry: str, tie: str, *, lifetime: str, delay: str = "1 hour") -> DataFrame:
    """Changed entries (key, at in ms, entry, expired): the newest per key by time and tie.

    `entry` is a JSON object as text; a corrupt one counts as empty. A key whose newest entry is
    older than `lifetime` behind the watermark is reported once as expired and its state removed,
    so state is bounded by the keys that are active within a lifetime.
    """
    session = stream.sparkSession
    session.conf.set(*PROVIDER)
    kind = stream.schema[key].dataType.simpleString()
    time = F.col(event_time).cast("timestamp")
    timed = stream.select(F.col(key), time.alias("event_time"), F.unix_millis(time).alias("at"), F.col(tie).cast("string").alias("tie"), F.col(entry).alias("entry"))
    grouped = timed.withWatermark("event_time", delay).groupBy(key)
    processor = LatestEntry(key, interval_ms(session, lifetime))
    return grouped.transformWithStateInPandas(processor, f"{key} {kind}, at long, entry string, expired boolean", "Update", "EventTime")


#: Buckets of keys; a bucket's keys are held and judged together. A checkpoint keeps the number it began with.
BUCKETS = 1_024
HELD = pa.schema([("key", pa.string()), ("at", pa.int64()), ("arrived", pa.int64())])


def _held_bytes(key: Any, at: np.ndarray, arrived: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_table(pa.table([pa.array(key, pa.string()), pa.array(at), pa.array(arrived)], schema=HELD))
    return sink.getvalue().to_pybytes()


def _held_keys(value: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the newest time of each and when its last row arrived."""
    table = pa.ipc.open_stream(value).read_all() if value else HELD.empty_table()
    return table.column("key").to_numpy(), table.column("at").to_numpy(), table.column("arrived").to_numpy()


class FirstRepeatLate(StatefulProcessor):
    """Per key the newest time seen: tells first rows, repeats within the delay, and rows that come too late.

    The state of a bucket is one value with all its keys, read and written once a batch, so a
    batch costs a few calls a bucket and not a few calls a key. A timer on the time of arrival
    forgets the keys that have had no rows for a while.
    """

    def __init__(self, delay_ms: int, kept_ms: int):
        self.delay_ms, self.kept_ms = delay_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "held binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True)
        value = self.state.get() if self.state.exists() else None
        keys, newest, arrived = _held_keys(value[0] if value else None)
        codes, every = pd.factorize(np.concatenate((keys, frame["row_key"].to_numpy(object))))
        frame["row_code"] = codes[len(keys) :]
        frame = frame.sort_values(["row_code", "row_time", "row_tie"], kind="stable")
        code, at = frame["row_code"].to_numpy(), frame["row_time"].to_numpy(np.int64)
        none = np.iinfo(np.int64).min
        newest, arrived = (np.concatenate((x, np.full(len(every) - len(keys), none))) for x in (newest, arrived))
        before = newest[code]
        same = code[1:] == code[:-1]
        before[1:] = np.where(same, np.maximum(before[1:], at[:-1]), before[1:])
        known = before > none
        late = known & (at < before - self.delay_ms)
        first = ~known | (at > before + self.delay_ms)
        frame["row_kind"] = np.where(late, "late", np.where(first, "first", "repeat"))
        np.maximum.at(newest, code, at)
        now = int(frame["row_arrived"].max().timestamp() * 1000)
        arrived[code] = now
        self.state.update((_held_bytes(every, newest, arrived),))
        if value is None:
            self.handle.registerTimer(now + self.kept_ms)
        yield frame.drop(columns=["row_bucket", "row_key", "row_code", "row_time", "row_tie", "row_arrived"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        keys, newest, arrived = _held_keys(self.state.get()[0])
        stays = arrived + self.kept_ms > timerValues.getCurrentWatermarkInMs()
        if stays.any():
            self.state.update((_held_bytes(keys[stays], newest[stays], arrived[stays]),))
            self.handle.registerTimer(int(arrived[stays].min()) + self.kept_ms)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _key_text(stream: DataFrame, keys: Sequence[str]) -> Column:
    """A text that is the same for equal keys only; nulls are a key like others."""
    parts = []
    for name in keys:
        kind, value = stream.schema[name].dataType, F.col(name)
        text = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def kinds_of_rows(
    stream: DataFrame, keys: Sequence[str], event_time: str, tie: str, *, delay: str, kept: str = "30 days", buckets: int = BUCKETS
) -> DataFrame:
    """All rows with `row_kind`: first, repeat or late.

    Rows of a key are taken batch by batch and in a batch by time and tie. A row is late if it is
    more than `delay` older than the newest one of its key so far; it is a repeat if it is within
    `delay` of that, and a first one otherwise. Nothing is dropped: no watermark decides, so every
    row that comes in goes out (the watermark is on the time of arrival, behind which nothing
    comes). A key's state is removed when the stream has gone on for `kept` without rows of it.
    Keys are dealt over `buckets` by their hash; more of them hold the state of more keys.
    """
    session = stream.sparkSession
    session.conf.set(*PROVIDER)
    timed = stream.withColumns({"row_time": F.unix_millis(F.col(event_time).cast("timestamp")), "row_tie": F.col(tie), "row_arrived": F.current_timestamp(), "row_key": _key_text(stream, keys)})
    timed = timed.withColumn("row_bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets))).withWatermark("row_arrived", "0 seconds")
    schema = T.StructType([*stream.schema.fields, T.StructField("row_kind", T.StringType())])
    processor = FirstRepeatLate(interval_ms(session, delay), interval_ms(session, kept))
    return timed.groupBy("row_bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def split_late(kinds: DataFrame, first: str, late: str, counts: str, checkpoint: str, **trigger) -> StreamingQuery:
    """First rows to one table, late rows to another, and each batch's numbers of rows to a third.

    A batch that is run again overwrites what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind, path in (("first", first), ("late", late)):
            batch.filter(F.col("row_kind") == kind).drop("row_kind").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.groupBy("row_kind").count().withColumnRenamed("row_kind", "kind").write.mode("overwrite").json(f"{counts}/batch_id={batch_id}")
        batch.unpersist()

    return kinds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
