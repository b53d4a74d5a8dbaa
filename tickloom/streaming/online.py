"""Ticks as streams: the online mean with state per instrument, whole-batch plans per micro-batch, and a feed of 32-byte frames over TCP."""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tickloom.lineage import saved

FRAME = struct.Struct("<QddQ")
FRAME_SCHEMA = "ts_ns bigint, price double, volume double, sequence bigint"
MEAN_SCHEMA = "instrument string, ord bigint, ts_ns bigint, mean double"


class OnlineMean(StatefulProcessor):
    """The last `window` prices of an instrument as state; each tick gives their mean. Ticks of a micro-batch are taken in order."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_ns", "ord"])
        held = [r[0] for r in self.recent.get()]
        prices = held + batch["price"].tolist()
        means = [sum(x) / len(x) for x in (prices[max(0, i + 1 - self.window) : i + 1] for i in range(len(held), len(prices)))]
        self.recent.put([(p,) for p in prices[-self.window :]])
        yield pd.DataFrame({"instrument": key[0], "ord": batch["ord"].to_numpy(), "ts_ns": batch["ts_ns"].to_numpy(), "mean": means})

    def close(self) -> None:
        pass


def online_mean_stream(ticks: DataFrame, window: int = 100) -> DataFrame:
    """A streaming DataFrame of ticks to the mean of each instrument's last ticks; needs the RocksDB state store."""
    return ticks.groupBy("instrument").transformWithStateInPandas(OnlineMean(window), MEAN_SCHEMA, "append", "none")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def each_batch(ticks: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan on every micro-batch and append its rows with the batch's number; state begins anew with each."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).withColumn("batch_id", F.lit(number)).write.mode("append").parquet(target)

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sequence_gaps(frames: DataFrame) -> DataFrame:
    """Frames whose sequence doesn't follow the one before, and how many are missing."""
    before = F.lag("sequence").over(W.partitionBy("instrument").orderBy("sequence"))
    return frames.withColumn("missing", F.col("sequence") - before - 1).where(F.col("missing") != 0)


#: Steps of a block of queue_depths.
BLOCK = 64
_TRACE = "channel string, at bigint, op string"


def queue_depths(steps: np.ndarray, capacity: int, starts: tuple[int, ...]) -> list[np.ndarray]:
    """Depth after each step (1: push, -1: pop) of a queue that drops, for each depth at the start.

    From depth y, some steps lead to min(high, max(low, y + their sum)), where low and high are what they make of the empty and of the full queue. So all blocks of
    BLOCK steps are followed side by side, and only their ends one after the other.
    """
    n, size = len(steps), max(1, min(BLOCK, len(steps)))
    padded = np.zeros(-(-n // size) * size, np.int64)
    padded[:n] = steps
    columns = np.ascontiguousarray(padded.reshape(-1, size).T)
    low, high, moved = np.empty_like(columns), np.empty_like(columns), columns.cumsum(0)
    empty, full = np.zeros(columns.shape[1], np.int64), np.full(columns.shape[1], capacity)
    for k, step in enumerate(columns):
        low[k] = empty = np.clip(empty + step, 0, capacity)
        high[k] = full = np.clip(full + step, 0, capacity)
    ends, out = [x[-1].tolist() for x in (moved, low, high)], []
    for y in starts:
        begun = []
        for d, bottom, top in zip(*ends, strict=True):
            begun.append(y)
            y = min(top, max(bottom, y + d))
        out.append(np.minimum(high, np.maximum(low, np.array(begun, np.int64) + moved)).T.ravel()[:n])
    return out


def _pieces(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the sorted rows of a partition: what the channel's steps before each row, in this partition, make of a depth y: min(_tl_high, max(_tl_low, y + _tl_sum)).

    _tl_n is the row's place among them. Only the last row's figures are carried from one Arrow batch to the next.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, n, total, low, high = None, 0, 0, 0, capacity
        for rows in batches:
            if not rows.num_rows:
                continue
            steps = np.where(pc.fill_null(pc.equal(rows["op"], "push"), False).to_numpy(zero_copy_only=False), 1, -1)
            names = rows["channel"].dictionary_encode()
            codes = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            found = []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                name = rows["channel"][begin].as_py()
                if name != channel:
                    channel, n, total, low, high = name, 0, 0, 0, capacity
                part = steps[begin:end]
                lows, highs = queue_depths(part, capacity, (low, high))
                sums = total + part.cumsum()
                found.append((*[np.concatenate([[x], xs[:-1]]) for x, xs in ((total, sums), (low, lows), (high, highs))], n + np.arange(len(part))))
                n, total, low, high = n + len(part), int(sums[-1]), int(lows[-1]), int(highs[-1])
            figures = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *figures], [*rows.schema.names, "_tl_sum", "_tl_low", "_tl_high", "_tl_n"])

    return scan


def bounded_channel(trace: DataFrame, capacity: int) -> DataFrame:
    """A bounded queue that drops the newest, replayed over a trace (channel, at, op: push or pop; at is unique in a channel): ok for a push that is accepted and a pop that finds something, and depth after it.

    Rows are dealt by ranges of (channel, at) and written with what the steps before them in their range make of any depth; the depth at a range's begin follows
    from the ranges before it, one row each, and is 0 for a channel that begins there.
    """
    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(capacity, 0)
    rows = trace.select(F.col("channel").cast("string").alias("channel"), F.col("at").cast("bigint").alias("at"), F.col("op").cast("string").alias("op"))
    dealt = rows.repartitionByRange(n, "channel", "at").sortWithinPartitions("channel", "at").withColumn("_tl_part", F.spark_partition_id())
    pieces = saved(dealt.mapInArrow(_pieces(most), f"{_TRACE}, _tl_part int, _tl_sum bigint, _tl_low bigint, _tl_high bigint, _tl_n bigint"), "channels")
    step = F.when(F.col("op") == "push", 1).otherwise(-1)
    within = lambda low, x, high: F.least(high, F.greatest(low, x))
    after = lambda c: within(F.lit(0), F.col(c) + step, F.lit(most)).cast("long")
    last = F.max_by(F.struct((F.col("_tl_sum") + step).cast("long").alias("d"), after("_tl_low").alias("low"), after("_tl_high").alias("high")), "_tl_n").alias("_tl_end")
    before = W.partitionBy("channel").orderBy("_tl_part").rowsBetween(W.unboundedPreceding, -1)
    ends = pieces.groupBy("channel", "_tl_part").agg(last).withColumn("_tl_ends", F.collect_list("_tl_end").over(before))
    start = F.aggregate("_tl_ends", F.lit(0).cast("long"), lambda y, end: within(end["low"], y + end["d"], end["high"]))
    # A range holds one channel at most that began in an earlier one, so these rows are fewer than the ranges.
    starts = ends.select(F.col("channel").alias("_tl_c"), F.col("_tl_part").alias("_tl_p"), start.alias("_tl_start")).where("_tl_start > 0")
    x = pieces.join(F.broadcast(starts), F.col("channel").eqNullSafe(F.col("_tl_c")) & (F.col("_tl_part") == F.col("_tl_p")), "left")
    x = x.withColumn("_tl_old", within(F.col("_tl_low"), F.coalesce("_tl_start", F.lit(0)) + F.col("_tl_sum"), F.col("_tl_high")))
    ok = F.when(F.col("op") == "push", F.col("_tl_old") < most).otherwise(F.col("_tl_old") > 0)
    return x.select("channel", "at", "op", ok.alias("ok"), after("_tl_old").alias("depth"))


def blocking_channel(trace: DataFrame, capacity: int) -> DataFrame:
    """A bounded queue whose pushes wait while it is full, over a trace as for bounded_channel (at is unique in a channel).

    ok: a push is taken at once, a pop finds something. depth is what the queue holds after the event, waiting the pushes held back. Both follow from the
    level of a queue without bound, which is the running sum of the steps less its lowest value below 0.
    """
    over = W.partitionBy("channel").orderBy("at")
    push = F.col("op") == "push"
    x = trace.withColumn("_sum", F.sum(F.when(push, 1).otherwise(-1)).over(over.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("_level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(over.rowsBetween(W.unboundedPreceding, 0))))
    ok = F.when(push, F.col("_level") <= capacity).otherwise(F.lag("_level", 1, 0).over(over) > 0)
    return x.select("channel", "at", "op", ok.alias("ok"), F.least("_level", F.lit(capacity)).cast("long").alias("depth"), F.greatest(F.col("_level") - capacity, F.lit(0)).cast("long").alias("waiting"))


def channel_counters(replayed: DataFrame) -> DataFrame:
    """Per channel of a replayed trace: pushes accepted at once and refused (dropped, or made to wait), the depth at the end and the largest one."""
    push = F.col("op") == "push"
    counts = [F.count_if(push & F.col("ok")).alias("accepted"), F.count_if(push & ~F.col("ok")).alias("refused")]
    return replayed.groupBy("channel").agg(*counts, F.max_by("depth", "at").alias("depth"), F.max("depth").alias("most"))


def pack_frames(rows) -> bytes:
    return b"".join(FRAME.pack(max(0, int(ts)), float(p), float(v), int(s)) for ts, p, v, s in rows)


def unpack_frames(data: bytes) -> tuple[list[tuple], bytes]:
    """Whole frames, and the bytes of a frame that isn't complete yet."""
    whole = len(data) - len(data) % FRAME.size
    return [FRAME.unpack_from(data, i) for i in range(0, whole, FRAME.size)], data[whole:]


def serve(ticks: DataFrame, port: int, rate: float = 0.0, batch: int = 1024, ready: Callable[[int], None] | None = None) -> int:
    """Send all ticks in order to one client on this host, numbered from 0, at most `rate` frames a second if above 0; returns the frames sent. Rows come one partition at a time."""
    if rate < 0:
        raise ValueError("a rate can't be negative")
    rows = ticks.select("ts_ns", "price", "volume").orderBy("ts_ns", *[c for c in ("ord",) if c in ticks.columns])
    with socket.create_server(("127.0.0.1", port)) as server:
        if ready:
            ready(server.getsockname()[1])
        client, _ = server.accept()
        with client:
            sent, held, began = 0, [], time.monotonic()
            for r in rows.toLocalIterator(prefetchPartitions=True):
                held.append((r["ts_ns"], r["price"], r["volume"], sent + len(held)))
                if len(held) == batch:
                    client.sendall(pack_frames(held))
                    sent, held = sent + len(held), []
                    if rate and (wait := sent / rate - (time.monotonic() - began)) > 0:
                        time.sleep(wait)
            client.sendall(pack_frames(held))
            return sent + len(held)


class FeedReader(SimpleDataSourceStreamReader):
    """Frames of one connection; the offset counts frames, and frames not yet committed are kept for replay.

    copied counts the bytes received, the whole frames in them, and the times that a frame's first part was carried over to its rest.
    """

    def __init__(self, host: str, port: int, most: int):
        self.host, self.port, self.most = host, port, most
        self.connection, self.carry, self.start, self.kept = None, b"", 0, []
        self.copied = {"bytes": 0, "frames": 0, "split_frames": 0}

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def read(self, start: dict):
        if self.connection is None:
            self.connection = socket.create_connection((self.host, self.port), timeout=10)
            self.connection.settimeout(0.5)
        rows: list[tuple] = []
        try:
            while len(rows) < self.most and (data := self.connection.recv(FRAME.size * self.most)):
                got, self.carry = unpack_frames(self.carry + data)
                for key, n in (("bytes", len(data)), ("frames", len(got)), ("split_frames", bool(self.carry))):
                    self.copied[key] += n
                rows += got
        except TimeoutError:
            pass
        self.kept += rows
        return iter(rows), {"frames": start["frames"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.kept[start["frames"] - self.start : end["frames"] - self.start])

    def commit(self, end: dict) -> None:
        self.kept = self.kept[max(0, end["frames"] - self.start) :]
        self.start = max(self.start, end["frames"])


class FeedSource(DataSource):
    """Options: host, port, batch (frames of a micro-batch, 1024)."""

    @classmethod
    def name(cls) -> str:
        return "tickfeed"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(self.options.get("host", "127.0.0.1"), int(self.options["port"]), int(self.options.get("batch", 1024)))
