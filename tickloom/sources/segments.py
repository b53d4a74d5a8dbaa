"""Sealed tick segments: a Parquet store with pruned range replay, and the fixed binary layout as a Python data source ("tickseg").

Binary segment, little-endian: magic, version u32 = 1, columns u32 = 3, rows u64, three offsets u64, three minima f64, three maxima f64, three column CRC-32s,
header CRC-32 (with its own field as 0), zeros up to 192, then the columns price, volume and time as f64.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tickloom.ticks import ORDER

MAGIC, VERSION, COLUMNS, HEADER = b"TICKSEG1", 1, 3, 192
LAYOUT = struct.Struct("<8sIIQ3Q3d3d3I I".replace(" ", ""))
FLAT_MAGIC = b"TICKFLT1"
SUFFIX = ".tickseg"
LOG = "appends.log"
SCHEMA = "price double, volume double, ts_ns double"


class SegmentError(ValueError):
    pass


def check_order(ts: np.ndarray) -> None:
    if not np.isfinite(ts).all() or (np.diff(ts) < 0).any():
        raise SegmentError("times must be finite and never fall")


def bounds(x: np.ndarray) -> tuple[float, float]:
    """Smallest and largest, NaN ignored; NaN of nothing."""
    x = x[~np.isnan(x)]
    return (float(x.min()), float(x.max())) if len(x) else (float("nan"), float("nan"))


def pack(price: np.ndarray, volume: np.ndarray, ts: np.ndarray) -> bytes:
    columns = [np.ascontiguousarray(x, "<f8") for x in (price, volume, ts)]
    n = len(columns[0])
    if any(len(x) != n for x in columns):
        raise SegmentError("columns differ in length")
    check_order(columns[2])
    offsets = [HEADER + 8 * n * i for i in range(COLUMNS)]
    low, high = zip(*map(bounds, columns), strict=True)
    raw = [x.tobytes() for x in columns]
    fields = [MAGIC, VERSION, COLUMNS, n, *offsets, *low, *high, *map(zlib.crc32, raw)]
    blank = LAYOUT.pack(*fields, 0).ljust(HEADER, b"\0")
    return LAYOUT.pack(*fields, zlib.crc32(blank)).ljust(HEADER, b"\0") + b"".join(raw)


def header(data: bytes) -> dict:
    """The header's fields, validated."""
    if len(data) < HEADER:
        raise SegmentError("too short for a header")
    magic, version, columns, n, *rest = LAYOUT.unpack(data[: LAYOUT.size])
    if magic != MAGIC or version != VERSION or columns != COLUMNS:
        raise SegmentError("not a segment of this version")
    blank = data[: LAYOUT.size - 4] + bytes(4) + data[LAYOUT.size : HEADER]
    if zlib.crc32(blank) != rest[-1]:
        raise SegmentError("the header is damaged")
    if list(rest[:3]) != [HEADER + 8 * n * i for i in range(COLUMNS)]:
        raise SegmentError("offsets are out of place")
    return {"n": n, "min": rest[3:6], "max": rest[6:9], "crc": rest[9:12]}


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """price, volume and time of a whole segment; raises SegmentError on any damage."""
    h = header(data)
    if len(data) != HEADER + 8 * COLUMNS * h["n"]:
        raise SegmentError("the length doesn't fit the header")
    out = []
    for i in range(COLUMNS):
        raw = data[HEADER + 8 * h["n"] * i : HEADER + 8 * h["n"] * (i + 1)]
        if zlib.crc32(raw) != h["crc"][i]:
            raise SegmentError(f"column {i} is damaged")
        out.append(np.frombuffer(raw, "<f8"))
    check_order(out[2])
    return tuple(out)


def seal(path: str, data: bytes) -> None:
    """Write aside, sync, rename, sync the folder: a reader sees all of a file or none."""
    with open(f"{path}.partial", "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.rename(f"{path}.partial", path)
    folder = os.open(os.path.dirname(path) or ".", os.O_RDONLY)
    os.fsync(folder)
    os.close(folder)


def note(folder: str, state: str, name: str) -> None:
    """Append a line to the folder's log and sync it: a name is noted as begun before its file is written, and as done afterwards."""
    with open(os.path.join(folder, LOG), "ab") as f:
        f.write(json.dumps({"state": state, "name": name}).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def noted(folder: str) -> dict[str, str]:
    """The last state of each name in the log; a torn line ends the log, no log is an empty one."""
    states: dict[str, str] = {}
    path = os.path.join(folder, LOG)
    if not os.path.exists(path):
        return states
    with open(path, "rb") as f:
        for line in f:
            try:
                record = json.loads(line)
            except ValueError:
                break
            if not line.endswith(b"\n"):
                break
            states[record["name"]] = record["state"]
    return states


_appended = itertools.count()


def append_segment(folder: str, price, volume, ts, name: str = "") -> str:
    """Seal the columns as a segment of the folder, with its begin and end in the log; returns its path. A name that exists already is replaced."""
    folder = local(folder)
    os.makedirs(folder, exist_ok=True)
    name = name or f"segment-{time.time_ns()}-{next(_appended)}{SUFFIX}"
    data = pack(price, volume, ts)
    note(folder, "begun", name)
    seal(os.path.join(folder, name), data)
    note(folder, "done", name)
    return os.path.join(folder, name)


def recover(folder: str, unlogged: bool = True) -> int:
    """Delete what unfinished writes left behind; returns how many files went.

    These are the partial files of names that the log has as begun and not done and, unless `unlogged` is false (another job may be writing), those the log doesn't name.
    """
    states, gone = noted(folder), 0
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        state = states.get(name.removesuffix(".partial"))
        if name.endswith(".partial") and (state == "begun" or (state is None and unlogged)):
            os.remove(os.path.join(folder, name))
            gone += 1
    return gone


def local(path: str) -> str:
    return path.removeprefix("file://")


def list_segments(folder: str) -> list[str]:
    folder = local(folder)
    return sorted(os.path.join(folder, x) for x in os.listdir(folder) if x.endswith(SUFFIX))


def save_flat(path: str, price, volume, ts) -> int:
    """The flat table: magic, rows, three columns; returns the bytes written."""
    data = FLAT_MAGIC + struct.pack("<Q", len(price)) + b"".join(np.ascontiguousarray(x, "<f8").tobytes() for x in (price, volume, ts))
    with open(path, "wb") as f:
        return f.write(data)


def load_flat(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with open(path, "rb") as f:
        data = f.read()
    if data[:8] != FLAT_MAGIC or len(data) < 16:
        raise SegmentError("not a flat table")
    n = struct.unpack("<Q", data[8:16])[0]
    if len(data) < 16 + 24 * n:
        raise SegmentError("the flat table is cut short")
    return tuple(np.frombuffer(data[16 + 8 * n * i : 16 + 8 * n * (i + 1)], "<f8") for i in range(3))


class SegmentPartition(InputPartition):
    def __init__(self, path: str, low: float, high: float):
        self.path, self.low, self.high = path, low, high


class SegmentReader(DataSourceReader):
    """One partition a file. Time bounds skip files by their header and rows by binary search."""

    def __init__(self, path: str, flat: bool, batch: int, low: float, high: float):
        self.path, self.flat, self.batch, self.low, self.high = local(path), flat, batch, low, high

    def partitions(self):
        if os.path.isfile(self.path):
            paths = [self.path]
        elif self.flat:
            paths = sorted(os.path.join(self.path, x) for x in os.listdir(self.path))
        else:
            paths = list_segments(self.path)
        kept = []
        for p in paths:
            if not self.flat:
                with open(p, "rb") as f:
                    h = header(f.read(HEADER))
                if not h["n"] or h["max"][2] < self.low or h["min"][2] > self.high:
                    continue
            kept.append(SegmentPartition(p, self.low, self.high))
        return kept or [SegmentPartition("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        if self.flat:
            columns = load_flat(partition.path)
        else:
            with open(partition.path, "rb") as f:
                columns = unpack(f.read())
        first, last = 0, len(columns[2])
        if not self.flat:
            first, last = int(np.searchsorted(columns[2], partition.low, "left")), int(np.searchsorted(columns[2], partition.high, "right"))
        for i in range(first, last, self.batch):
            end = min(i + self.batch, last)
            yield pa.RecordBatch.from_arrays([pa.array(c[i:end]) for c in columns], names=["price", "volume", "ts_ns"])


class Written(WriterCommitMessage):
    def __init__(self, partial: str | None, final: str | None):
        self.partial, self.final = partial, final


class SegmentWriter(DataSourceWriter):
    """A file a task, written aside; all are renamed when the job commits and deleted when it fails."""

    def __init__(self, path: str):
        self.path = local(path)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        table = [(r["price"], r["volume"], r["ts_ns"]) for r in rows]
        if not table:
            return Written(None, None)
        os.makedirs(self.path, exist_ok=True)
        columns = np.array(table, float).T
        name = os.path.join(self.path, f"segment-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}{SUFFIX}")
        with open(f"{name}.partial", "wb") as f:
            f.write(pack(*columns))
            f.flush()
            os.fsync(f.fileno())
        return Written(f"{name}.partial", name)

    def commit(self, messages) -> None:
        for m in messages:
            if m and m.final:
                os.rename(m.partial, m.final)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.partial:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(m.partial)


class SegmentSource(DataSource):
    """Options: path (a file or folder on storage that all executors mount), flat ("true": flat tables), batch (rows of a batch, 4096), from and to (inclusive time bounds).

    Bounds are options, not pushed filters: Spark 4.1 keeps a Python reader with the filters of an earlier query on the same DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "tickseg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options["path"], self.options.get("flat", "false").lower() == "true", int(self.options.get("batch", 4096)), float(self.options.get("from", "-inf")), float(self.options.get("to", "inf")))

    def writer(self, schema, overwrite) -> SegmentWriter:
        return SegmentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)


def replay_range(spark: SparkSession, path: str, first: float, last: float, batch: int = 4096) -> DataFrame:
    """Rows of the binary segments in path with first <= ts_ns <= last; files outside aren't read beyond their headers."""
    register(spark)
    return spark.read.format("tickseg").options(path=path, batch=batch, **{"from": first, "to": last}).load()


def paced_batches(path: str, first: float = float("-inf"), last: float = float("inf"), rate: float = 0.0, batch: int = 4096, sleep: Callable[[float], None] = time.sleep) -> Iterator[pa.RecordBatch]:
    """Hand out the rows within both bounds in batches that never cross files, at most `rate` rows a second since the start if above 0. One file is open at a time."""
    reader, began, sent = SegmentReader(path, False, batch, first, last), time.monotonic(), 0
    for partition in reader.partitions():
        for rows in reader.read(partition):
            sent += rows.num_rows
            if rate > 0 and (wait := sent / rate - (time.monotonic() - began)) > 0:
                sleep(wait)
            yield rows


class TickStore:
    """Segments as Parquet: each append writes files sorted by time, with footer bounds that prune range scans."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, ticks: DataFrame, files: int | None = None) -> None:
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ticks.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def range(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Ticks within both bounds, inclusive; the bounds reach the scan."""
        return time_range(self.read(), first, last)

    def inspect(self) -> DataFrame:
        """Rows and time bounds per file, and of all (file null)."""
        x = self.read().select(F.col("_metadata.file_name").alias("file"), "ts_ns")
        return x.rollup("file").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


def time_range(ticks: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        ticks = ticks.where(F.col("ts_ns") >= first)
    return ticks if last is None else ticks.where(F.col("ts_ns") <= last)


def replay_batches(ticks: DataFrame, size: int = 4096) -> DataFrame:
    """Numbers (from 0) of each instrument's batches of `size` ticks in order, and bounds: what a replay hands out at once."""
    from tickloom.operators.windows import row_numbers

    x = row_numbers(ticks).withColumn("batch", F.floor(F.col("rn") / size))
    return x.groupBy("instrument", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"), F.sum("price").alias("price_sum"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """close,volume lines without a header; unreadable lines go, a missing volume is 0."""
    rows = spark.read.csv(path, schema="close double, volume double", mode="PERMISSIVE")
    return rows.where(F.col("close").isNotNull()).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def read_tick_csv(spark: SparkSession, path: str) -> DataFrame:
    """price,volume,ts lines without a header, ts a whole number of nanoseconds; lines that lack one of the three or hold no number there go."""
    rows = spark.read.csv(path, schema="price double, volume double, ts_ns bigint", mode="PERMISSIVE")
    return rows.where(F.col("price").isNotNull() & F.col("volume").isNotNull() & F.col("ts_ns").isNotNull())


CHART = "symbol string, timestamp array<bigint>, close array<double>, volume array<double>"


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """Provider charts (one JSON object an instrument, columns as arrays) as ticks: times in seconds, a null close drops its place, a null volume counts as 0."""
    rows = spark.read.schema(CHART).json(path).select("symbol", F.explode(F.arrays_zip("timestamp", "close", "volume")).alias("c"))
    whole = rows.where(F.col("c.close").isNotNull() & F.col("c.timestamp").isNotNull())
    return whole.select(F.col("symbol").alias("instrument"), F.col("c.timestamp").alias("ord"), (F.col("c.timestamp") * 1_000_000_000).alias("ts_ns"), F.col("c.close").alias("price"), F.coalesce("c.volume", F.lit(0.0)).alias("volume"))
