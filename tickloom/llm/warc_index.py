"""WARC archives, index first: the writer notes offset, length, URL and digest of every record, readers fetch selected records by coalesced byte ranges.

Each record is a gzip member of its own. Of pages with equal payloads of at least min_bytes, the one with the smallest page_id is a
response and the others are revisit records that refer to it; smaller payloads are always responses. Record ids are
urn:tickloom:page:<page_id>, so a record read back names its page and the page it refers to.

Edge cases: null html is an empty payload, null url an absent target header; rows that repeat the smallest page_id of a group are all responses; null page_id is
last in its group; very long pages are single records; empty tables give no archives; extra columns are ignored. A damaged record raises.

Scale: digests are grouped without the pages; only the rows that become revisits are joined to pages, by page_id and SHA-1. Tasks stream records to
files of about FILE_BYTES and the index to a table. Reading groups a file's ranges, sorted by offset, into reads of at most READ_BYTES
with gaps of at most GAP_BYTES, dealt over all tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.shared import attach_groups, lean, open_folder, saved, scratch, text_of

FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
LEVEL = 3
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
URN = "urn:tickloom:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str) -> str:
    """A header's value on one line: controls and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None = None, refers_url: str | None = None, revisit: bool = False) -> bytes:
    """One record, not yet compressed."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {header_text(url)}"] if url is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{URN}{'' if refers_to is None else refers_to}>",
            *([f"WARC-Refers-To-Target-URI: {header_text(refers_url)}"] if refers_url is not None else []),
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and the payload under the HTTP head of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def packed(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def writer(folder: str, date: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        out, name, at, seq, rows = None, "", 0, 0, []

        def close() -> None:
            out.close()
            system.move(f"{path}/.{name}.partial", f"{path}/{name}")

        for batch in batches:
            for page in batch.to_pylist():
                if out is None:
                    name = f"pages-{task.partitionId():05d}-{seq:04d}-{task.taskAttemptId()}.warc.gz"
                    out = system.open_output_stream(f"{path}/.{name}.partial", compression=None)
                    info = b"software: tickloom\r\nformat: WARC File Format 1.1\r\n"
                    first = packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:tickloom:file:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    out.write(first)
                    at, seq = len(first), seq + 1
                payload = (page["html"] or "").encode()
                data = packed(record(page["page_id"], page["url"], payload, date, page["refers_to"], page["refers_url"], page["revisit"]))
                out.write(data)
                rows.append((name, at, len(data), page["url"], base32_sha1(payload), page["page_id"], "revisit" if page["revisit"] else "response"))
                at += len(data)
                if at >= FILE_BYTES:
                    close()
                    out = None
            if rows:
                yield index_batch(rows)
                rows = []
        if out is not None:
            close()

    return write


def index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, SHA-1 of the payload, refers_to and refers_url of the pages whose payload an earlier page has."""
    html = text_of("html")
    keys = saved(pages.select("page_id", "url", F.sha1(html).alias("sha1"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes), "warc-keys")
    rank = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url"))
    groups = keys.groupBy("sha1").agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("first")).where("copies > 1")
    groups = saved(groups, "warc-groups")
    x = attach_groups(keys, groups, "sha1", "copies", keys.count()).where(F.col("_group").isNotNull())
    first = F.col("_group.first")
    again = x.where(~F.col("page_id").eqNullSafe(first["page_id"]))
    return saved(again.select(F.col("page_id").alias("_page_id"), F.col("sha1").alias("_sha1"), first["page_id"].alias("refers_to"), first["url"].alias("refers_url")).distinct(), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; returns the index, a written table."""
    rows = lean(pages).select(F.col("page_id").cast("long"), "url", "html")
    again = revisits(rows, min_bytes)
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.sha1(text_of("html")) == F.col("_sha1"))
    marked = rows.join(again, same, "left")
    long_enough = F.octet_length(text_of("html")) >= min_bytes
    marked = marked.select("page_id", "url", "html", "refers_to", "refers_url", (F.col("refers_to").isNotNull() & long_enough).alias("revisit"))
    return saved(marked.mapInArrow(writer(folder, date), INDEX), "warc-index")


def plan_reads(selected: DataFrame) -> DataFrame:
    """file, at, size and ranges (offset, length in order) of coalesced reads of the selected index rows."""
    order = W.partitionBy("file").orderBy("offset")
    end = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    x = selected.select("file", "offset", "length").distinct()
    x = x.withColumn("new", (F.coalesce(F.col("offset") - end, F.lit(GAP_BYTES + 1)) > GAP_BYTES).cast("int"))
    x = x.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("piece", F.floor(F.col("offset") / READ_BYTES))
    return x.groupBy("file", "run", "piece").agg(
        F.min("offset").alias("at"),
        (F.max(F.col("offset") + F.col("length")) - F.min("offset")).alias("size"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"),
    )


def reader(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for one in batch.to_pylist():
                with system.open_input_file(f"{path}/{one['file']}") as f:
                    data = f.read_at(one["size"], one["at"])
                rows = []
                for r in one["ranges"]:
                    at = r["offset"] - one["at"]
                    fields, payload = parse_record(zlib.decompress(data[at : at + r["length"]], 31))
                    digest, again = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                    if not again and base32_sha1(payload) != digest:
                        raise ValueError(f"record at {r['offset']} of {one['file']} doesn't match its digest")
                    page, refers = (fields.get(k, "")[len(URN) + 1 : -1] for k in ("warc-record-id", "warc-refers-to"))
                    rows.append((int(page) if page else None, int(fields["x-payload-length"]), digest, fields["warc-type"], int(refers) if refers else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return read


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows, read back from the archives and verified."""
    # Rows of the plan are few bytes for much work: a set number of partitions, so that they aren't coalesced by size.
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reads = plan_reads(selected).repartition(n, "file", "run", "piece")
    return reads.select("file", "at", "size", "ranges").mapInArrow(reader(folder), RECORD)


def op4_warc_archive(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch(spark, "warc")
    return read_records(write_archives(pages, folder, min_bytes=0), folder)
