"""Exact dedup over a sharded cuckoo-filter index of live digests.

A text's key is the SHA-256 of what is left after deleting spaces (\\x20 and \\x09 to \\x0D). Digests are dealt to shards by their hash; each shard
keeps a cuckoo filter (4 slots of 16-bit fingerprints a bucket, two buckets a key) over its live keys. A filter miss proves a digest new; a
hit is verified against the keys stored in the digest's bucket, so false positives do no harm. Deleting the last copy of a key frees its
fingerprint. When a bucket pair overflows, the filter doubles and is refilled from the stored keys.

Edge cases: null text counts as empty, and empty texts are equal to each other; of equal texts the one with the most code points, then the
smallest doc_id (null last) stays; rows that repeat a doc_id with an equal text of equal length can't be told apart and share one verdict; an
empty table gives no rows; extra columns are ignored.

Scale: every map task first folds its own rows through an index of bounded size, so a hot digest reaches its shard as one row a task. Groups
of several copies go back to their rows by attach_groups, which never deals a hot digest's rows to one task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import ROW, SPACES, attach_groups, lean, saved, text_of

SLOTS = 4
KICKS = 200
ENTRY = "digest binary, copies bigint, keep_chars bigint, keep_id bigint"
ARROW_ENTRY = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("keep_chars", pa.int64()), ("keep_id", pa.int64())])


class CuckooIndex:
    """Live keys of one shard. An entry is [digest, copies, keep_chars, keep_id]; keep_id is None and keep_chars -1 once its holder has been deleted."""

    def __init__(self, buckets: int = 256):
        self.stored: dict[int, list[list]] = {}
        self.live = 0
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 4) & self.mask)

    def may_contain(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        s = self.slots
        return mark in s[one * SLOTS : one * SLOTS + SLOTS] or mark in s[two * SLOTS : two * SLOTS + SLOTS]

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest: filter first, then the keys of its bucket."""
        if not self.may_contain(digest):
            return None
        return next((e for e in self.stored.get(int.from_bytes(digest[:4], "little"), ()) if e[0] == digest), None)

    def insert(self, digest: bytes, copies: int, chars: int, doc_id: int | None) -> None:
        entry = self.find(digest)
        if entry is None:
            self.stored.setdefault(int.from_bytes(digest[:4], "little"), []).append([digest, copies, chars, doc_id])
            self.live += 1
            if self.live > 0.94 * len(self.slots) or not self._place(digest):
                self._grow()
            return
        entry[1] += copies
        if chars > entry[2] or chars == entry[2] and doc_id is not None and (entry[3] is None or doc_id < entry[3]):
            entry[2:] = [chars, doc_id]

    def delete(self, digest: bytes, copies: int, doc_id: int | None) -> bool:
        """False if the digest isn't live. With its last copy the key leaves the filter."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[1] -= copies
        if entry[1] <= 0:
            bucket = int.from_bytes(digest[:4], "little")
            self.stored[bucket].remove(entry)
            if not self.stored[bucket]:
                del self.stored[bucket]
            self.live -= 1
            mark, one, two = self._places(digest)
            for b in (one, two):
                for i in range(b * SLOTS, b * SLOTS + SLOTS):
                    if self.slots[i] == mark:
                        self.slots[i] = 0
                        return True
        elif doc_id == entry[3]:
            entry[2:] = [-1, None]
        return True

    def _place(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for b in (one, two):
            for i in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.slots[i]:
                    self.slots[i] = mark
                    return True
        b = two
        for k in range(KICKS):
            i = b * SLOTS + (k + mark) % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            b = self._other(b, mark)
            for i in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.slots[i]:
                    self.slots[i] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Double and refill from the stored keys until all find a place."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._reset(buckets)
            if all(self._place(e[0]) for es in self.stored.values() for e in es):
                return

    def entries(self) -> Iterator[list]:
        for es in self.stored.values():
            yield from es

    def batches(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        found = list(self.entries())
        for at in range(0, len(found), rows):
            columns = list(zip(*found[at : at + rows], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ARROW_ENTRY, strict=True)], schema=ARROW_ENTRY)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in batch.schema.names), strict=True)


def fold_local(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A map task's rows, folded; the index is passed on and begun anew at `most` keys."""
    index = CuckooIndex()
    for batch in batches:
        for digest, copies, chars, doc_id in _rows(batch):
            index.insert(digest, copies, chars, doc_id)
        if index.live >= most:
            yield from index.batches()
            index = CuckooIndex()
    yield from index.batches()


def fold_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's entries and changes (copies below 0: deletions of doc keep_id), entries and insertions applied first."""
    index, deletions = CuckooIndex(), []
    for batch in batches:
        for digest, copies, chars, doc_id in _rows(batch):
            if copies < 0:
                deletions.append((digest, -copies, doc_id))
            else:
                index.insert(digest, copies, chars, doc_id)
    for digest, copies, doc_id in deletions:
        index.delete(digest, copies, doc_id)
    yield from index.batches()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text without spaces, code points of the whole text."""
    text = text_of("text")
    bare = text
    for c in SPACES:
        bare = F.replace(bare, F.lit(c))
    return lean(docs).select("doc_id", F.unhex(F.sha2(bare, 256)).alias("digest"), F.length(text).cast("long").alias("n_code_points"))


#: Rows that a shard of the index is made for; each is a dict and a filter in one task.
SHARD_ROWS = 1_000_000


def index_rows(rows: DataFrame, count: int | None = None) -> DataFrame:
    """The index (one row per live digest) over keyed rows, in shards by their count."""
    count = rows.count() if count is None else count
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD_ROWS))
    events = rows.select("digest", F.lit(1).cast("long").alias("copies"), F.col("n_code_points").alias("keep_chars"), F.col("doc_id").cast("long").alias("keep_id"))
    return events.mapInArrow(fold_local, ENTRY).repartition(shards, "digest").mapInArrow(fold_shard, ENTRY)


def change_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index after insertions and deletions of documents (doc_id, text). Where the row that stayed is deleted, keep_id is null and keep_chars -1 until elect() runs."""
    events = index
    if inserted is not None:
        events = events.unionByName(index_rows(keyed(inserted)))
    if deleted is not None:
        gone = keyed(deleted)
        events = events.unionByName(gone.select("digest", F.lit(-1).cast("long").alias("copies"), F.lit(0).cast("long").alias("keep_chars"), F.col("doc_id").cast("long").alias("keep_id")))
    return events.repartition("digest").mapInArrow(fold_shard, ENTRY)


def elect(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Name the row that stays anew wherever its holder was deleted, from the live keyed rows."""
    open_ = index.where("keep_chars < 0").select("digest")
    fresh = index_rows(rows.join(open_, "digest", "left_semi"))
    return index.where("keep_chars >= 0").unionByName(fresh)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest for every row of docs (doc_id, text)."""
    rows = saved(keyed(docs).withColumn(ROW, F.monotonically_increasing_id()), "dedup-keys")
    total = rows.count()
    index = saved(index_rows(rows, total), "dedup-index")
    copies = index.where("copies > 1")
    x = attach_groups(rows, copies, "digest", "copies", total)
    lone = F.col("_group").isNull()
    keep_id = F.when(lone, F.col("doc_id")).otherwise(F.col("_group.keep_id"))
    kept = lone | (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_code_points") == F.col("_group.keep_chars")))
    x = x.select(ROW, "doc_id", keep_id.alias("keep_id"), F.coalesce("_group.copies", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "digest")
    # Rows that repeat the one that stays, id and length included: the first of them stays.
    first = saved(x.where("kept AND group_size > 1").groupBy("digest").agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n")), "dedup-first").where("_n > 1")
    if first.limit(1).count():
        tied = x.where("kept AND group_size > 1").join(first.select("digest"), "digest", "left_semi").join(first.select(F.col("_first").alias(ROW)), ROW, "left_anti")
        x = x.join(saved(tied.select(ROW, F.lit(True).alias("_tied")), "dedup-tied"), ROW, "left").withColumn("kept", F.col("kept") & F.col("_tied").isNull()).drop("_tied")
    return x.drop(ROW)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS size,
    first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS place FROM d
)
SELECT doc_id, keep_id, size AS group_size, place = 1 AS kept, h AS text_sha256 FROM g
"""
