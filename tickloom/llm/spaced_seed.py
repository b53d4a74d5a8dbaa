"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of each window and ignore the others; windows of the benchmark and of the documents that agree on
a mask's words share a hash. Hits are verified along their diagonal (document word minus item word): +1 for equal words, -1
for substituted ones. An item leaks into a document if any segment has at least min(min_words, min_identity of the item's words) equal words, and they
are at least min_identity of it; the best of these segments is given. Words are runs of letters and digits, A-Z lower-cased, so punctuation doesn't matter.

Edge cases: null and empty texts match nothing; items with fewer words than the shortest mask's window are looked up whole; rows that repeat a doc_id and text
give one result, a null doc_id or item_id is an id of its own, several diagonals of an item in a document give the best; empty tables give no rows; extra columns are ignored.

Scale: one scan of the documents. Windows are first held against a Bloom filter over the benchmark's
hashes, so only true hits, with the words around them, leave the scan; the join is on hashes, with the seeds of up to FEW_SEEDS windows of the benchmark
broadcast, so that a seed in very many documents is no hot key; beyond that it is a shuffle join, whose skewed partitions Spark splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import textscan
from tickloom.llm.shared import ROW, lean, saved, with_row_key

MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 7, 8), (0, 1, 5, 7, 8))
#: More masks for items of 7 and 8 words: with these, one substitution anywhere leaves a window of some mask whole.
SHORT_MASKS = ((0, 1, 2, 4, 5), (0, 2, 3, 5, 6))
SHORTEST = min(m[-1] for m in MASKS) + 1
SPAN = max(m[-1] for m in MASKS) + 1
SEED = "item bigint, at int, hash bigint"
#: Seed rows (about 20 bytes each) that are broadcast to the hits; more join by shuffle.
FEW_SEEDS = 2_000_000
REGION = "region bigint, doc_id bigint, begin int, words array<bigint>, hits array<struct<at:int,hash:bigint>>"
ARROW_HIT = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())]))
LEAK = "doc_id bigint, item_id bigint, start_word bigint, span_words bigint, equal_words bigint"


def masks_of(size: int) -> dict[int, tuple[int, ...]]:
    """Masks by salt that items of so many words are looked up with: of less than SHORTEST words, the whole item."""
    if size < SHORTEST:
        return {100 + size: tuple(range(size))} if size else {}
    every = MASKS + SHORT_MASKS if size < SPAN else MASKS
    return {k: m for k, m in enumerate(every) if m[-1] < size}


def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textscan.chunks(batches):
        hashes, at, _, _ = textscan.words(*textscan.raw_bytes(part.column("text")), plain=True)
        found = []
        for item, a, b in zip(part.column("item").to_pylist(), at[:-1], at[1:], strict=True):
            for k, mask in masks_of(int(b - a)).items():
                h = textscan.spaced(hashes[a:b], mask, k)
                found.append((np.full(len(h), item), np.arange(len(h), dtype=np.int32), h.view(np.int64)))
        if not found:
            continue
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "at", "hash"])


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textscan.chunks(batches):
        hashes, at, _, _ = textscan.words(*textscan.raw_bytes(part.column("text")), plain=True)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), lists], names=["item", "item_id", "item_words"])


def scanner(bloom, margin: int, masks: dict[int, tuple[int, ...]]) -> Callable:
    """Regions of documents around hits: hits nearer than 2 margin words share one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        for part in textscan.chunks(batches):
            hashes, at, _, _ = textscan.words(*textscan.raw_bytes(part.column("text")), plain=True)
            places, values = [], []
            for k, mask in masks.items():
                h = textscan.spaced(hashes, mask, k)
                found = textscan.maybe_in(table, h)
                end = at[np.searchsorted(at, found, side="right")] if len(found) else found
                found = found[found + mask[-1] < end]
                places.append(found)
                values.append(h[found])
            place, value = np.concatenate(places), np.concatenate(values).view(np.int64)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            doc = np.searchsorted(at, place, side="right") - 1
            cut = np.flatnonzero((np.diff(place) > 2 * margin) | (np.diff(doc) > 0)) + 1
            ids, rows = part.column("doc_id"), []
            for lo, hi in zip([0, *cut], [*cut, len(place)], strict=True):
                d = doc[lo]
                begin, end = max(at[d], place[lo] - margin), min(at[d + 1], place[hi - 1] + SPAN + margin)
                own = hashes[begin:end]
                doc_id = ids[int(d)].as_py()
                key = hashlib.blake2b(own.tobytes() + repr((doc_id, int(begin - at[d]))).encode(), digest_size=8).digest()
                hits = [{"at": int(p - at[d]), "hash": int(v)} for p, v in zip(place[lo:hi], value[lo:hi], strict=True)]
                rows.append((int.from_bytes(key, "little", signed=True), doc_id, int(begin - at[d]), own.view(np.int64), hits))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), ARROW_HIT]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["region", "doc_id", "begin", "words", "hits"])

    return scan


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """start, length and equal words of the segment with most equal less unequal words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def leaking_segment(equal: np.ndarray, least: int, min_identity: float) -> tuple[int, int, int] | None:
    """start, length and equal words of the segment with most equal less unequal words among all that have least equal words, min_identity of the segment; None if none has."""
    start, span, n = best_segment(equal)
    if n >= least and n >= min_identity * span - 1e-9:
        return start, span, n
    hits = np.concatenate([[0], np.cumsum(equal)])
    if hits[-1] < least:
        return None
    # A segment from i to j has the identity if rest[j] >= rest[i].
    rest = hits - min_identity * np.arange(len(hits))
    lows = np.minimum.accumulate(rest)
    before = np.searchsorted(hits, hits - least, side="right")  # starts that leave enough equal words
    ends = np.flatnonzero(before > 0)
    ends = ends[rest[ends] - lows[before[ends] - 1] >= -1e-9]
    total, found = 2 * hits - np.arange(len(hits)), None
    for j in ends:
        starts = np.flatnonzero(rest[: before[j]] <= rest[j] + 1e-9)
        scores = total[j] - total[starts]
        k = len(scores) - 1 - int(np.argmax(scores[::-1]))
        if found is None or scores[k] > found[0]:
            found = int(scores[k]), int(starts[k]), int(j)
    return found and (found[1], found[2] - found[1], int(hits[found[2]] - hits[found[1]]))


def verifier(min_words: int, min_identity: float) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc_id, item_id, begin, diagonal = (batch.column(n)[i].as_py() for n in ("doc_id", "item_id", "begin", "diagonal"))
                doc, item = (batch.column(n)[i].values.to_numpy() for n in ("words", "item_words"))
                shift = diagonal - begin  # item word 0 stands at this place of the region
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                found = leaking_segment(doc[lo + shift : hi + shift] == item[lo:hi], min(min_words, math.ceil(min_identity * len(item) - 1e-9)), min_identity)
                if found:
                    start, span, equal = found
                    rows.append((doc_id, item_id, diagonal + lo + start, span, equal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in LEAK.split(", ")])

    return verify


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_identity: float = 0.7) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start_word, span_words, equal_words."""
    spark = docs.sparkSession
    # Each row of the benchmark is an item of its own, whatever its id.
    tests = saved(lean(benchmark).select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text"), "leak-tests")
    seed_rows = saved(tests.mapInArrow(seeds, SEED), "leak-seeds")
    items = saved(tests.mapInArrow(item_words, "item bigint, item_id bigint, item_words array<bigint>"), "leak-items")
    margin, short = items.agg(F.coalesce(F.max(F.size("item_words")), F.lit(0)), F.collect_set(F.when(F.size("item_words") < SPAN, F.size("item_words")))).first()
    masks = masks_of(SPAN) | {k: m for size in short for k, m in masks_of(size).items()}
    bloom = spark.sparkContext.broadcast(textscan.bloom_of(seed_rows, "hash", mix=False))
    regions = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanner(bloom, int(margin), masks), REGION)
    regions = saved(regions, "leak-regions").dropDuplicates(["region"])
    hits = regions.select("region", F.explode("hits").alias("hit")).select("region", F.col("hit.at").alias("doc_at"), F.col("hit.hash").alias("hash"))
    few = seed_rows.count() <= FEW_SEEDS
    pairs = hits.join(F.broadcast(seed_rows) if few else seed_rows, "hash").select("region", "item", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct()
    full = pairs.join(items, "item").join(regions.drop("hits"), "region")
    found = full.select("doc_id", "item_id", "begin", "diagonal", "words", "item_words").mapInArrow(verifier(min_words, min_identity), LEAK)
    best = F.max(F.struct("equal_words", (-F.col("span_words")).alias("span"), (-F.col("start_word")).alias("start"))).alias("b")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("b.start")).alias("start_word"), (-F.col("b.span")).alias("span_words"), F.col("b.equal_words").alias("equal_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs into which no item leaks; rows that repeat a doc_id or lack one each have their own verdict."""
    keyed = with_row_key(docs, "leak-rows")
    leaks = find_leaks(keyed.select(F.col(ROW).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias(ROW))
    return keyed.join(saved(leaks.distinct(), "leak-documents"), ROW, "left_anti").select(docs.columns)


def op7_spaced_seed_leaks(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
