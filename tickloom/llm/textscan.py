"""Words of Arrow text columns as 64-bit hashes, a few array operations over all bytes of a chunk.

Words are runs of bytes other than \\x20 and \\x09 to \\x0D with A-Z lower-cased, or of letters and digits where `plain` is set. Equal words have equal hashes. A hash is the mixed sum
of random numbers, one for each byte at its place in the word (no polynomial, so no pair of words collides by its structure): different words collide by chance, about one pair in 2^64.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is one chunk of its own.
CHUNK = 1 << 19

_random = np.random.Generator(np.random.PCG64(20240517))
#: A random number for each of 256 bytes at each of the first REACH places of a word; later places mix the number of their stretch of REACH in.
REACH = 64
_TABLE = _random.integers(0, 1 << 64, REACH << 8, dtype=np.uint64)
for _first in range(0, REACH << 8, 256):
    _TABLE[_first + 65 : _first + 91] = _TABLE[_first + 97 : _first + 123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_MULTIPLIERS = _random.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts, and at last ends; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What frees an operator's tables that worker processes keep between tasks, by operator, and the operator that ran last in this process.
keepers: dict[str, Callable[[], None]] = {}
_last = [""]


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", operator: str = "") -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about CHUNK bytes of text. Tables that other operators keep in this process go."""
    if _last[0] != operator and _last[0] in keepers:
        keepers[_last[0]]()
        gc.collect()
        give_back()
    _last[0] = operator
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + CHUNK, side="right"))
            end = max(start + 1, min(batch.num_rows, end - 1))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def words(data: np.ndarray, at: np.ndarray, plain: bool = False, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, where each text's words start (and at last end), and each word's first and last+1 byte. cuts: places inside texts before which a word ends too."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.intp)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.intp), none, none
    gap = (_PLAIN if plain else _SPACE).take(data)
    begin = ~gap
    cut = at[:-1][at[:-1] < n]
    begin[1:] &= gap[:-1]
    if cuts is not None:
        cut = np.concatenate([cut, cuts])
    first = cut[~gap[cut]]
    begin[first] = True
    starts = np.flatnonzero(begin)
    stop = ~gap
    stop[:-1] &= gap[1:]
    last = cut[cut > 0] - 1
    stop[last[~gap[last]]] = True
    ends = np.flatnonzero(stop) + 1
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(begin, place, np.int32(0)))
    value = _TABLE.take(((place & (REACH - 1)) << 8) | data)
    if len(starts) and int((ends - starts).max()) > REACH:
        late = np.flatnonzero(place >= REACH)
        value[late] = mixed(value[late] + (place[late] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    hashes = mixed(total.take(ends) - total.take(starts) + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at), starts, ends


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and where each text's runs start; a text with fewer words, but any, has its whole sequence as one run."""
    n = np.diff(at)
    runs = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    starts = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(starts[-1], np.uint64)
    if len(hashes) >= size:
        every = np.zeros(len(hashes) - size + 1, np.uint64)
        for k in range(size):
            every += hashes[k : k + len(every)] * _MULTIPLIERS[k]
        long = np.flatnonzero(n >= size)
        where = np.repeat(at[:-1][long] - starts[:-1][long], runs[long])
        slots = np.repeat(n >= size, runs)
        out[slots] = every[where + np.flatnonzero(slots)]
    for i in np.flatnonzero((n > 0) & (n < size)):
        own = hashes[at[i] : at[i + 1]]
        out[starts[i]] = (own * _MULTIPLIERS[: len(own)]).sum() + np.uint64(len(own) << 8)
    return mixed(out), starts


def spaced(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hashes of the words at the given offsets from each word on, for all windows that fit."""
    size = max(mask) + 1
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k, offset in enumerate(mask):
        out += hashes[offset : offset + len(out)] * _MULTIPLIERS[k]
    return mixed(out + np.uint64(salt))


#: Bits of a Bloom filter, as powers of two: from 2**25 (4 MB) to 2**30 (128 MB), at least 64 for each key, two set by each (one in 1000 other keys passes). Beyond 16 million keys it lets more through.
BLOOM_LEAST, BLOOM_MOST, BLOOM_KEY = 25, 30, 64


def bloom_of(rows, column: str, mix: bool = True) -> np.ndarray:
    """The filter over a DataFrame's column of 64-bit integers, made on the executors, as 64-bit words; mix unless they are hashes that mixed() made."""
    from pyspark.sql import functions as F

    size = min(max((BLOOM_KEY * rows.count()).bit_length(), BLOOM_LEAST), BLOOM_MOST)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (size - 6), np.uint64)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            h = mixed(h) if mix else h
            for shift in (64 - size, 64 - 2 * size):
                cell = bloom_cell(h, shift, size)
                np.bitwise_or.at(table, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table.view(np.int64)[some])], names=["place", "bits"])

    parts = rows.select(column).mapInArrow(fold, "place bigint, bits bigint")
    found = parts.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words_ = np.zeros(1 << (size - 6), np.int64)
    words_[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return words_.view(np.uint64)


def bloom_cell(h: np.ndarray, shift: int, size: int) -> np.ndarray:
    return ((h >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.intp)


def maybe_in(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter can't rule out."""
    size = (len(bloom) << 6).bit_length() - 1

    def bit(some: np.ndarray, shift: int) -> np.ndarray:
        cell = bloom_cell(some, shift, size)
        return ((bloom.take(cell >> 6) >> (cell & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    first = np.flatnonzero(bit(h, 64 - size))
    return first[bit(h.take(first), 64 - 2 * size)]
