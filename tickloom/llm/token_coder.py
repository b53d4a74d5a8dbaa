"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A block of up to BLOCK ids is cut into lanes, runs of about equal length that are coded side by side: step s codes the s-th id of every lane, so
each step is a few array operations over all lanes, and what a step has coded serves all lanes from the next step on. The model starts anew with each
block and knows the ids that occur in it (they are listed, and numbered in order). Order 2 predicts the id that last followed the two ids before, order 1 the one that last followed the id before, order 0 gives every id a
probability from the block's counts so far. The mixture P(id) = w2 [id = p2] + w1 [id = p1] + w0 P0(id) has its weights learned for each
state of confidence (recent hits of both predictions, and whether they agree); the coder takes first the part, then, for order 0, the id. Range coding is on
64 bits with carries, 32-bit words out. Where several lanes change one cell in a step, the last lane's change stays.

File: MAGIC, blocks, footer (zlib: doc ids, a null mark, ids per document), its length and crc32, MAGIC. A block has a header (ids, highest id,
lanes, bytes of the list, bytes of the payload, crc32 of the fields before and the payload, crc32 of the ids as little-endian 32-bit integers) and a payload: the list
of ids (a zlib-packed bitmap), words per lane, and the words.

Edge cases: null or empty text has the end id alone; rows with equal doc_id are ordered by text (null doc_id first); very long texts span
blocks; an empty table gives no file rows; extra columns are ignored. The tokenizer file is a parameter, found on every executor.

Scale: one range shuffle of the texts by doc_id; a task writes files of about FILE_IDS ids as it goes, so memory is that of one file whatever the partition. Only one row
per file meets in the window that finds where each file starts.
"""

from __future__ import annotations

import os
import re
import sys
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm import textscan
from tickloom.llm.shared import lean, open_folder, saved, scratch, write_file

MAGIC = b"TLTOKEN1"
BLOCK = 1 << 20
FILE_IDS = 1 << 21
MAX_LANES = 4096
LANE_IDS = 256
#: Model: bits of the class total, hashed order-2 cells, states of confidence (4 x 4 x agree), steps between refreshes, weight of a count.
CLASS_BITS, CELLS, STATES, REFRESH, GAIN = 12, 1 << 16, 32, 8, 32
HEADER = struct.Struct("<7I")
NEXT_SURE = np.array([1, 2, 3, 3], np.uint8)
WORD32 = np.uint64(32)
LOW32 = np.uint64(0xFFFFFFFF)


class Model:
    """Order-0 to order-2 predictions of the next id in every lane."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.next1, self.next2 = np.zeros(alphabet, np.intp), np.zeros(CELLS, np.intp)
        self.sure1, self.sure2 = np.zeros(alphabet, np.uint8), np.zeros(CELLS, np.uint8)
        self.prev, self.before = np.zeros(lanes, np.intp), np.zeros(lanes, np.intp)
        self.seen = np.ones((STATES, 3), np.int64)
        self.count0 = np.ones(alphabet, np.int64)
        self.recent: list[np.ndarray] = []
        self.step = 0
        self._weigh()
        self._refresh()

    def _weigh(self) -> None:
        """Weights of the three parts in each state, as frequencies that add up to 1 << CLASS_BITS."""
        total = self.seen.sum(1, keepdims=True)
        f = 1 + self.seen * ((1 << CLASS_BITS) - 3) // total
        f[:, 2] += (1 << CLASS_BITS) - f.sum(1)
        self.freq = f.astype(np.uint64).ravel()
        self.cum = np.concatenate([np.zeros((STATES, 1), np.int64), np.cumsum(f, 1)[:, :2]], 1).astype(np.uint64).ravel()
        if int(total.max()) > 1 << 20:
            self.seen = (self.seen + 1) >> 1

    def _refresh(self) -> None:
        if self.recent:
            self.count0 += GAIN * np.bincount(np.concatenate(self.recent), minlength=self.alphabet)
            self.recent = []
        self.cum0 = np.zeros(self.alphabet + 1, np.uint64)
        np.cumsum(self.count0, out=self.cum0[1:].view(np.int64))
        self.total0 = self.cum0[-1]

    def predict(self) -> None:
        self.cell = ((self.prev * 0x9E3779B1 + self.before * 0x85EBCA6B) >> 12) & (CELLS - 1)
        self.p1, self.p2 = self.next1.take(self.prev), self.next2.take(self.cell)
        self.was1, self.was2 = self.sure1.take(self.prev), self.sure2.take(self.cell)
        state = (self.was2 << 2) + self.was1
        state <<= 1
        state += self.p1 == self.p2
        self.state3 = state * np.intp(3)

    def learn(self, ids: np.ndarray, part: np.ndarray) -> None:
        self.seen += np.bincount(self.state3 + part, minlength=3 * STATES).reshape(STATES, 3)
        self.sure1[self.prev] = NEXT_SURE.take(self.was1) * (ids == self.p1)
        self.sure2[self.cell] = NEXT_SURE.take(self.was2) * (part == 0)
        self.next1[self.prev] = ids
        self.next2[self.cell] = ids
        self.before, self.prev = self.prev, ids
        self.recent.append(ids)
        self.step += 1
        if self.step < 16 or self.step % 4 == 0:
            self._weigh()
        if self.step < 4 or self.step % REFRESH == 0:
            self._refresh()


def block_crc(shape: tuple, payload: bytes | memoryview) -> int:
    return zlib.crc32(payload, zlib.crc32(struct.pack("<5I", *shape)))


def lanes_of(n: int) -> int:
    return max(1, min(MAX_LANES, n // LANE_IDS))


def encode_block(ids: np.ndarray) -> bytes:
    """ids: up to BLOCK unsigned 32-bit integers, at least one."""
    n, lanes = len(ids), lanes_of(len(ids))
    steps = -(-n // lanes)
    top = int(ids.max())
    present = np.zeros(top + 1, bool)
    present[ids] = True
    padded = np.zeros(lanes * steps, np.intp)
    padded[:n] = (np.cumsum(present) - 1).take(ids)
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = Model(int(present.sum()), lanes)
    listed = zlib.compress(np.packbits(present).tobytes(), 6)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    width = steps * 2 + 4
    out, at = np.zeros(lanes * width, np.uint64), np.arange(lanes, dtype=np.intp) * width
    small = np.uint64(1 << 32)

    def put(which, unit: np.ndarray, start: np.ndarray, freq: np.ndarray) -> None:
        whole = which is None
        lo, place = (low, at) if whole else (low.take(which), at.take(which))
        add = unit * start
        lo = lo + add
        over = lo < add
        if over.any():
            out[place[over] - 1] += np.uint64(1)
        r = unit * freq
        full = np.flatnonzero(r < small)
        if len(full):
            out[place[full]] = lo[full] >> WORD32
            lo[full] <<= WORD32
            r[full] <<= WORD32
            at[full if whole else which[full]] += 1
        if whole:
            low[:], rng[:] = lo, r
        else:
            low[which], rng[which] = lo, r

    bits = np.uint64(CLASS_BITS)
    for s in range(steps):
        x = grid[s]
        model.predict()
        hit2 = x == model.p2
        part = 2 - 2 * hit2.astype(np.intp) - ((x == model.p1) & ~hit2)
        key = model.state3 + part
        put(None, rng >> bits, model.cum.take(key), model.freq.take(key))
        rest = np.flatnonzero(part == 2)
        if len(rest):
            y = x.take(rest)
            start = model.cum0.take(y)
            put(rest, rng.take(rest) // model.total0, start, model.cum0.take(y + 1) - start)
        model.learn(x, part)
    out[at], out[at + 1] = low >> WORD32, low & LOW32
    used = at + 2 - np.arange(lanes) * width
    table = out.reshape(lanes, width)
    for w in range(int(used.max()) - 1, 0, -1):  # carries
        table[:, w - 1] += table[:, w] >> WORD32
    words = (table & LOW32).astype("<u4")[np.arange(width) < used[:, None]]
    payload = listed + used.astype("<u4").tobytes() + words.tobytes()
    shape = (n, top, lanes, len(listed), len(payload))
    return HEADER.pack(*shape, block_crc(shape, payload), zlib.crc32(ids.astype("<u4").tobytes())) + payload


def decode_block(data: memoryview) -> tuple[np.ndarray, int]:
    """The ids of the block at the start of data, and its length in bytes."""
    n, top, lanes, listed, size, crc, ids_crc = HEADER.unpack(data[: HEADER.size])
    payload = data[HEADER.size : HEADER.size + size]
    if len(payload) != size or block_crc((n, top, lanes, listed, size), payload) != crc:
        raise ValueError("a block is damaged")
    names = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(payload[:listed]), np.uint8), count=top + 1)).astype(np.uint32)
    used = np.frombuffer(payload[listed : listed + 4 * lanes], "<u4").astype(np.intp)
    words = np.concatenate([np.frombuffer(payload[listed + 4 * lanes :], "<u4"), np.zeros(2, "<u4")]).astype(np.uint64)
    at = np.cumsum(used) - used
    off, rng = (words[at] << WORD32) | words[at + 1], np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    at += 2
    steps = -(-n // lanes)
    grid = np.empty((steps, lanes), np.intp)
    model = Model(len(names), lanes)
    bits, small = np.uint64(CLASS_BITS), np.uint64(1 << 32)

    def take(which, unit: np.ndarray, start: np.ndarray, freq: np.ndarray) -> None:
        whole = which is None
        o = (off if whole else off.take(which)) - unit * start
        r = unit * freq
        full = np.flatnonzero(r < small)
        if len(full):
            j = full if whole else which[full]
            o[full] = (o[full] << WORD32) | words[at[j]]
            r[full] <<= WORD32
            at[j] += 1
        if whole:
            off[:], rng[:] = o, r
        else:
            off[which], rng[which] = o, r

    for s in range(steps):
        model.predict()
        unit = rng >> bits
        k = model.state3
        part = (off >= unit * model.cum.take(k + 1)).astype(np.intp) + (off >= unit * model.cum.take(k + 2))
        key = k + part
        take(None, unit, model.cum.take(key), model.freq.take(key))
        x = np.where(part == 0, model.p2, model.p1)
        rest = np.flatnonzero(part == 2)
        if len(rest):
            unit = rng.take(rest) // model.total0
            y = model.cum0.searchsorted(np.minimum(off.take(rest) // unit, model.total0 - np.uint64(1)), side="right") - 1
            start = model.cum0.take(y)
            take(rest, unit, start, model.cum0.take(y + 1) - start)
            x[rest] = y
        grid[s] = x
        model.learn(x, part)
    ids = names.take(np.ascontiguousarray(grid.T).ravel()[:n])
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids, HEADER.size + size


def file_parts(ids: np.ndarray, doc_ids: list, counts: list[int]) -> Iterator[bytes]:
    yield MAGIC
    for i in range(0, len(ids), BLOCK):
        yield encode_block(ids[i : i + BLOCK])
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + np.array(counts, "<u8").tobytes()
    footer = zlib.compress(table, 1)
    yield footer + struct.pack("<QQI", len(doc_ids), len(footer), zlib.crc32(footer)) + MAGIC


def read_file(data: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """All ids, doc ids and ids per document of a file."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a whole token file")
    n, size, crc = struct.unpack("<QQI", data[-28:-8])
    footer = data[-28 - size : -28]
    if zlib.crc32(footer) != crc:
        raise ValueError("a footer is damaged")
    table = zlib.decompress(footer)
    doc_ids = [None if null else int(x) for x, null in zip(np.frombuffer(table[: 8 * n], "<i8"), table[8 * n : 9 * n], strict=True)]
    blocks, at, view = [np.zeros(0, np.uint32)], 8, memoryview(data)
    while at < len(data) - 28 - size:
        ids, used = decode_block(view[at:])
        blocks.append(ids)
        at += used
    return np.concatenate(blocks), doc_ids, np.frombuffer(table[9 * n :], "<u8").astype(np.int64)


#: Byte classes for cutting words: 0 space, 1 letter, 2 digit, 3 other mark, 4 apostrophe, 5 beyond ASCII.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58], _CLASS[39], _CLASS[128:] = 2, 4, 5
#: Pairs of neighbouring classes between which the tokenizer's own pattern always cuts.
_CUT = np.zeros(64, bool)
_CUT[[8 * 1 + 2, 8 * 1 + 3, 8 * 1 + 4, 8 * 2 + 1, 8 * 2 + 3, 8 * 2 + 4, 8 * 3 + 1, 8 * 3 + 2]] = True


class WordTokenizer:
    """Encodes texts with a tokenizer that lower-cases and takes words apart at spaces and between letters, digits and marks, so that ids depend on nothing beyond a piece.

    Pieces are known by their 64-bit hash (A-Z in lower case); the tokenizer is asked once for each. Texts with the name of a special token are encoded whole.
    """

    TABLE_BITS = 21
    PROBES = 6

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.index = np.zeros(1 << self.TABLE_BITS, np.uint64), np.zeros(1 << self.TABLE_BITS, np.int32)
        self.known, self.used = 0, 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if unknown."""
        slot = (h >> np.uint64(64 - self.TABLE_BITS)).astype(np.intp)
        found = np.where(self.keys.take(slot) == h, self.index.take(slot), -1)
        for k in range(1, self.PROBES):
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                break
            place = (slot.take(open_) + k) & ((1 << self.TABLE_BITS) - 1)
            hit = self.keys.take(place) == h.take(open_)
            found[open_[hit]] = self.index.take(place[hit])
        return found

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces, now known."""
        ids, counts = self.ask(pieces)
        n = self.known
        while n + len(pieces) > len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, self.store])
        numbers = np.arange(n, n + len(pieces), dtype=np.int32)
        self.start[numbers], self.count[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.store[self.used : self.used + len(ids)] = ids
        self.known, self.used = n + len(pieces), self.used + len(ids)
        left, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.TABLE_BITS)).astype(np.intp)
        for k in range(self.PROBES):  # a piece that finds no place stays unknown to the table
            place = (slot[left] + k) & ((1 << self.TABLE_BITS) - 1)
            free = np.flatnonzero(self.keys[place] == 0)
            _, one = np.unique(place[free], return_index=True)
            taken = free[one]
            self.keys[place[taken]], self.index[place[taken]] = hashes[left[taken]], numbers[left[taken]]
            left = np.delete(left, taken)
        return numbers

    def ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number of each. Pieces that are one word to the tokenizer go in lines and are told apart by their word ends."""
        plain = np.array([x.isalpha() or x.isascii() and not any(c.isalnum() or c == "'" for c in x) for x in pieces], bool)
        out: list[np.ndarray | None] = [None] * len(pieces)
        places = np.flatnonzero(plain).tolist()
        groups = [places[i : i + 64] for i in range(0, len(places), 64)]
        single = np.flatnonzero(~plain).tolist()
        for group, got in zip(groups, self.batch([" ".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                for i, x in zip(group, np.split(ids, cut[:-1]), strict=True):
                    out[i] = x
            else:
                single += group
        for i, got in zip(single, self.batch([pieces[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, np.uint32)
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.array([len(x) for x in out], np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with end_id behind it, and the number of ids of each text."""
        data, at = textscan.raw_bytes(texts)
        whole = data.tobytes()
        if any(x in whole for x in self.special):
            return self.encode_whole(texts, end_id)
        kind = _CLASS.take(data)
        cuts = np.flatnonzero(_CUT.take((kind[:-1] << 3) + kind[1:])) + 1
        h, word_at, starts, ends = textscan.words(data, at, cuts=cuts)
        if self.known > 1 << (self.TABLE_BITS - 1):
            self.clear()
        number = self.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh, first, back = np.unique(h.take(missing), return_index=True, return_inverse=True)
            spots = missing.take(first)
            names = [whole[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            number[missing] = self.learn(fresh, names).take(back)
        counts = self.count.take(number)
        begin = self.start.take(number)
        done = np.cumsum(counts)
        ids = self.store.take(np.repeat(begin - done + counts, counts) + np.arange(done[-1] if len(done) else 0))
        per = np.concatenate([[0], done]).take(word_at)
        return np.insert(ids, per[1:], np.uint32(end_id)), np.diff(per) + 1

    def encode_whole(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        return np.concatenate([np.array([*x.ids, end_id], np.uint32) for x in got]), np.array([len(x.ids) + 1 for x in got])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One for each file and worker process, with the words it has seen in earlier tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        textscan.keepers["tokens"] = _tokenizers.clear
    return _tokenizers[path]


FILES = "part int, seq int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"
TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt, seq = task.partitionId(), task.taskAttemptId(), 0
        coder = tokenizer_at(tokenizer)
        held, doc_ids, counts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, doc_ids, counts, size, seq
            name = f"tokens-{part:05d}-{seq:05d}-{attempt}.tlt"
            written = write_file(folder, name, file_parts(np.concatenate(held), doc_ids, counts))
            row = {"part": part, "seq": seq, "file": name, "n_docs": len(doc_ids), "n_ids": size, "n_bytes": written}
            held, doc_ids, counts, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k in ("part", "seq") else None) for k, v in row.items()], names=list(row))

        for chunk in textscan.chunks(batches, operator="tokens"):
            ids, n = coder.encode(chunk.column("text"), end_id)
            held.append(ids)
            doc_ids += chunk.column("doc_id").to_pylist()
            counts += n.tolist()
            size += len(ids)
            if size >= FILE_IDS:
                yield flush()
        if doc_ids:
            yield flush()

    return write


def reader(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                    ids, doc_ids, counts = read_file(f.read())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(base + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of docs (doc_id, text) in ascending doc_id order; returns one row per file with base, the ids in all files before it."""
    spark = docs.sparkSession
    rows = lean(docs).select(F.col("doc_id").cast("long"), "text")
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    files = saved(dealt.mapInArrow(writer(folder, tokenizer, end_id), FILES), "token-files")
    before = F.sum("n_ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0).cast("long")))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32 of the ids decoded."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "base").repartition(n, "file").mapInArrow(reader(folder), TOKENS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer or default_tokenizer()), folder)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
