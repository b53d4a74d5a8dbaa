"""Token files, WARC archives and the dedup index."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import frame, make_rows
from tickloom.llm import cuckoo_dedup, token_coder, warc_index
from tickloom.llm.shared import scratch


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=1500))
def test_block_round_trip(ids):
    x = np.array(ids, np.uint32)
    data = token_coder.encode_block(x)
    got, used = token_coder.decode_block(memoryview(data + b"tail"))
    assert used == len(data) and (got == x).all()


def test_repetitive_ids_shrink_and_damage_is_found():
    x = np.tile(np.arange(50, dtype=np.uint32), 2000)
    data = token_coder.encode_block(x)
    assert len(data) < len(x) / 2
    for at in (0, 9, 22, 40, 300, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError, zlib.error, MemoryError)):
            token_coder.decode_block(memoryview(bytes(bad)))


def test_tokenizer_pieces_are_exact():
    from tokenizers import Tokenizer

    path = token_coder.default_tokenizer()
    plain = Tokenizer.from_file(path)
    odd = ["", None, "don't 5's a''s .'s x5y (a)b. <|endoftext|> q", "Éa, “q”, a“b é ½ a\x1cb \x85 x　y", "a.b,c;'ll 'LL 'Re wE'vE", "İI ΑΣ aΣ. ß K", "日本語 テスト1 #$% ''", "x\U0001f600y 12ab'", "\x0b\x0c a\x00b", "é ≠ ,́"]
    coder = token_coder.WordTokenizer(path)
    for batch in (odd, *[[t] for t in odd]):
        ids, n = coder.encode(pa.array(batch, pa.string()), 2)
        at = np.cumsum(n) - n
        for t, a, c in zip(batch, at, n, strict=True):
            assert ids[a : a + c].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [2]


def test_token_files_against_plain(spark):
    from tokenizers import Tokenizer

    rows = make_rows()
    plain = Tokenizer.from_file(token_coder.default_tokenizer())
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_coder.encode_documents(frame(spark, rows)).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_coder.encode_documents(frame(spark, [])).count() == 0


PAGE = "page_id bigint, url string, html string, digest string"


def test_archives_round_trip(spark):
    pages = [(i, f"http://h{i % 3}.example/ü {i}\n", f"<p>{i % 7}é</p>" * (i % 5 + 1), "clash") for i in range(60)]
    pages += [(100, None, None, ""), (101, "u", "", ""), (102, "u", "x" * 300_000, ""), (None, "u", "x" * 300_000, ""), (1, "http://h1.example/ü 1\n", "<p>1é</p>" * 2, "clash")]
    folder = scratch(spark, "warc-test")
    index = warc_index.write_archives(spark.createDataFrame(pages, PAGE), folder)
    got = warc_index.read_records(index, folder).collect()
    smallest = defaultdict(list)
    for p in pages:
        smallest[p[2] or ""].append(p[0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in smallest.items()}
    want = sorted((p, len((h or "").encode()), warc_index.base32_sha1((h or "").encode()), "response" if p == first[h or ""] else "revisit", None if p == first[h or ""] else first[h or ""]) for p, h in ((x[0] if x[0] is not None else -1, x[2]) for x in pages))
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    some = warc_index.read_records(index.where("page_id = 102"), folder).collect()
    assert [r["page_id"] for r in some] == [102]
    plan = warc_index.plan_reads(index).collect()
    assert sum(len(r["ranges"]) for r in plan) == len(pages) and len(plan) < len(pages)
    assert warc_index.write_archives(spark.createDataFrame([], PAGE), scratch(spark, "warc-none")).count() == 0


def test_page_ids_that_repeat_with_other_payloads(spark):
    pages = [(1, "a", "P", ""), (2, "b", "P", ""), (2, "c", "unique", ""), (3, "d", "Q", ""), (4, "e", "P", ""), (4, "f", "Q", "")]
    folder = scratch(spark, "warc-repeats")
    index = warc_index.write_archives(spark.createDataFrame(pages, PAGE), folder)
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc_index.read_records(index, folder).collect())
    p, q, u = (warc_index.base32_sha1(x) for x in (b"P", b"Q", b"unique"))
    assert got == sorted([(1, p, "response", 0), (2, p, "revisit", 1), (2, u, "response", 0), (3, q, "response", 0), (4, p, "revisit", 1), (4, q, "revisit", 3)])


def test_short_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "x", ""), (2, "b", "x", ""), (3, "c", "long enough", ""), (4, "d", "long enough", "")], PAGE)
    folder = scratch(spark, "warc-min")
    index = warc_index.write_archives(pages, folder, min_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in index.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_cuckoo_index_inserts_deletes_and_grows():
    r = random.Random(4)
    index, live = cuckoo_dedup.CuckooIndex(buckets=2), {}
    for _ in range(6000):
        key = r.randrange(1500).to_bytes(4, "little") * 8
        digest = __import__("hashlib").sha256(key).digest()
        if r.random() < 0.6:
            index.insert(digest, 1, 10, r.randrange(99))
            live[digest] = live.get(digest, 0) + 1
        else:
            assert index.delete(digest, 1, None) == (live.get(digest, 0) > 0)
            if live.get(digest, 0):
                live[digest] -= 1
    for digest, n in live.items():
        entry = index.find(digest)
        assert (entry[1] if entry else 0) == n
        assert not n or index.may_contain(digest)
    assert index.live == sum(n > 0 for n in live.values())


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def test_exact_dedup_against_plain(spark):
    rows = make_rows()
    want = plain_dedup(rows)
    got = cuckoo_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    key = {(r[0], r[1]): re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in rows}
    by_id = defaultdict(set)
    for (doc_id, _), k in key.items():
        by_id[doc_id].add((doc_id, *want[k]))
    for r in got:
        assert (r["doc_id"], r["keep_id"], r["group_size"]) in by_id[r["doc_id"]]
    assert cuckoo_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_index_changes(spark):
    rows = [(i, f"text {i % 5}", None, None, 0, "", "", "", "") for i in range(20)]
    df = frame(spark, rows)
    index = cuckoo_dedup.index_rows(cuckoo_dedup.keyed(df))
    gone = df.where("doc_id IN (0, 1, 6, 11, 16)")
    new = frame(spark, [(50, "text  3", None, None, 0, "", "", "", "")])
    changed = cuckoo_dedup.change_index(index, inserted=new, deleted=gone)
    got = sorted((r["copies"], r["keep_chars"], r["keep_id"]) for r in changed.where("keep_id IS NOT NULL").collect())
    assert got == [(4, 6, 2), (4, 6, 4), (5, 7, 50)]
    assert changed.where("keep_id IS NULL").select("copies").collect()[0]["copies"] == 3
    live = cuckoo_dedup.keyed(df.where("doc_id NOT IN (0, 1, 6, 11, 16)").unionByName(new))
    assert sorted(r["keep_id"] for r in cuckoo_dedup.elect(changed, live).collect()) == [2, 4, 5, 50]
