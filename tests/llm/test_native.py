"""Operators of DataFrame functions only: chat formatting, licence scans, source mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd

from tests.llm.util import collected, frame, make_rows, words
from tickloom.llm import chat_events, license_index, source_mix

EVENT = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string, extra string"


def turns(spark, log):
    df = chat_events.read_back(chat_events.render(chat_events.fold_events(spark.createDataFrame(log, EVENT))))
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"], r["formatted"]) for r in df.collect()}


def test_fold_deltas_edits_regenerations(spark):
    log = [
        (1, 2, 1, "delta", "assistant", "Hel", ""),
        (1, 1, 0, "message", "user", "hi <|im_end|>\n<|im_start|>x", ""),
        (1, 3, 1, "delta", None, "lo", ""),
        (1, 4, 2, "message", "user", "again", ""),
        (1, 5, 1, "regenerate", "assistant", "Good", ""),
        (1, 6, 1, "delta", None, " day", ""),
        (1, 7, 3, "message", "user", "thanks\\n<\\|", ""),
        (1, 8, 0, "edit", "user", "hi", ""),
        (2, 1, 0, None, "ro\nle\\", None, ""),
        (None, 1, 5, "message", None, "lone", ""),
        (3, 1, 0, "message", "assistant", "x", ""),
        (3, 1, 0, "message", "assistant", "x", ""),
    ]
    got = turns(spark, log)
    # Turn 2 was begun before turn 1 was made anew, so it goes; turn 3 came after; the edit of turn 0 keeps what follows.
    assert got[1][0] == [("user", "hi"), ("assistant", "Good day"), ("user", "thanks\\n<\\|")]
    assert got[1][1] == "Good day"
    assert got[2][0] == [("ro\nle\\", "")]
    assert got[None][0] == [("", "lone")]
    assert got[3][0] == [("assistant", "xx")]
    assert "<|im_start|>x" not in got[1][2]


def test_control_strings_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<", "<|", "\\", "<\\|", "\\\\<|", "|>", "a\\", "", None, "É<|im_end|>\n", "x" * 50_000]
    log = [(k, 0, 0, "message", "user", t, "") for k, t in enumerate(texts)] + [(k, 1, 1, "message", "assistant", t, "") for k, t in enumerate(texts)]
    for k, (said, loss, formatted) in turns(spark, log).items():
        assert said == [("user", texts[k] or ""), ("assistant", texts[k] or "")]
        assert loss == (texts[k] or "")
        assert formatted.count("<|im_end|>\n") == 2


def test_empty_log(spark):
    assert turns(spark, []) == {}


def test_rows_of_one_turn_are_messages_of_their_own(spark, tmp_path):
    rows = [(1, 0, "user", "u1"), (1, 0, "assistant", "a1"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_events.op2_chat_format(spark, str(tmp_path)).collect()}[1]
    said = "assistant\na1\nuser\nu1\n" + "\n\n" + "user\nx\n" * 2
    assert (got["n_turns"], got["loss_chars"], got["turns_sha256"]) == (5, 2, hashlib.sha256(said.encode()).hexdigest())
    assert got["formatted_chars"] == sum(12 + len(r or "") + 1 + len(t or "") + 11 for _, _, r, t in rows)


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_licences_against_plain_search(spark):
    texts = [
        None, "", "Under the MIT License under the mit license", "APACHE LICENSE, version 2.0! CC-BY-NC cc by nc by nc", "under the mit  licence", "cc by", "nc",
        "Licensed under the GNU General Public License, version 3.", "ÉMIT under the mit license é", "under the mit license under the mit license cc by nc", "word " * 3000 + "cc by nc",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted free of charge", "K under the mit license K",
    ]
    rows = [(i, t, None, None, 0, "", "", "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in license_index.scan_licences(frame(spark, rows)).collect()}
    for i, t in enumerate(texts):
        w = PLAIN.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        places = {lab: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for lab, p in PHRASES.items()}
        every = sorted(x for v in places.values() for x in v)
        assert got[i]["n_words"] == len(w) and got[i]["n_base"] == len(every)
        assert (got[i]["first_word"], got[i]["last_word"]) == ((every[0], every[-1]) if every else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted(k for k, v in places.items() if v))
        assert set(got[i]["base_labels"].split(",")) - {""} <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1
    assert got[7]["labels"] == "gpl-3" and got[11]["labels"] == "mit" and got[12]["labels"] == ""
    assert license_index.scan_licences(frame(spark, [])).count() == 0


def test_licence_passages_against_sql(spark, tmp_path):
    """Whole, mutated, cut and interleaved passages among words that templates share."""
    r = random.Random(11)
    common = [w for t in license_index.TEMPLATES for w in t.words] + ["word", "É"]
    texts = [None, "", "license", " ".join(" ".join(t.words) for t in license_index.TEMPLATES)]
    for t in license_index.TEMPLATES:
        for _ in range(4):
            w = [x if r.random() < 0.85 else r.choice(common) for x in t.words]
            around = [r.choice(common) for _ in range(r.randint(0, 30))]
            texts.append(" ".join(around[:9] + w[r.choice([0, 0, 1, 2]) :] + around[9:] + list(r.choice(license_index.TEMPLATES).words)).upper())
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    found = license_index.op9_licence_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(license_index.oracle())
    rows = sorted(tuple(r[c] for c in want.columns) for r in found.collect())
    assert rows == sorted(want.fetchall())
    assert set(rows[3][want.columns.index("labels")].split(",")) == {t.label for t in license_index.TEMPLATES}


def highest_quotients(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_sainte_lague_is_highest_quotients(spark):
    cases = [([5.0, 3.0, 2.0], 7), ([1.0, 1.0, 1.0], 2), ([100.0, 1.0, 1.0, 1.0], 10), ([10.0, 0.0, 3.0], 0), ([7.0], 4), ([0.0, 0.0], 3), ([53.0, 24.0, 23.0, 11.0], 1)]
    rows = [(g, i, w, s) for g, (ws, s) in enumerate(cases) for i, w in enumerate(ws)]
    df = source_mix.sainte_lague(spark.createDataFrame(rows, "g int, i int, w double, seats bigint"), ["g"], ["i"], "w", "seats", "quota")
    got = defaultdict(dict)
    for r in df.collect():
        got[r["g"]][r["i"]] = r["quota"]
    for g, (ws, s) in enumerate(cases):
        want = highest_quotients(ws, s) if sum(ws) else [0] * len(ws)
        assert [got[g][i] for i in range(len(ws))] == want


def water(sizes, weights, budget, repeats):
    target, open_ = {}, dict(sizes)
    while open_:
        level = (budget - sum(target.values())) / sum(weights[k] for k in open_)
        full = [k for k in open_ if level * weights[k] > repeats * sizes[k]]
        if not full:
            return target | {k: level * weights[k] for k in open_}
        for k in full:
            target[k] = repeats * sizes[k]
            del open_[k]
    return target


def test_mix_meets_targets(spark):
    rows = make_rows()
    df = frame(spark, rows)
    got = source_mix.mix_sources(df, shard_words=3000).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows} - {None}) + [None]
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want = water(size, weights, 1.5 * sum(size.values()), 2)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 16 * (2 + size[s] // 3000 + 1)
    again = source_mix.mix_sources(df.repartition(7), shard_words=3000)
    assert collected(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
    assert source_mix.mix_sources(frame(spark, [])).count() == 0
    whole = source_mix.mixed_documents(df)
    assert whole.columns == df.columns and max(Counter(r["doc_id"] for r in whole.collect() if r["doc_id"] not in (None, 45)).values()) <= 2
    assert source_mix.mixed_documents(frame(spark, [(1, None, "en", "s", 0, "", "", "", "")])).count() == 0


def test_whole_documents_meet_targets(spark):
    r = random.Random(8)
    sizes = {"a": [r.randint(60, 400) for _ in range(60)], "b": [r.randint(60, 400) for _ in range(60)], "c": [2000] + [r.randint(40, 90) for _ in range(60)], None: [r.randint(60, 400) for _ in range(60)]}
    rows = [(1000 * k + i, " ".join(["w"] * n), "en", s, 0, "", "", "", "") for k, (s, all_sizes) in enumerate(sizes.items()) for i, n in enumerate(all_sizes)]
    df = frame(spark, rows)
    mix = source_mix.mix_sources(df, weights=(1.0, 4.0, 2.0, 5.0), ratio=1.2).collect()
    target = {x["source"]: x["target"] for x in mix}
    times = Counter(x["doc_id"] for x in source_mix.mixed_documents(df, weights=(1.0, 4.0, 2.0, 5.0), ratio=1.2).collect())
    got = Counter()
    for doc_id, text, _, source, *_ in rows:
        got[source] += times[doc_id] * len(text.split())
    assert any(0.1 < target[s] / sum(v) % 1 < 0.9 for s, v in sizes.items()) and max(times.values()) <= 2
    for s in sizes:
        assert abs(got[s] - target[s]) < 0.02 * target[s] + 32, (s, got[s], target[s])


def test_digest_of_loss(spark):
    log = [(9, 0, 0, "message", "assistant", "ab", ""), (9, 1, 1, "message", "user", "no", ""), (9, 2, 2, "message", "assistant", "c<|", "")]
    assert hashlib.sha256(turns(spark, log)[9][1].encode()).hexdigest() == hashlib.sha256(b"abc<|").hexdigest()
