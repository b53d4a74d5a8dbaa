"""Repeated and null keys, inputs made to collide or to cost, and brute-force versions of what SQL can't say."""

import random
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from tests.llm.util import frame
from tickloom.llm import chat_events, cuckoo_dedup, language_bayes, license_index, quality_fm, spaced_seed, textscan


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_words_that_collide_under_any_polynomial():
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = pa.array([one, other, one.upper(), "x" * 64, "x" * 65, "x" * 128, "x" * 129])
    h, at, _, _ = textscan.words(*textscan.raw_bytes(texts))
    assert len(h) == 7 and h[0] == h[2] and len(set(h.tolist())) == 6


def test_hash_of_a_word_does_not_depend_on_its_place():
    r = random.Random(4)
    words = ["".join(r.choice("abAB-é") for _ in range(r.randint(1, 90))) for _ in range(300)]
    h, _, _, _ = textscan.words(*textscan.raw_bytes(pa.array([" \t".join(words)])))
    alone = [textscan.words(*textscan.raw_bytes(pa.array([w])))[0][0] for w in words]
    assert h.tolist() == [int(x) for x in alone]
    folded = {w.translate({c: c + 32 for c in range(65, 91)}) for w in words}
    assert len(set(h.tolist())) == len(folded)


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "abc"), (3, "a b c"), (3, "a b c"), (None, "z"), (None, "z"), (4, "q")], "doc_id long, text string")
    got = [tuple(r) for r in cuckoo_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert Counter(got) == Counter([(1, 3, 5, False)] * 2 + [(2, 3, 5, False), (3, 3, 5, True), (3, 3, 5, False), (None, None, 2, True), (None, None, 2, False), (4, 4, 1, True)])


def test_rows_of_one_turn_are_messages(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "B"), (1, 1, "assistant", "A"), (1, None, "user", None), (2, 5, "assistant", "x <|im_end|> \\ y")]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    found = chat_events.op2_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = con.sql(chat_events.ORACLE)
    assert sorted(tuple(r[c] for c in want.columns) for r in found.collect()) == sorted(want.fetchall())
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in found.collect()}[1] == (4, 1)


def test_licences_in_a_repetitive_text(spark):
    text = "This is under the MIT license. " * 50_000
    began = time.perf_counter()
    got = license_index.scan_licences(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert time.perf_counter() - began < 60
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"]) == (300_000, 50_000, 2, 299_996, "mit")
    assert (got[1]["n_words"], got[1]["labels"], got[1]["score"]) == (0, "", 0.0)


def test_sample_of_a_table_with_repeated_ids_is_bounded(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i % 30} word") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []
    fit = quality_fm.FactorisationMachine.fit
    quality_fm.FactorisationMachine.fit = lambda self, x, y: (seen.append(len(x)), fit(self, x, y))[1]
    try:
        assert quality_fm.train(docs, labels, max_rows=10) is not None
    finally:
        quality_fm.FactorisationMachine.fit = fit
    assert seen == [10]


def leaks_by_brute_force(docs, items, min_words=12, min_identity=0.7):
    found, words = set(), lambda t: textscan.words(*textscan.raw_bytes(pa.array([t or ""])), plain=True)[0]
    for d, text in docs:
        w = words(text)
        for k, item in items:
            q = words(item)
            least = min(min_words, int(np.ceil(min_identity * len(q) - 1e-9)))
            for shift in range(1 - len(q), len(w)):
                lo, hi = max(0, -shift), min(len(q), len(w) - shift)
                if len(q) and hi > lo and spaced_seed.leaking_segment(w[lo + shift : hi + shift] == q[lo:hi], max(least, 1), min_identity):
                    found.add((d, k))
                    break
    return found


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 6, 7, 8, 9, 12, 15, 20, 40] * 2)]
    docs, rates = [], {}
    for d in range(240):
        k, item = items[d % len(items)]
        rate = [0.0, 0.1, 0.2, 0.3][d % 4]
        copy = [w if r.random() >= rate else "other" for w in item.split()]
        docs.append((d, " ".join([*r.choices(vocabulary, k=15), *copy, *r.choices(vocabulary, k=15)])))
        rates[d, k] = rate, len(copy)
    want = leaks_by_brute_force(docs, items)
    found = spaced_seed.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    assert got <= want  # nothing but true leaks
    whole = {p for p in want if rates.get(p, (1, 0))[0] == 0}
    assert whole <= got
    for rate in (0.1, 0.2):
        some = {p for p in want if p in rates and rates[p][0] == rate and rates[p][1] >= 7}
        assert len(got & some) >= 0.9 * len(some)


def test_leaks_of_null_and_zero_ids(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(0, item), (None, item), (5, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (-1, item), (7, "four five six")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["equal_words"]) for r in spaced_seed.find_leaks(docs, items).collect())
    assert got == Counter((d, *k) for d in (0, None) for k in ((None, 13), (-1, 13), (7, 3)))


def test_language_without_training_texts_and_open_scripts(spark):
    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang='de'>" + "<script>a" * 100_000)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "text string, lang string")
    began = time.perf_counter()
    assert language_bayes.identify(pages, none).columns == ["page_id", "lang", "confidence", "host", "declared", "suffix_lang"]
    some = spark.createDataFrame([("der die das und nicht", "de"), ("the and of not", "en")], "text string, lang string")
    assert language_bayes.identify(pages, some).first()["lang"] == "de" and time.perf_counter() - began < 60


def test_columns_with_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0.1, "x", 5), (2, "a b c d e f", 0.2, "y", 6)], "doc_id long, text string, _quality_score double, _doc_id string, _row int")
    from tickloom.llm import token_groups

    kept = token_groups.one_of_each(docs)
    assert kept.columns == docs.columns and [r["_row"] for r in kept.collect()] == [5]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_fm.kept_documents(docs, labels).columns == docs.columns
