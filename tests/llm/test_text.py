"""Operators over texts: Jaccard groups, spaced seeds, the quality classifier, language, the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import frame, make_rows, words
from tickloom.llm import language_bayes, quality_fm, spaced_seed, textscan, token_coder, token_groups


def shingle_set(text):
    w = words(text)
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(sets):
        k = find(i)
        if doc_id is not None:
            low[k] = min(low.get(k, doc_id), doc_id)
    return [(doc_id, len(s), low.get(find(i))) for i, (doc_id, s) in enumerate(sets)]


def test_word_hashes_are_words():
    texts = ["a b c", "", None, " Hello  wOrld\nx", "x", "é É a", "a b c d e f", " a", "a\x0bb\x1cc"]
    h, at, starts, ends = textscan.words(*textscan.raw_bytes(pa.array(texts)))
    plain = [w for t in texts for w in words(t)]
    assert len(h) == len(plain) and at.tolist() == np.cumsum([0] + [len(words(t)) for t in texts]).tolist()
    known = {}
    for w, x in zip(plain, h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def jaccard_rows(seed):
    """Chains of edited copies around the threshold, a hot cluster and a passage that most texts share."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = " ".join(r.choices(vocabulary, k=30))
    texts = [" ".join(r.choices(vocabulary, k=r.randint(20, 60))) + " " + passage for _ in range(60)]
    core = r.choices(vocabulary, k=60)
    for _ in range(120):
        w = core[:]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = r.choice(vocabulary)
        texts.append(" ".join(w))
    chain = r.choices(vocabulary, k=80)
    for k in range(25):
        w = chain[:]
        w[(k * 7) % 80] = f"n{k}"
        chain = w
        texts.append(" ".join(w))
        texts.append(" ".join(w[: 80 - k]))
    return [(i, t, None, None, 0, "", "", "", "") for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent", [8, 64])
def test_components_against_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(token_groups, "FREQUENT", frequent)
    for rows in (make_rows(), jaccard_rows(frequent)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in token_groups.similar_documents(frame(spark, rows)).collect())
        want = Counter(plain_components(rows))
        # Rows that repeat a doc_id with another text: ids of components go by row, so compare all but those of the null id.
        assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}


def opened_rows(group, salts):
    """Near copies and texts of their own, each its own component but for some, as members and queries of one group: rows (g, salt, kind, cls, comp, tokens)."""
    r = np.random.default_rng(group)
    core = r.integers(1, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[k % 7 :], r.integers(1, 1 << 62, k % 60).astype(np.uint64)])) for k in range(90)]
    comps = [k // 3 * 3 if k % 2 else k for k in range(90)]
    rows = [(group, salt, 0, k, comps[k], sets[k].tobytes()) for salt in range(salts) for k in range(45)]
    rows += [(group, k % salts, 1, k, comps[k], sets[k].tobytes()) for k in range(90)]
    return sets, comps, sorted(rows, key=lambda x: x[:3])


def test_edges_of_opened_groups_are_a_forest():
    sets, comps, rows = opened_rows(5, 3)
    linked = [(comps[x], comps[y]) for x in range(90) for y in range(45) if comps[x] != comps[y] and 4 * len(np.intersect1d(sets[x], sets[y])) >= 3 * len(np.union1d(sets[x], sets[y]))]
    names = ["g", "salt", "kind", "cls", "comp", "tokens"]
    batches = [pa.RecordBatch.from_pydict({n: [row[i] for row in rows[k : k + 50]] for i, n in enumerate(names)}) for k in range(0, len(rows), 50)]
    found = [row for batch in token_groups.open_groups(iter(batches)) for row in batch.to_pylist()]

    def classes(edges):
        of = {c: c for c in comps}
        for u, v in edges:
            old, new = of[u], of[v]
            of = {c: new if x == old else x for c, x in of.items()}
        return {frozenset(c for c in of if of[c] == x) for x in of.values()}

    assert len(linked) > 900 and classes([(e["u"], e["v"]) for e in found]) == classes(linked)
    # As many edges as joins of components: a group of twice the size has twice the edges, not four times.
    assert len(found) == len(set(comps)) - len(classes(linked))
    assert len(found) <= sum(e["met"] for e in found) <= 90


def test_few_edges_leave_a_group_of_near_copies(spark, monkeypatch):
    r = random.Random(8)
    core, found = [f"c{i}" for i in range(80)], []
    texts = [" ".join([*core, *(f"x{k}y{j}" for j in range(r.randint(0, 12)))]) for k in range(200)]
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")

    def saved(df, name, write=token_groups.saved):
        table = write(df, name)
        if name == "found":
            found.append(table.count())
        return table

    # Without contraction all texts meet in the opened groups.
    monkeypatch.setattr(token_groups, "contracted", lambda texts, rows, posts, nodes: (nodes, None))
    monkeypatch.setattr(token_groups, "saved", saved)
    kept = token_groups.one_of_each(docs)
    assert sorted(tuple(x) for x in kept.collect()) == [(1, texts[0])] and len(set(texts)) > 150
    # At most a forest from each of the 4 tasks.
    assert 0 < sum(found) < 4 * 200


def test_similar_documents_of_nothing(spark):
    assert token_groups.similar_documents(frame(spark, [])).count() == 0
    assert token_groups.similar_documents(frame(spark, [(1, None, None, None, 0, "", "", "", ""), (2, "", None, None, 0, "", "", "", "")])).select("component_id").distinct().count() == 2


def test_seeds_find_substituted_items_and_nothing_else(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)] + ["the", "of", "and"] * 60
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(15, 60)))) for k in range(25)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (93, items[0][1])], "item_id bigint, text string")
    rows, want = [], set()
    for d in range(150):
        w = r.choices(vocabulary, k=r.randint(0, 200))
        if d % 3 == 0:
            k, text = r.choice(items)
            piece = text.split()
            for _ in range(len(piece) // 8):
                piece[r.randrange(len(piece))] = "zz"
            at = r.randint(0, len(w))
            w[at:at] = piece
            want.add((d, k))
        rows.append((d, " ".join(w).capitalize() + ".", "en", "s", 0, "", "", "", ""))
    rows += [(900, None, None, None, 0, "", "", "", ""), (901, "", None, None, 0, "", "", "", ""), rows[0]]
    got = spaced_seed.find_leaks(frame(spark, rows), bench).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert {p for p in found if p[1] != 93} == want
    assert {d for d, k in found if k == 93} == {d for d, k in want if k == 0}
    assert len(got) == len(found)
    clean = spaced_seed.clean_documents(frame(spark, rows), bench)
    assert {x["doc_id"] for x in clean.collect()} == {x[0] for x in rows} - {d for d, _ in want}
    assert spaced_seed.find_leaks(frame(spark, []), bench).count() == 0
    assert spaced_seed.find_leaks(frame(spark, rows), bench.where("false")).count() == 0


def test_any_segment_with_the_identity_leaks():
    for run, gap in ((12, 11), (20, 19), (30, 29), (40, 39)):
        equal = np.array([True] * run + [False] * gap + [True] * run)
        assert spaced_seed.leaking_segment(equal, 12, 0.7) == (0, run, run)
    r = np.random.default_rng(6)
    for _ in range(400):
        equal = r.random(r.integers(0, 45)) < r.choice([0.4, 0.6, 0.7, 0.8])
        every = [(i, j - i, int(equal[i:j].sum())) for j in range(len(equal) + 1) for i in range(j)]
        right = [x for x in every if x[2] >= 12 and 10 * x[2] >= 7 * x[1]]
        got = spaced_seed.leaking_segment(equal, 12, 0.7)
        assert (got is None) == (not right)
        assert got is None or (got in right and 2 * got[2] - got[1] == max(2 * n - span for _, span, n in right))


def test_head_and_tail_of_an_item_leak(spark):
    item = [f"q{i}" for i in range(35)]
    text = " ".join(["before", *item[:12], *(f"z{i}" for i in range(11)), *item[23:], "after"])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    docs = frame(spark, [(1, text, "en", "s", 0, "", "", "", ""), (2, "other words", "en", "s", 0, "", "", "", "")])
    assert [tuple(x) for x in spaced_seed.find_leaks(docs, bench).collect()] == [(1, 1, 1, 12, 12)]
    assert [x["doc_id"] for x in spaced_seed.clean_documents(docs, bench).collect()] == [2]


def test_short_items_with_a_substitution(spark):
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 13)}
    bench = spark.createDataFrame([*((n, " ".join(w)) for n, w in items.items()), (50, ""), (51, None)], "item_id bigint, text string")
    rows, want = [], set()
    for n, w in items.items():
        for k in range(-1, n):
            doc = 100 * n + k + 1
            rows.append((doc, " ".join(["before", *w[: max(k, 0)], *(["zz"] if k >= 0 else []), *w[k + 1 :], "after"]), "en", "s", 0, "", "", "", ""))
            want |= {(doc, n)} if k < 0 or n >= 7 else set()
    assert {(x["doc_id"], x["item_id"]) for x in spaced_seed.find_leaks(frame(spark, rows), bench).collect()} == want


def test_rows_that_repeat_or_lack_a_doc_id(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    ids = [(7, 0), (7, 0), (None, 0), (3, 1), (None, 1), (3, 2), (None, 2), (None, None), (None, None)]
    docs = frame(spark, [(d, None if t is None else texts[t], "en", f"s{k}", 0, "", "", "", "") for k, (d, t) in enumerate(ids)])
    kept = token_groups.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x["doc_id"]), x["text"] or "") for x in kept.collect()) == sorted([("7", texts[0]), ("3", texts[1]), ("3", texts[2]), ("None", ""), ("None", "")])
    clean = spaced_seed.clean_documents(docs, spark.createDataFrame([(1, texts[1])], "item_id bigint, text string"))
    assert clean.columns == docs.columns
    assert sorted(x["source"] for x in clean.collect()) == ["s0", "s1", "s2", "s5", "s6", "s7", "s8"]


def quality_rows():
    r = random.Random(3)
    vocabulary = [f"word{i}"[: r.randint(3, 8)] for i in range(200)]
    rows, labels = [], []
    for d in range(400):
        good = r.random() < 0.7
        w = r.choices(vocabulary, k=r.randint(20, 90))
        text = " ".join(w).capitalize() + "." if good else r.choice([lambda w: "!! ".join(w).upper(), lambda w: " ".join([w[0]] * len(w)), lambda w: " | ".join(w)])(w)
        rows.append((d, text, "en", "s", len(text), "", "", "", ""))
        labels.append((d, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    rows += [(1000, None, None, None, 0, "", "", "", ""), (1001, "", None, None, 0, "", "", "", ""), (1002, "x" * 200_000, None, None, 0, "", "", "", "")]
    table = spark.createDataFrame([*labels, (5, None, 0), (6, 7, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    df = frame(spark, rows)
    model = quality_fm.train(df, table)
    got = {x["doc_id"]: x["_quality_score"] for x in quality_fm.score_documents(df, model).collect()}
    held = [d for d, *_ in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    right = sum((got[d] >= 0.5) == bool(labels[d][1]) for d in held)
    assert right / len(held) > 0.95 and all(0 <= v <= 1 for v in got.values()) and got[1000] == got[1001]
    kept = quality_fm.kept_documents(df, table)
    assert kept.columns == df.columns
    assert quality_fm.train(df, table.where("quality = 1")) is None
    assert quality_fm.score_documents(frame(spark, []), model).count() == 0
    flags = df.select("doc_id", quality_fm.held_out(df.doc_id).alias("h")).collect()
    assert {x["doc_id"] for x in flags if x["h"]} >= set(held)


def test_sum_of_squares_is_the_pair_sum():
    r = np.random.default_rng(0)
    fm = quality_fm.FactorisationMachine()
    x = np.zeros((3, quality_fm.FEATURES), np.float32)
    for row in x:
        row[r.integers(0, quality_fm.FEATURES, 12)] = r.random(12)
    fm.weights = r.random(quality_fm.FEATURES).astype(np.float32)
    fm.factors = r.random((quality_fm.FEATURES, quality_fm.FACTORS)).astype(np.float32)
    for row, margin in zip(x, fm.margin(x)[0], strict=True):
        on = np.flatnonzero(row)
        pairs = sum(fm.factors[i] @ fm.factors[j] * row[i] * row[j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert abs(fm.bias + row @ fm.weights + pairs - margin) < 1e-3


def test_language_evidence(spark):
    r = random.Random(2)
    stock = {"en": "the of and with that this from water thing house", "fr": "le la les des une dans avec pour maison être", "de": "der die das und nicht haus wasser über straße schön"}
    say = lambda lang, n: " ".join(r.choices(stock[lang].split(), k=n))
    docs = spark.createDataFrame([(say(k, 60), k) for k in stock for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    pages = [(i, f"https://h{k}.example/{i}", f"<html><body><script>var the='of'</script><p>{say(k, 30)}</p></body></html>", "c") for i, k in enumerate(list(stock) * 8)]
    pages += [
        (100, "https://hfr.example/x", "", "c"),  # the host alone
        (101, "https://other.example/de/1", "<html lang='de-AT'>", "c"),
        (102, None, None, "c"),
        (103, "https://hen.example/1", f"<html lang=fr>{say('en', 60)}", "c"),  # text over markup
        (103, "https://hen.example/1", f"<html lang=fr>{say('en', 60)}", "c"),
    ]
    got = {x["page_id"]: x for x in language_bayes.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string, lang string"), docs).collect()}
    for i, k in enumerate(list(stock) * 8):
        assert got[i]["lang"] == k
    assert got[100]["lang"] == "fr" and got[101]["lang"] == "de" and got[103]["lang"] == "en"
    assert got[102]["lang"] in stock and 0 < got[102]["confidence"] < 1
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert language_bayes.identify(empty, docs).count() == 0
    assert language_bayes.identify(empty, docs.where("false")).count() == 0


def test_pipeline_against_plain(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_rows()
    extra = [(2000 + k, rows[k][1].replace("word1", "other", 1), "en", "t", 0, "", "", "", "") for k in range(0, 60, 3)] + [(3000, None, None, None, 0, "", "", "", "")]
    items = [(1, rows[7][1]), (2, " ".join(f"q{i}" for i in range(30)))]
    extra.append((4000, "Some words before " + items[1][1] + " and after", "en", None, 0, "", "", "", ""))
    docs = [r[:5] for r in rows + extra]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {x["doc_id"]: x["_quality_score"] for x in quality_fm.score_documents(df, quality_fm.train(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    kept = [d for d in docs if score[d[0]] >= 0.5]
    component = plain_components(kept)
    kept = [d for d, (_, _, c) in zip(kept, component, strict=True) if d[0] == c]
    plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split())
    kept = [d for d in kept if not any(f" {plain(t)} " in f" {plain(d[1])} " for _, t in items)]
    assert {x["doc_id"] for x in got} <= {d[0] for d in kept}
    size, times = defaultdict(int), Counter(x["doc_id"] for x in got)
    taken = defaultdict(int)
    for d in kept:
        size[d[3]] += len(words(d[1]))
        taken[d[3]] += len(words(d[1])) * times[d[0]]
    assert max(times.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    coder = token_coder.WordTokenizer(token_coder.default_tokenizer())
    at, text_of = 0, {d[0]: d[1] for d in kept}
    for x in sorted(got, key=lambda x: x["start"]):
        ids, _ = coder.encode(pa.array([text_of[x["doc_id"]]], pa.string()), 2)
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
