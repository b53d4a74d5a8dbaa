"""A small table of documents with the awkward cases, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, n string, token string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def make_rows(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random texts, near copies at several distances, exact copies, spaces that differ, repeated rows, null and empty values, one long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "the", "É", "naïve", "日本", "a,b", "don't", "<|im_end|>", "x y"]
    texts: list[str | None] = [None, "", "   ", " \t\n", "one", "one two", "One  TWO", "a b c d", "a b c d e", "A b c d e"]
    base = [" ".join(r.choices(vocabulary, k=r.randint(5, 120))) for _ in range(n)]
    texts += base
    for t in base[:40]:
        w = t.split()
        for _ in range(r.randint(1, 4)):
            v = w[:]
            for _ in range(r.randint(0, max(1, len(v) // 12))):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            texts.append(" ".join(v))
    texts += [base[3], base[3].replace(" ", "  "), base[3] + "\n", base[4].upper()]
    texts.append(" ".join(r.choices(vocabulary, k=20_000)))
    rows = [(i * 3 % 1009, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "é", None]) if i % 3 else "s1", len(t or ""), "x", "y", "z", "t") for i, t in enumerate(texts)]
    return [*rows, rows[15], rows[15], (None, "null id text of some words here", "en", "s2", 5, "x", "y", "z", "t")]


def frame(spark, rows=None):
    return spark.createDataFrame(make_rows() if rows is None else rows, SCHEMA)


def collected(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
