"""License scans over a positional rare-token index of licence templates (DataFrame functions only).

A template is a run of words, a passage of a licence, with a mandatory key phrase inside. Each file's licence words are noted with their positions in one scan; their
document frequencies over all files give IDFs. The index holds every template under the two highest-IDF words of its key phrase, as postings (template, offset). A file's
words are looked up there, rarest first: those that the index has under first words give candidate starts of all templates at once; only files with such a word look up the second
words, and the two lists are intersected by template and start. A start needs the whole key phrase, and the highest-IDF words that a file has of a phrase it holds are the phrase's own,
so no start is lost. For each start left the key phrase is verified, and the share of the template's words found at their places must reach `share`.
Words are runs of digits, letters and code points beyond ASCII, A-Z lower-cased.

Edge cases: null and empty texts have no words, no labels (empty strings) and score 0; a start before a text's first word is possible for templates whose key phrase
isn't at their head, and counts the missing words as unequal; rows are independent, so repeated rows repeat their result; empty tables give no rows; extra columns
are ignored.

Scale: one scan of the texts, no join and no shuffle but the count of each licence word; the index is a few literals. The work on a file grows with its licence words and the starts
they agree on, not with the number of templates.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import ascii_lower, lean, saved, text_of

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """key: the mandatory phrase, as the first and last+1 place in words. base: every place of the phrase counts."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def template(label: str, text: str, key: str | None = None) -> Template:
    words, phrase = text.split(), (key or text).split()
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, tuple(words), (at, at + len(phrase)), key is None)


#: Base phrases, then passages of public licences, each with its key phrase.
TEMPLATES = (
    template("mit", "under the mit license"),
    template("apache-2", "apache license version 2"),
    template("cc-by-nc", "cc by nc"),
    template("mit", "released under the mit license", "the mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    template("mit", "and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "modify merge publish distribute sublicense"),
    template("apache-2", "licensed under the apache license version 2 0", "the apache license"),
    template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license"),
    template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3"),
    template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "free software foundation either version 2"),
    template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    template("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice this list"),
    template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "must reproduce the above copyright notice this list"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "any purpose with or without fee"),
    template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    template("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not claim that you wrote the original software"),
    template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla org mpl 2 0"),
    template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    template("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    template("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    template("artistic-2", "under the terms of the artistic license 2 0", "artistic license 2 0"),
)


def licence_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and hits: (at, word) of the templates' words, in order."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.array_remove(F.split(ascii_lower(text_of("text")), GAP), "")  # empty before a gap at the head and after one at the end
    x = lean(docs).select("doc_id", words.alias("w"))
    marked = F.transform("w", lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("at"), w.alias("word"))))
    return x.select("doc_id", F.size("w").cast("long").alias("n_words"), F.filter(marked, lambda h: h.isNotNull()).alias("hits"))


def rarest_words(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, int]]:
    """For each template the offsets of the two highest-IDF words of its key phrase (one twice, if it has just one)."""
    found = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in found.collect()}  # no more rows than words in the templates
    ranked = [sorted(range(*t.key), key=lambda i: (frequency.get(t.words[i], 0), i)) for t in templates]
    return [(order[0], order[min(1, len(order) - 1)]) for order in ranked]


def starts_by(templates: tuple[Template, ...], offsets: list[int]) -> Column:
    """Starts that a file's words give when each template is indexed by its word at the given offset, as (start + longest) * templates + template."""
    size, longest = len(templates), max(len(t.words) for t in templates)
    postings = defaultdict(list)
    for k, (t, i) in enumerate(zip(templates, offsets, strict=True)):
        postings[t.words[i]].append((longest - i) * size + k)
    index = F.map_from_arrays(F.array(*[F.lit(w) for w in postings]), F.array(*[F.array(*[F.lit(p).cast("long") for p in ps]) for ps in postings.values()]))
    rare = F.filter("hits", lambda h: h["word"].isin(*postings))
    return F.flatten(F.transform(rare, lambda h: F.transform(F.element_at(index, h["word"]), lambda p: h["at"].cast("long") * size + p)))


def words_in_place() -> Column:
    """The file's words by position up to its last licence word, null where a word is in no template."""
    before = F.concat(F.array(F.lit(-1)), F.transform("hits", lambda h: h["at"]))
    gap = lambda h, last: F.concat(F.array_repeat(F.lit(None).cast("string"), h["at"] - last - 1), F.array(h["word"]))
    return F.flatten(F.zip_with("hits", F.slice(before, 1, F.size("hits")), gap))


def verified(templates: tuple[Template, ...], starts: Column) -> Column:
    """(template, start, share) of the starts whose key phrase is whole; share: of the template's words that stand at their places."""
    size, longest = len(templates), max(len(t.words) for t in templates)
    texts = F.array(*[F.split(F.lit(" ".join(t.words)), " ") for t in templates])
    keys = F.array(*[F.split(F.lit(" ".join(t.words[slice(*t.key)])), " ") for t in templates])
    at = F.array(*[F.lit(t.key[0]) for t in templates])
    equal = lambda words, run, start: F.size(F.filter(run, lambda w, i: F.coalesce(F.get(words, start + i) == w, F.lit(False))))

    def place(words: Column, code: Column) -> Column:
        k = (code % size).cast("int")
        start = (((code - k) / size).cast("long") - longest).cast("int")
        whole = equal(words, F.get(keys, k), start + F.get(at, k)) == F.size(F.get(keys, k))
        share = equal(words, F.get(texts, k), start) / F.size(F.get(texts, k))
        return F.when(whole, F.struct(k.alias("template"), start.cast("long").alias("start"), share.alias("share")))

    # The words are bound to a variable, so that they are laid out once a file and not once a start.
    once = F.array(F.struct(words_in_place().alias("words"), starts.alias("starts")))
    return F.filter(F.flatten(F.transform(once, lambda f: F.transform(f["starts"], lambda code: place(f["words"], code)))), lambda p: p.isNotNull())


def scan_licences(docs: DataFrame, share: float = 0.6, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs (doc_id, text)."""
    files = saved(licence_words(docs, templates), "licence-words")
    rare = rarest_words(files, templates)
    first, second = (starts_by(templates, [r[n] for r in rare]) for n in (0, 1))
    none = F.array().cast("array<bigint>")
    holds = F.exists("hits", lambda h: h["word"].isin(*{t.words[r[0]] for t, r in zip(templates, rare, strict=True)}))
    x = files.select("doc_id", "n_words", "hits", F.when(holds, F.array_intersect(first, second)).otherwise(none).alias("starts"))
    nowhere = F.array().cast("array<struct<template:int,start:bigint,share:double>>")
    x = x.select("doc_id", "n_words", F.when(F.size("starts") > 0, verified(templates, F.col("starts"))).otherwise(nowhere).alias("places"))

    names, base = F.array(*[F.lit(t.label) for t in templates]), [k for k, t in enumerate(templates) if t.base]
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, p["template"])))), ",")
    of_base = F.filter("places", lambda p: p["template"].isin(*base))
    x = x.select("doc_id", "n_words", of_base.alias("base"), F.filter("places", lambda p: p["share"] >= share).alias("good"))
    return x.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"),
        named(F.col("base")).alias("base_labels"),
        named(F.col("good")).alias("labels"),
        F.coalesce(F.array_max(F.transform("good", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def op9_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same by regular expressions and lists, without an index."""
    each = []
    for t in TEMPLATES:
        a, b = t.key
        key = " AND ".join(f"w[i + {k - a}] = '{t.words[k]}'" for k in range(a, b))
        equal = " + ".join(f"coalesce(i + {k - a} > 0 AND w[greatest(i + {k - a}, 1)] = '{t.words[k]}', false)::INT" for k in range(len(t.words)))
        each.append(f"SELECT n, '{t.label}' AS label, {t.base} AS base, i - 1 - {a} AS start, ({equal}) / {len(t.words)}.0::DOUBLE AS share FROM (SELECT n, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, '{t.words[b - 1]}')) WHERE {key}")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS ({' UNION ALL '.join(each)}), g AS (
  SELECT n, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (share >= 0.6)), ',') AS labels, max(share) FILTER (share >= 0.6) AS score
  FROM p GROUP BY n
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN g USING (n)
"""
