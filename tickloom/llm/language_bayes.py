"""Language of pages by Bayesian evidence fusion.

log P(lang | page) = log P(text | lang) + log P(markup's lang | lang) + log P(address' suffix | lang) + log P(lang | host), up to a constant.
Text: byte trigrams of the visible text in BUCKETS hashed cells, multinomial, with counts per language over all of `documents`; its weight is
tempered (TEMPER, neighbouring trigrams aren't independent): all trigrams of the whole page count, but together for no more than MOST_TRIGRAMS would, as
a longer page's further trigrams repeat what its first ones say. Markup and address: the declared language (html lang) and the language named by a path segment or country suffix are right with the
probabilities TRUST, the rest being shared by the other languages. Host: the other evidence gives each page's shares of languages; their sums by host, domain, suffix and
overall are smoothed in turn, each level by STRENGTH pages of the level above, a page's own share left out.

Edge cases: null url or html is no evidence of its kind; a page without any evidence gets the host prior; languages are those of the training texts, null
ones ignored (without any, lang is null and confidence 0); repeated rows count as pages of their own; an empty table gives no rows; extra columns are ignored.

Scale: one scan of documents (counts fold in each task) and one of pages; hosts are aggregated from slim rows and come back to their pages by attach_groups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import textscan
from tickloom.llm.shared import attach_groups, lean, saved

BUCKETS = 1 << 13
TEMPER, MOST_TRIGRAMS = 0.2, 400
TRUST = {"markup": 0.9, "address": 0.85}
STRENGTH = 4.0
#: Country suffixes whose main language is another code.
SUFFIX_LANGUAGE = {"at": "de", "ch": "de", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ca": "en", "au": "en", "be": "fr"}
#: What a tag can begin, and where scripts, styles and comments end.
_OPENS = re.compile(r"(?i)<(?:(script|style)\b|(!--))?")
_ENDS = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>"), "!--": re.compile("-->"), "": re.compile(">")}


def visible(html: str) -> str:
    """The text with each tag, comment, script and style as a space. One that never ends counts as a plain tag, and a tag that never ends as text; linear, as each end is looked for in vain once."""
    out, at, missing = [], 0, set()
    for found in iter(lambda: _OPENS.search(html, at), None):
        out.append(html[at : found.start()])
        for kind in ((found[1] or found[2] or "").lower(), ""):
            end = None if kind in missing else _ENDS[kind].search(html, found.end())
            if end:
                break
            missing.add(kind)
        if "" in missing:
            at = found.start()
            break
        out.append(" ")
        at = end.end()
    return "".join([*out, html[at:]])


def trigram_cells(data: np.ndarray) -> np.ndarray:
    """Cell of each byte trigram, letters in lower case, all else as spaces."""
    folded = _FOLD.take(data).astype(np.uint32)
    mixed = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA6B) + folded[2:] * np.uint32(0xC2B2AE35)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.intp)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of this task's texts."""
    totals: dict[str, np.ndarray] = {}
    for part in textscan.chunks(batches):
        data, at = textscan.raw_bytes(part.column("text"))
        langs = part.column("lang").to_pylist()
        for lang in set(langs) - {None}:
            pieces = [data[a:b] for x, a, b in zip(langs, at[:-1], at[1:], strict=True) if x == lang]
            cells = trigram_cells(np.concatenate([p for q in pieces for p in (q, np.array([32], np.uint8))]))
            totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            totals[lang] += np.bincount(cells, minlength=BUCKETS)
    for lang, counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["lang", "cell", "n"])


def train(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(cell | lang) with add-half smoothing, from all of documents (text, lang)."""
    counts = lean(documents).select("text", "lang").mapInArrow(fold_counts, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(langs), BUCKETS), 0.5)
    table[[langs.index(x) for x in counts.column("lang").to_pylist()], counts.column("cell").to_numpy()] += counts.column("n").to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def likelihoods(logs) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = logs.value
        for batch in batches:
            rows = []
            for html in batch.column("html").to_pylist():
                cells = trigram_cells(np.frombuffer(visible(html or "").encode() + b"  ", np.uint8))
                n = max(1, len(cells))
                rows.append(table[:, cells].sum(1) * (TEMPER * min(1.0, MOST_TRIGRAMS / n)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("declared"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["page_id", "url", "declared", "text_log"])

    return score


def named(code: Column, langs: list[str], trust: float) -> Column:
    """log P(code | lang) for each language; 0 where the code is none of them."""
    rest = float(np.log((1 - trust) / max(1, len(langs) - 1)))
    return F.when(code.isin(langs), F.array(*[F.when(code == x, F.lit(float(np.log(trust)))).otherwise(rest) for x in langs])).otherwise(F.array(*[F.lit(0.0)] * len(langs)))


def added(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    return total


def normalised(logs: Column) -> Column:
    """exp(logs) scaled to add up to 1."""
    raw = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def smoothed(counts: list[Column], above: list[Column]) -> list[Column]:
    total = sum(counts[1:], counts[0])
    return [(c + STRENGTH * p) / (total + STRENGTH) for c, p in zip(counts, above, strict=True)]


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, confidence, host, declared and suffix_lang for every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    langs, table = train(documents)
    slim = lean(pages).select("page_id", "url", "html")
    if not langs:
        return slim.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("host", "declared", "suffix_lang")])
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = slim.select("page_id", "url", declared.alias("declared"), "html").mapInArrow(likelihoods(spark.sparkContext.broadcast(table)), "page_id bigint, url string, declared string, text_log array<double>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    suffix = F.regexp_extract("host", r"([^.]*)$", 1)
    segment = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    to_lang = F.coalesce(*[F.when(F.col("suffix") == k, F.lit(v)) for k, v in SUFFIX_LANGUAGE.items() if v in langs], F.col("suffix"))
    x = rows.withColumn("host", host).withColumn("suffix", suffix).withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1))
    x = x.withColumn("suffix_lang", F.when(segment.isin(langs), segment).otherwise(to_lang))
    own = added(F.col("text_log"), named(F.col("declared"), langs, TRUST["markup"]), named(F.col("suffix_lang"), langs, TRUST["address"]))
    x = saved(x.withColumn("own", own).withColumn("share", normalised(F.col("own"))).drop("text_log"), "language-evidence")
    L = range(len(langs))
    sums = [F.sum(F.col("share")[i]).alias(f"c{i}") for i in L]
    hosts = x.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("pages"), *sums)
    again = [F.sum(f"c{i}").alias(f"c{i}") for i in L]
    level = lambda df, key, above: df.select(key, F.array(*smoothed([F.col(f"c{i}") for i in L], above)).alias(f"{key}_p"))
    hosts = saved(hosts, "language-hosts")
    overall = hosts.agg(*again).first()
    total = sum(overall[f"c{i}"] or 0.0 for i in L)
    base = [F.lit(((overall[f"c{i}"] or 0.0) + 1) / (total + len(langs))) for i in L]
    suffixes = level(hosts.groupBy("suffix").agg(*again), "suffix", base)
    domains = hosts.groupBy("domain", "suffix").agg(F.count(F.lit(1)).alias("_hosts"), *again)
    # A suffix may hold most domains: they stay where they are, and the suffix comes to them.
    domains = saved(domains, "language-domains")
    suffixes = saved(suffixes.join(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("domains")), "suffix"), "language-suffixes")
    domains = attach_groups(domains, suffixes, "suffix", "domains", domains.count()).withColumn("suffix_p", F.col("_group.suffix_p")).drop("_group", "_hosts")
    domains = level(domains, "domain", [F.col("suffix_p")[i] for i in L])
    hosts = hosts.join(domains, "domain").select("host", "pages", F.array(*[F.col(f"c{i}") for i in L]).alias("counts"), "domain_p")
    x = attach_groups(x, saved(hosts, "language-priors"), "host", "pages", x.count())
    others = [F.greatest(F.col("_group.counts")[i] - F.col("share")[i], F.lit(0.0)) for i in L]
    prior = F.array(*[F.log(p) for p in smoothed(others, [F.col("_group.domain_p")[i] for i in L])])
    x = x.withColumn("posterior", normalised(added(F.col("own"), prior)))
    best = F.array_max("posterior")
    place = F.array_position("posterior", best).cast("int")
    return x.select("page_id", F.element_at(F.array(*map(F.lit, langs)), place).alias("lang"), best.alias("confidence"), "host", "declared", "suffix_lang")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
