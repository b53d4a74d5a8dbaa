"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (DataFrame functions only).

Sizes are words. A source's target is its weight's share of ratio times all words; a target stops at max_repeats times
its source's size and the excess is shared again by weight (the water level that this ends at is found in closed form).
Blocks of block_words words are seats: sources get them by the highest quotients target / (2 s + 1), then each source's
seats are dealt to its shards the same way, with the shards' words as weights. Within a shard the documents lie on one
line of words in seeded order; a quota of q seats over n blocks takes every block q div n times and q mod n seeded blocks
once more. A block's words count for the documents they belong to, so a document at a border may be taken in part.

Edge cases: null text has size 0 and is never taken; the null source is a source of its own, sorted last; repeated rows
are laid on the line one by one; an empty table gives an empty result; other columns of the input are ignored, or
carried in the struct `payload` when asked for.

Scale: one window runs over all sources and one over each source's shards (rows of counts, not documents); documents are
sorted only within shards of about shard_words words, so a hot source is spread over as many tasks as it has shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.shared import lean, saved, text_of, word_count

#: Coprime to every number of blocks in a shard: a prime above shard_words / block_words.
STRIDE = 1_000_003


def seeded(col: Column, seed: int) -> Column:
    """60 bits of the md5 of the id and the seed."""
    text = F.concat(F.coalesce(col.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, max_repeats: float) -> DataFrame:
    """sizes: (source, source_size). Adds rank (code-point order, null last), weight and target."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    every = fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(ratio))
    level = ranked.withColumn("level", (budget - before) / rest).withColumn("place", F.row_number().over(fill))
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    level = level.withColumn("water", F.min(open_).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return level.withColumn("target", target).drop("cap", "level", "place", "water")


def sainte_lague(items: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, seats: str, quota: str) -> DataFrame:
    """Deal each group's seats to its items by the highest quotients weight / (2 s + 1), ties by order.

    With n items of total weight w and m seats, the divisors w / (m - n/2) and w / (m + n/2) give too few and enough seats, so all quotients between
    them, about 2 n, decide; they alone are ranked.
    """
    of = W.partitionBy(*group)
    total, n, m = F.sum(weight).over(of), F.count(F.lit(1)).over(of), F.col(seats)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    x = items.withColumn("_share", share).withColumn("_half", n / 2)
    low = F.floor(F.greatest(m - F.col("_half"), F.lit(0.0)) * F.col("_share") + 0.5)
    high = F.floor((m + F.col("_half")) * F.col("_share") + 0.5) + 1
    x = x.withColumn("_low", F.when(F.col("_share") > 0, low).otherwise(0).cast("long"))
    x = x.withColumn("_high", F.when(F.col("_share") > 0, F.greatest(high.cast("long"), F.col("_low"))).otherwise(F.col("_low")))
    x = x.withColumn("_left", F.greatest(m - F.sum("_low").over(of), F.lit(0)))
    x = x.withColumn("_seat", F.explode(F.sequence("_low", "_high")))
    own = F.col("_seat") == F.col("_low")
    quotient = F.when(own, F.lit(float("inf"))).otherwise(F.col(weight) / (2 * F.col("_seat") - 1))
    x = x.withColumn("_q", quotient)
    x = x.withColumn("_own", own).withColumn("_n", F.count(F.when(own, 1)).over(of))
    place = F.row_number().over(of.orderBy(F.col("_q").desc(), *order)) - F.col("_n")
    x = x.withColumn("_place", place).where(F.col("_own") | (F.col("_place") <= F.col("_left")))
    return x.groupBy(*items.columns).agg(F.max("_seat").alias(quota))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    ratio: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 16,
    shard_words: int = 1_000_000,
    seed: int = 7,
    payload: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, and rank, shard, h and payload (struct) if columns are named."""
    if shard_words // block_words >= STRIDE or max_repeats < ratio:
        raise ValueError("shards hold too many blocks, or the repeats can't reach the ratio")
    keep = [F.struct(*payload).alias("payload")] if payload else []
    base = lean(docs).select("doc_id", "source", word_count(text_of("text")).alias("size"), *keep)
    if not payload:
        base = saved(base, "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, ratio, max_repeats).withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long"))
    sources = sources.withColumn("all", F.lit(0))
    sources = sainte_lague(sources, ["all"], ["rank"], "target", "seats", "quota")
    sources = saved(
        sources.select(F.col("source").alias("_source"), "rank", "source_size", "target", "quota", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("shards")),
        "mix-sources",
    )
    keyed = base.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("h", seeded(F.col("doc_id"), seed)).withColumn("shard", F.col("h") % F.col("shards"))
    shards = keyed.groupBy("rank", "shard", "quota").agg(F.sum("size").alias("words"))
    shards = sainte_lague(shards, ["rank"], ["shard"], "words", "quota", "seats").drop("quota")
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block_words)).withColumn("seats", F.least(F.col("seats"), F.col("blocks") * max_repeats))
    shards = shards.select(
        "rank",
        "shard",
        F.col("blocks"),
        F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(0).alias("passes"),
        F.when(F.col("blocks") > 0, F.col("seats") % F.col("blocks")).otherwise(0).alias("extra"),
        seeded(F.concat_ws("/", F.col("rank"), F.col("shard")), seed).alias("turn"),
    )
    shards = saved(shards, "mix-shards")
    line = W.partitionBy("rank", "shard").orderBy("h", "doc_id", "size")
    placed = keyed.withColumn("end", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).join(shards, ["rank", "shard"])
    chosen = lambda j: (j * STRIDE + F.col("turn") % F.col("blocks")) % F.col("blocks") < F.col("extra")
    inside = lambda j: F.least(F.col("end"), (j + 1) * block_words) - F.greatest(F.col("start"), j * block_words)
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))
    extra = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, j: a + F.when(chosen(j), inside(j)).otherwise(0))
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.when(F.col("extra") > 0, extra).otherwise(0)).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["rank", "shard", "h", "payload"] if payload else []))


def whole_copies(mixed: DataFrame, max_repeats: int) -> DataFrame:
    """Adds copies, 0 to max_repeats, so that each shard's whole documents have the words that its documents are taken with, as nearly as a document allows.

    The fractions of taken / size are added up from the largest document to the smallest, and a document gets one copy more where the sum passes a half: what
    one document's rounding leaves, the next ones make up. The words then still missing or too many are a fraction of the largest document; seeded
    documents smaller than twice that get or lose one copy for them, those first that stay within one copy of taken / size.
    """
    of = W.partitionBy("rank", "shard")
    running = lambda *order: of.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    size, taken, copies, off = (F.col(c) for c in ("size", "taken", "_copies", "_off"))
    x = mixed.where(size > 0).withColumn("_share", F.floor(taken % size * F.lit(1 << 30) / size))
    x = x.withColumn("_sum", F.sum("_share").over(running(size.desc(), "h", "doc_id", "taken")) + F.lit(1 << 29))
    more = F.shiftright("_sum", 30) - F.shiftright(F.col("_sum") - F.col("_share"), 30)
    x = x.withColumn("_copies", F.floor(taken / size) + more).withColumn("_off", F.sum(taken - copies * size).over(of))
    x = x.withColumn("_new", copies + F.signum("_off").cast("long"))
    x = x.withColumn("_free", F.col("_new").between(0, max_repeats) & (size < 2 * F.abs(off)))
    far = F.abs(F.col("_new") * size - taken) >= size
    used = F.sum(F.when(F.col("_free"), size).otherwise(0)).over(running(far, "h", "doc_id", "size", "taken"))
    x = x.withColumn("_used", used)
    changed = F.col("_free") & (2 * F.col("_used") - size < 2 * F.abs(off))
    return x.withColumn("copies", F.when(changed, F.col("_new")).otherwise(copies).cast("int"))


def mixed_documents(docs: DataFrame, *, max_repeats: int = 2, **how) -> DataFrame:
    """The mix as whole documents: each row of docs 0 to max_repeats times, each source with the words of its target but for a part of a document."""
    mixed = whole_copies(mix_sources(docs, payload=docs.columns, max_repeats=max_repeats, **how), max_repeats)
    return mixed.select(F.explode(F.array_repeat("payload", F.col("copies"))).alias("payload")).select("payload.*")


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
