"""Exact n-gram Jaccard join (similarity 0.75 or more on distinct 5-word shingles) over a token-group matrix.

Shingles are 64-bit hashes (two texts with tens of thousands of words meet by chance with a probability of about 1e-10). Equal
sets are one class from the start. Tokens are ordered by frequency, as a sketch of all sets counts it (rare ones by hash alone); a class's prefix has its first
n - ceil(0.75 n) + 1 tokens, so linked classes share a prefix token, and of what x and y share at most max(|x|, |y| beyond their prefixes) stays out of sight. Then:

1. Rounds of contraction, for tokens that many classes share: each class is led to the class that comes first, by a hash of the round, among those with one of its prefix
   tokens, and compared with those of other components that it is led to most often and whose sketch is like its own; links join components. Rounds end when few comparisons still find a link.
2. Classes that share their component, or the component of the class they were led to most often, and have like size form groups of about GROUP members. The token-group
   matrix holds the union of a group's prefix tokens, for tokens that still meet in several components. Groups are bounded against groups: a pair is opened only
   if the distinct prefix tokens that both unions have reach what the smallest members need, less what can lie beyond the prefixes.
3. In an opened pair each member of the one is a query: the overlap with the union of the other's whole sets is counted first; only if it is at least 0.75 |x| the
   members of other components are compared one by one. A task's links come out as a forest of components, no more edges than components it has read.

Every link between classes of different components is found in 3, or joins what a task's earlier links join, so the components are exact. What the sketch counts, and how many rounds run, matters for speed alone.

Edge cases: null and empty texts, and those without words, have size 0 and link to nothing; texts with fewer than 5 words have one shingle; rows that repeat a
doc_id count as documents of their own with that id; an empty table gives no rows; extra columns are ignored.

Scale: four to seven scans of the texts (measures and sketch, prefixes, whole sets of each round's classes and of the opened groups), none of which shuffles them and none of
whose sets is kept on disk; prefixes move once, packed by token bucket; whole sets move only for classes that are compared. Token joins have a row per token and pair of groups, not of classes. Groups are bounded and their queries are salted by SALT; copies come back by
attach_groups, so no hot class lands in one task. The sketch has a fixed size (4 << CELL_BITS bytes), the Bloom filters grow with the classes wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm import textscan
from tickloom.llm.shared import ROW, attach_groups, lean, saved, with_row_key

SHINGLE = 5
#: Cells of the frequency sketch, in blocks that tasks send; a token is frequent if its cell counts at least FREQUENT, and more than tokens that occur once would explain.
CELL_BITS, CELL_BLOCK, FREQUENT = 21, 4096, 32
GROUP, BAND, SALT = 48, 1.1, 64
BUCKET_TOKENS = 500_000
#: Contraction is for tokens of HOT or more classes, where pairs would be many; it has at most ROUNDS rounds.
HOT, ROUNDS = 32, 4
LEAD_COLUMNS = [f"lead{turn}" for turn in range(ROUNDS)]
#: Contraction compares a class with up to LEADS others whose SKETCH least tokens let a similarity of LIKELY be expected.
LEADS, SKETCH, LIKELY = 4, 24, 0.6
#: Leads, or rows of opened groups (40 bytes each), that are broadcast; more join by shuffle.
FEW_LEADS = 200_000
#: Contraction ends with a round in which no more than one of so many queries met a link.
FRUITLESS = 5


def legal(n: np.ndarray | int):
    """Tokens of a prefix: linked sets share at least one."""
    return n - -(-3 * n // 4) + 1


def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """Slices of the batches with each text's sorted distinct tokens and its class (a hash of the set; 0 if empty)."""
    for part in textscan.chunks(batches):
        hashes, at, _, _ = textscan.words(*textscan.raw_bytes(part.column("text")))
        runs, starts = textscan.shingles(hashes, at, SHINGLE)
        sets = [np.unique(runs[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        with np.errstate(over="ignore"):
            keys = np.array([s.sum() + np.uint64(len(s)) for s in sets], np.uint64)
            second = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            keys = textscan.mixed(keys + textscan.mixed(second))
        keys[np.array([len(s) == 0 for s in sets], bool)] = 0
        yield part, sets, keys.view(np.int64).tolist()


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, cls and, once a class and task, the SKETCH least tokens of the set; at last, the cells of the task's sets in blocks."""
    seen, total = set(), np.zeros(1 << CELL_BITS, np.uint32)
    for part, sets, keys in token_sets(batches):
        least, new = [], []
        for s, key in zip(sets, keys, strict=True):
            fresh = len(s) and key not in seen
            if fresh:
                seen.add(key)
                new.append(s)
            least.append(s[:SKETCH].view(np.int64) if fresh else None)
        if new:
            cells, n = np.unique(cell_of(np.concatenate(new)), return_counts=True)
            total[cells] += n.astype(np.uint32)
        n = [len(s) for s in sets]
        none = len(n)
        columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array([k if c else None for k, c in zip(keys, n, strict=True)], pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=MEASURED)
    if seen:
        blocks = total.reshape(-1, CELL_BLOCK)
        none = len(blocks)
        columns = [pa.nulls(none, pa.int64())] * 3 + [pa.nulls(none, pa.list_(pa.int64())), pa.array(np.arange(none)), pa.array([b.tobytes() for b in blocks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=MEASURED)


MEASURED = ["doc_id", "n", "cls", "least", "block", "counts"]


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.intp)


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            mine = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
            found[block] = found[block] + mine if block in found else mine
    if found:
        high = np.uint64(0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([np.minimum(x, high).astype(np.uint32).tobytes() for x in found.values()], pa.binary())], names=["block", "counts"])


def frequencies(parts: DataFrame) -> np.ndarray:
    """How often the tokens of each cell occur in all sets; 0 where that is not frequent."""
    added = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(add_blocks, "block bigint, counts binary").toArrow()
    table = np.zeros((1 << CELL_BITS) // CELL_BLOCK * CELL_BLOCK, np.uint32).reshape(-1, CELL_BLOCK)
    for block, counts in zip(added.column("block").to_pylist(), added.column("counts").to_pylist(), strict=True):
        table[block] = np.frombuffer(counts, np.uint32)
    table = table.ravel()
    mean = float(table.mean())
    return np.where(table >= max(FREQUENT, mean + 5 * mean**0.5), table, np.uint32(0))


def bucketer(frequent, buckets: int, flush: int = 1_000_000) -> Callable:
    """Prefixes of the texts' sets, once a class and task, by token bucket."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen, held, owners, size = frequent.value, set(), [], [], 0

        def packed() -> pa.RecordBatch:
            tokens, cls = np.concatenate(held), np.concatenate(owners)
            of = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            tokens, cls, of = tokens[order], cls[order], of[order]
            cut = np.flatnonzero(np.diff(of)) + 1
            spans = list(zip([0, *cut], [*cut, len(of)], strict=True))
            columns = [pa.array([int(of[a]) for a, _ in spans], pa.int64()), pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([cls[a:b].tobytes() for a, b in spans], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "tokens", "cls"])

        for _, sets, keys in token_sets(batches):
            for key, tokens in zip(keys, sets, strict=True):
                if key in seen or not len(tokens):
                    continue
                seen.add(key)
                level = often.take(cell_of(tokens))
                if level.any():
                    tokens = tokens[np.lexsort((tokens, level))]
                tokens = tokens[: legal(len(tokens))]
                held.append(tokens)
                owners.append(np.full(len(tokens), key, np.int64))
                size += len(tokens)
                if size >= flush:
                    yield packed()
                    held, owners, size = [], [], 0
        if held:
            yield packed()
        textscan.give_back()

    return bucket


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket (rows sorted by bucket), the postings (token, cls) of tokens with several classes; of tokens with HOT or more, the class that comes first in each round."""
    now, held = None, []

    def postings() -> pa.RecordBatch:
        tokens, cls = (np.concatenate([np.frombuffer(x[k], np.int64) for x in held]) for k in (0, 1))
        order = np.lexsort((cls, tokens))
        tokens, cls = tokens[order], cls[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])
        tokens, cls = tokens[new], cls[new]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.append(starts, len(tokens)))
        each = np.repeat(sizes, sizes)
        tokens, cls, each = tokens[each > 1], cls[each > 1], each[each > 1]
        hot = each >= HOT
        columns = [pa.array(tokens), pa.array(cls)]
        starts, sizes = np.flatnonzero(np.concatenate([[True], tokens[hot][1:] != tokens[hot][:-1]])) if hot.any() else [], sizes[sizes >= HOT]
        for turn in range(ROUNDS):
            lead = np.zeros(len(tokens), np.int64)
            if len(sizes):
                places = textscan.mixed(cls[hot].view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                first = np.repeat(np.minimum.reduceat(places, starts), sizes)
                lead[hot] = np.repeat(cls[hot][places == first], sizes)
            columns.append(pa.array(lead, mask=~hot))
        return pa.RecordBatch.from_arrays(columns, names=["token", "cls", *LEAD_COLUMNS])

    for batch in batches:
        for bucket, tokens, cls in zip(*(batch.column(k).to_pylist() for k in ("bucket", "tokens", "cls")), strict=True):
            if held and bucket != now:
                yield postings()
                held = []
            now = bucket
            held.append((tokens, cls))
    if held:
        yield postings()
    textscan.give_back()


def set_finder(bloom) -> Callable:
    """Whole sets of the texts whose class may be wanted, once a class and task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = bloom.value, {0}
        for _, sets, keys in token_sets(batches):
            hit = [i for i in textscan.maybe_in(table, textscan.mixed(np.array(keys, np.int64).view(np.uint64))).tolist() if not (keys[i] in seen or seen.add(keys[i]))]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.int64()), pa.array([sets[i].tobytes() for i in hit], pa.binary())], names=["cls", "tokens"])

    return find


def whole_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and tokens of the wanted classes (cls)."""
    bloom = texts.sparkSession.sparkContext.broadcast(textscan.bloom_of(wanted, "cls"))
    found = texts.mapInArrow(set_finder(bloom), "cls bigint, tokens binary")
    return found.dropDuplicates(["cls"]).join(wanted, "cls", "left_semi")


def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) between the components of queries (kind 1) and of those members (kind 0) of their group and salt that they link to; rows come sorted so, members first.

    A task's edges are a forest: a link between components that its earlier links join adds none, and a query that they join with all its members isn't compared.
    met counts the queries that are joined with a member of another component; a task's first edge has them all.
    """
    now, members, ready, above, edges, met = None, [], None, {}, [], 0

    def top(comp: int) -> int:
        while (up := above.get(comp, comp)) != comp:
            above[comp] = comp = above.get(up, up)
        return comp

    for batch in batches:
        for g, salt, kind, cls, comp, tokens in zip(*(batch.column(k) for k in ("g", "salt", "kind", "cls", "comp", "tokens")), strict=True):
            key = (g.as_py(), salt.as_py())
            if key != now:
                now, members, ready = key, [], None
            mine = np.frombuffer(tokens.as_buffer(), np.uint64)
            if kind.as_py() == 0:
                members.append((cls.as_py(), comp.as_py(), mine))
                continue
            if not members:
                continue
            if ready is None:
                all_tokens = np.concatenate([m for _, _, m in members])
                owner = np.repeat(np.arange(len(members)), [len(m) for _, _, m in members])
                ready = all_tokens, owner, np.unique(all_tokens), np.array([len(m) for _, _, m in members]), [c for _, c, _ in members]
            all_tokens, owner, union, sizes, comps = ready
            n, x = len(mine), comp.as_py()
            place = np.minimum(np.searchsorted(union, mine), len(union) - 1)
            if 4 * int((union.take(place) == mine).sum()) < 3 * n:
                continue
            own = top(x)
            if all(top(c) == own for c in comps):
                met += any(c != x for c in comps)
                continue
            place = np.minimum(np.searchsorted(mine, all_tokens), n - 1)
            overlap = np.bincount(owner[mine.take(place) == all_tokens], minlength=len(members))
            linked = [comps[i] for i in np.flatnonzero(7 * overlap >= 3 * (n + sizes)) if comps[i] != x]
            met += bool(linked)
            for c in linked:
                if (one := top(x)) != (other := top(c)):
                    above[one] = other
                    edges.append((x, c))
    if edges:
        u, v = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([met] + [0] * (len(edges) - 1), pa.int64())], names=["u", "v", "met"])
    textscan.give_back()


def links(sets: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    """Edges (u, v) between components that links of the queries (g, cls, comp) with the members (g, cls, comp) of their groups join, and how many queries they meet."""
    sizes = saved(queries.groupBy("g").agg(F.count(F.lit(1)).alias("asking")), "asking")
    asked = sizes.select("g", F.ceil(F.col("asking") / SALT).cast("int").alias("salts"))
    tokens = sets.select(F.col("cls").alias("_cls"), "tokens")
    # A group of very many queries has as many salts: its members are dealt over tasks before each is repeated for them.
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = members.join(asked, "g").repartition(partitions, "g", "cls")
    one = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(0))
    two = attach_groups(queries, sizes, "g", "asking", queries.count())
    two = two.withColumn("salt", F.pmod(F.xxhash64("cls"), F.ceil(F.col("_group.asking") / SALT)).cast("int")).withColumn("kind", F.lit(1))
    rows = saved(one.select("g", "salt", "kind", "cls", "comp").unionByName(two.select("g", "salt", "kind", "cls", "comp")), "opened")
    rows = F.broadcast(rows) if rows.count() <= FEW_LEADS else rows  # few go to the sets, which then move once
    rows = rows.join(tokens, F.col("cls") == F.col("_cls")).select("g", "salt", "kind", "cls", "comp", "tokens")
    dealt = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "kind")
    return dealt.mapInArrow(open_groups, "u bigint, v bigint, met bigint")


def relabelled(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """nodes with the components of their components (node, comp)."""
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.join(comps.select("node", F.col("comp").alias("new")), F.col("comp") == F.col("node")).select("comp", "size", "new")
    x = attach_groups(nodes, groups, "comp", "size", nodes.count())
    return x.withColumn("comp", F.coalesce("_group.new", "comp")).drop("_group")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its smallest reachable node) for all nodes of the edges (u, v): minima over neighbours, then over the label's own label, until nothing changes."""
    both = saved(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    now = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("comp")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        low = now.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = low.join(now.select(F.col("node").alias("_n"), F.col("comp").alias("far")), F.col("comp") == F.col("_n"))
        new = saved(jump.select("node", "old", F.least("comp", "far").alias("comp")), "labels")
        if not new.where("old <> comp").limit(1).count():
            return new.select("node", "comp")
        now = new.select("node", "comp")


def fewest_shared(least: str, most: str, o_least: str, o_most: str) -> Column:
    """A lower bound on the prefix tokens that x and y share if they link, for sizes of least to most and of o_least to o_most.

    A link needs 3/7 (|x| + |y|) shared tokens with |y| >= 0.75 |x|; fewer than 0.75 |x| of them lie beyond x's prefix if that ends first.
    """

    def ending_first(most: str, other: str) -> Column:
        return F.greatest(F.col(other), F.col(most) * 0.75) * 3 / 7 - F.col(most) * 9 / 28

    return F.least(ending_first(most, o_least), ending_first(o_most, least)) - 1e-6


def alike(least: str, o_least: str) -> Column:
    """The similarity of two sets, as estimated by the SKETCH least tokens of their union."""
    union = F.slice(F.sort_array(F.transform(F.array_union(least, o_least), unsigned)), 1, SKETCH)
    both = F.transform(F.array_intersect(least, o_least), unsigned)
    return F.size(F.array_intersect(union, both)) / F.size(union)


def unsigned(token: Column) -> Column:
    """Signed integers in the order of the unsigned ones."""
    return token.bitwiseXOR(F.lit(-(1 << 63)))


def more_sets(texts: DataFrame, known: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """The known sets (cls, tokens) and those of the wanted classes (cls) that are not among them."""
    wanted = saved(wanted if known is None else wanted.join(known.select("cls"), "cls", "left_anti"), "wanted")
    if known is not None and not wanted.limit(1).count():
        return known
    found = saved(whole_sets(texts, wanted), "whole-sets")
    return found if known is None else known.unionByName(found)


def merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the components that the edges join."""
    return saved(relabelled(nodes, components(edges)), "nodes")


def likely(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """The leads (cls, g) whose sketches let a similarity of LIKELY be expected. Few leads go to the sketches, which stay in place."""
    few = leads.count() <= FEW_LEADS
    small = F.broadcast if few else (lambda df: df)
    both = saved(leads.select("cls").unionByName(leads.select(F.col("g").alias("cls"))).distinct(), "led-classes")
    sketches = rows.where("least IS NOT NULL").select("cls", "least").join(small(both), "cls", "left_semi").dropDuplicates(["cls"])
    sketches = saved(sketches, "sketches")
    x = sketches.join(small(leads), "cls").join(sketches.select(F.col("cls").alias("g"), F.col("least").alias("g_least")), "g")
    return x.where(alike("least", "g_least") >= LIKELY).select(leads.columns)


def contracted(texts: DataFrame, rows: DataFrame, posts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """nodes after rounds of contraction, with the class they were led to first in `home`, and the sets known by then."""
    known, place = None, F.row_number().over(W.partitionBy("cls").orderBy(F.desc("k"), "g"))
    for turn in LEAD_COLUMNS:
        leads = posts.where(F.col(turn) != F.col("cls")).select("cls", F.col(turn).alias("g")).groupBy("cls", "g").agg(F.count(F.lit(1)).alias("k"))
        # Classes that no link has joined yet are their own component: only the others are looked up.
        of = saved(nodes.where("comp <> cls").select("cls", "comp"), "joined")
        leads = leads.join(of, "cls", "left").join(of.select(F.col("cls").alias("g"), F.col("comp").alias("g_comp")), "g", "left")
        leads = leads.withColumns({"comp": F.coalesce("comp", "cls"), "g_comp": F.coalesce("g_comp", "g")}).where("comp <> g_comp")
        leads = leads.withColumn("place", place).where(F.col("place") <= LEADS).select("g", "g_comp", "cls", "comp", "place")
        asked = saved(likely(rows, saved(leads, "leads")), "queries")
        n_asked = asked.count()
        if not n_asked:
            break
        stars = asked.select(F.col("g").alias("cls"), F.col("g_comp").alias("comp")).distinct()
        known = more_sets(texts, known, asked.select("cls").unionByName(stars.select("cls")).distinct())
        found = saved(links(known, stars.select(F.col("cls").alias("g"), "cls", "comp"), asked.select("g", "cls", "comp")), "found")
        led = asked.groupBy(F.col("cls").alias("_cls")).agg(F.min_by("g", "place").alias("_lead"))
        nodes = saved(nodes.join(led, F.col("cls") == F.col("_cls"), "left").withColumn("home", F.coalesce("home", "_lead")).drop("_cls", "_lead"), "nodes")
        n_met = found.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]
        if n_met:
            nodes = merged(nodes, found)
        if n_met * FRUITLESS <= n_asked:
            break
    return nodes, known


def grouped(nodes: DataFrame) -> DataFrame:
    """nodes with their group g: classes of a component, and those led to it, that are of like size, in parts of about GROUP."""
    of = nodes.select(F.col("cls").alias("_cls"), F.col("comp").alias("_comp"))
    x = nodes.join(of, F.col("home") == F.col("_cls"), "left")
    home = F.when(F.col("comp") == F.col("cls"), F.coalesce("_comp", "comp")).otherwise(F.col("comp"))
    x = saved(x.withColumn("home", F.xxhash64(home, F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))))).select(*nodes.columns), "homes")
    large = x.groupBy("home").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > GROUP)
    parted = attach_groups(x, large, "home", "members", x.count()).withColumn("parts", F.coalesce(F.ceil(F.col("_group.members") / GROUP), F.lit(1)))
    return saved(parted.withColumn("g", F.xxhash64("home", F.pmod(F.xxhash64("cls"), "parts"))).select("cls", "n", "comp", "g"), "members")


def group_pairs(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (g, asks) of groups that may hold a link between components: members of `asks`, the smaller group, are to be compared with those of g."""
    one = F.when(F.min("comp") == F.max("comp"), F.min("comp"))
    sizes = [F.min("n").cast("int").alias("least"), F.max("n").cast("int").alias("most")]
    groups = saved(nodes.groupBy("g").agg(one.alias("own"), *sizes, F.count(F.lit(1)).alias("members")), "groups")
    of = saved(nodes.select("cls", "g").join(groups.drop("members"), "g"), "group-of")
    # Of each token its groups, if they aren't all of one component. own is null for groups of several.
    matrix = posts.select("token", "cls").join(of, "cls").drop("cls").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token").distinct()
    over = W.partitionBy("token")
    several = F.max(F.col("own").isNull()).over(over) | (F.min("own").over(over) != F.max("own").over(over))
    matrix = saved(matrix.withColumn("_several", several).where("_several").drop("_several"), "matrix")
    other = matrix.select("token", *[F.col(c).alias(f"o_{c}") for c in ("g", "own", "least", "most")])
    apart = F.coalesce(F.col("own") != F.col("o_own"), F.lit(True)) & ((F.col("g") < F.col("o_g")) | ((F.col("g") == F.col("o_g")) & F.col("own").isNull()))
    fits = (F.col("most") * 4 >= F.col("o_least") * 3) & (F.col("o_most") * 4 >= F.col("least") * 3)
    k = matrix.join(other, "token").where(apart & fits).groupBy("g", "o_g", "least", "most", "o_least", "o_most").agg(F.count(F.lit(1)).alias("k"))
    k = saved(k.where(F.col("k") >= fewest_shared("least", "most", "o_least", "o_most")).select("g", "o_g"), "near-groups")
    of = groups.select("g", "members")
    k = k.join(of, "g").join(of.select(F.col("g").alias("o_g"), F.col("members").alias("o_members")), "o_g")
    swap = F.col("members") < F.col("o_members")
    return saved(k.select(F.when(swap, F.col("o_g")).otherwise(F.col("g")).alias("g"), F.when(swap, F.col("g")).otherwise(F.col("o_g")).alias("asks")), "group-pairs")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    texts = lean(docs.select(F.col("doc_id").cast("long"), "text"))
    measured = saved(texts.mapInArrow(measure, "doc_id bigint, n bigint, cls bigint, least array<bigint>, block bigint, counts binary"), "sets")
    rows = measured.where("block IS NULL")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    classes = saved(classes, "classes")
    frequent = spark.sparkContext.broadcast(frequencies(measured.where("block IS NOT NULL").select("block", "counts")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 4
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, total // BUCKET_TOKENS)
    packed = texts.mapInArrow(bucketer(frequent, buckets), "bucket bigint, tokens binary, cls binary")
    dealt = packed.repartition(max(partitions, buckets // 4), "bucket").sortWithinPartitions("bucket")
    posts = saved(dealt.mapInArrow(shared_tokens, ", ".join(f"{c} bigint" for c in ("token", "cls", *LEAD_COLUMNS))), "postings")

    nodes = posts.select("cls").distinct().join(classes.select("cls", "n"), "cls").withColumn("comp", F.col("cls")).withColumn("home", F.lit(None).cast("long"))
    nodes, known = contracted(texts, rows, posts, saved(nodes, "nodes"))
    members = grouped(nodes)
    pairs = group_pairs(posts, members)
    asks = members.select("cls", "comp", F.col("g").alias("asks"))
    queries = saved(pairs.join(asks, "asks").select("g", "cls", "comp"), "group-queries")
    if queries.limit(1).count():
        opened = members.select("g", "cls", "comp").join(pairs.select("g").distinct(), "g", "left_semi")
        known = more_sets(texts, known, queries.select("cls").unionByName(opened.select("cls")).distinct())
        found = saved(links(known, opened, queries), "found")
        if found.limit(1).count():
            nodes = merged(nodes, found)

    joined = saved(classes.join(nodes.select("cls", F.col("comp").alias("node")), "cls", "left").select("cls", "copies", "first", F.coalesce("node", "cls").alias("comp")), "class-components")
    low = joined.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    whole = attach_groups(joined, low, "comp", "size", joined.count())
    groups = saved(whole.where("copies > 1 OR _group IS NOT NULL").select("cls", "copies", F.coalesce("_group.component_id", "first").alias("component_id")), "set-groups")
    slim = rows.select("doc_id", "n", "cls")
    x = attach_groups(slim, groups, "cls", "copies", slim.count())
    return x.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_group.component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of each component, by doc_id (nulls last); rows that repeat a doc_id or lack one are documents of their own."""
    keyed = with_row_key(docs, "near-rows")
    found = similar_documents(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    ranked = found.join(keyed.select(ROW, F.col("doc_id").cast("long").alias("_id")), F.col("_key") == F.col(ROW))
    ranked = saved(ranked.select("component_id", F.struct(F.col("_id").isNull().alias("none"), "_id", F.col("_key").alias("key")).alias("place")), "near-places")
    groups = ranked.groupBy("component_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    later = attach_groups(ranked, groups, "component_id", "size", ranked.count()).where(F.col("place") != F.col("_group.first"))
    return without_rows(keyed, saved(later.select(F.col("place.key").alias(ROW)), "near-gone")).select(docs.columns)


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (keyed by ROW) but those in gone (ROW). Rows that a Bloom filter of gone rules out stay in place; of the others, those that are gone at all are looked up."""
    bloom = rows.sparkSession.sparkContext.broadcast(textscan.bloom_of(gone, ROW))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        found = np.zeros(len(keys), bool)
        found[textscan.maybe_in(bloom.value, textscan.mixed(keys.to_numpy(np.int64).view(np.uint64)))] = True
        return pd.Series(found)

    flagged = rows.withColumn("_tickloom_maybe", maybe(ROW))
    stay = flagged.where(~F.col("_tickloom_maybe"))
    return stay.unionByName(flagged.where("_tickloom_maybe").join(gone, ROW, "left_anti")).drop("_tickloom_maybe")


def op8_jaccard_groups(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
