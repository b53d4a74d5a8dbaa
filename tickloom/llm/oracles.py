"""DuckDB SQL with the rows of queries that plain SQL can express, written without the queries' methods."""

from __future__ import annotations

from tickloom.llm.shared import LOWER, UPPER

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"

_BITS = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: {_BITS}[strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, 5 * i + 1, 1)::INT * 16 + substr(bits, 5 * i + 2, 1)::INT * 8
    + substr(bits, 5 * i + 3, 1)::INT * 4 + substr(bits, 5 * i + 4, 1)::INT * 2 + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reached = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def seeded(text: str, seed: int = 7) -> str:
    return f"('0x' || substr(md5({text} || ':{seed}'), 1, 15))::BIGINT"


#: All quotients of all seats are ranked, source by source and shard by shard.
MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, {seeded('doc_id')} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][k % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / weight, k) AS place FROM w),
t AS MATERIALIZED (SELECT source, source_size, k, least(cap, coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= cap) * weight, cap)) AS target, greatest(ceil(source_size / 1000000), 1)::BIGINT AS shards FROM l),
m AS (SELECT round(sum(target) / 16)::BIGINT AS seats FROM t),
q AS (SELECT k, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, k) AS place FROM (SELECT k, target, unnest(range(1, (target / 16)::BIGINT + 3)) AS seat FROM t WHERE target > 0)),
quota AS (SELECT k, count(*) AS quota FROM q, m WHERE place <= seats GROUP BY k),
x AS MATERIALIZED (SELECT d.*, t.source_size, t.target, t.k, h % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
sh AS (SELECT k, shard, sum(size)::BIGINT AS words, coalesce(any_value(quota), 0) AS quota FROM x LEFT JOIN quota USING (k) GROUP BY k, shard),
sq AS (SELECT k, shard, quota, row_number() OVER (PARTITION BY k ORDER BY words / (2 * seat - 1) DESC, shard) AS place FROM (SELECT *, unnest(range(1, (quota * words // greatest(sum(words) OVER (PARTITION BY k), 1) + count(*) OVER (PARTITION BY k) + 3)::BIGINT)) AS seat FROM sh) WHERE words > 0),
ss AS (SELECT k, shard, count(*) AS seats FROM sq WHERE place <= quota GROUP BY k, shard),
b AS (SELECT k, shard, (words + 15) // 16 AS blocks, least(coalesce(seats, 0), 2 * ((words + 15) // 16)) AS seats, {seeded("(k || '/' || shard)")} AS turn FROM sh LEFT JOIN ss USING (k, shard)),
y AS (SELECT *, sum(size) OVER (PARTITION BY k, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop FROM x)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE seats // blocks * size + coalesce(list_sum(list_transform(range((stop - size) // 16, (stop - 1) // 16 + 1),
  lambda j: CASE WHEN (j * 1000003 + turn % blocks) % blocks < seats % blocks THEN least(stop, 16 * j + 16) - greatest(stop - size, 16 * j) ELSE 0 END)), 0) END::BIGINT AS taken
FROM y JOIN b USING (k, shard)
"""
