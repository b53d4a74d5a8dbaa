"""DuckDB SQL that gives the rows of tickloom.queries, written against the tables alone."""

from __future__ import annotations

from tickloom.functions.display import EXCHANGES
from tickloom.plans.report import LISTED, METRICS
from tickloom.queries import weights


def ticks(key: str = "event_type") -> str:
    return f"""t AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY instrument) AS n, lag(price) OVER w AS before FROM (
  SELECT {key}::VARCHAR AS instrument, event_id AS ord, epoch_ns(ts) AS ts_ns, value AS price, (props->>'$.k')::DOUBLE AS volume FROM events)
  WINDOW w AS (PARTITION BY instrument ORDER BY ts_ns, ord))"""


NAN, INF = "'nan'::DOUBLE", "'inf'::DOUBLE"


def div(x: str, y: str) -> str:
    """x / y by IEEE rules."""
    return f"CASE WHEN ({y}) = 0 THEN CASE WHEN isnan({x}) OR ({x}) = 0 THEN {NAN} WHEN ({x}) > 0 THEN {INF} ELSE -{INF} END ELSE ({x}) / ({y}) END"


def log(x: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN -{INF} WHEN isnan({x}) OR ({x}) < 0 THEN {NAN} ELSE ln({x}) END"


def deviation(x: str, over: str = "") -> str:
    """Population deviation; NaN where a value isn't finite (DuckDB's own raises)."""
    return f"CASE WHEN count(CASE WHEN NOT isfinite({x}) THEN 1 END) {over} > 0 THEN {NAN} ELSE stddev_pop(CASE WHEN isfinite({x}) THEN {x} END) {over} END"


def rolled(w: int, keys: str = "instrument") -> str:
    """mean, std and vwap of the last w rows."""
    over = f"OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    full = f"count(*) {over} >= {w}"
    return f"""CASE WHEN {full} THEN avg(price) {over} END AS mean, CASE WHEN {full} THEN {deviation('price', over)} END AS std,
  CASE WHEN {full} AND sum(volume) {over} > 0 THEN sum(price * volume) {over} / sum(volume) {over} END AS vwap"""


def r(x: str, digits: int = 6) -> str:
    """Rounded; NaN as null."""
    return f"CASE WHEN NOT isnan({x}) THEN CASE WHEN isinf({x}) THEN {x} ELSE round({x}, {digits}) + 0.0 END END"


def features(w: int) -> str:
    return f"WITH {ticks()}, f AS (SELECT instrument, ord, {rolled(w)} FROM t) SELECT instrument, ord, {r('mean', 8)} AS mean, {r('std', 8)} AS std, {r('vwap', 8)} AS vwap FROM f"


def recursion(name: str, source: str, keys: str, x: str, alpha: float, first: str = "value") -> str:
    """y = alpha x + (1 - alpha) y' along place, by keys."""
    start = x if first == "value" else f"{alpha} * {x}"
    joined = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, place, ({start})::DOUBLE AS y FROM {source} WHERE place = 1
  UNION ALL SELECT {', '.join('s.' + k for k in keys.split(', '))}, s.place, {alpha}::DOUBLE * s.{x} + (1 - {alpha}::DOUBLE) * p.y FROM {name} p JOIN {source} s ON {joined} AND s.place = p.place + 1)"""


def ema(key: str = "event_type") -> str:
    return f"WITH RECURSIVE {ticks(key)}, src AS MATERIALIZED (SELECT instrument, rn AS place, price, ord FROM t), {recursion('e', 'src', 'instrument', 'price', 0.1)} SELECT instrument, ord, {r('y')} AS ema FROM e JOIN src USING (instrument, place)"


MATRIX = "m AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def rows(expression: str, digits: int, extra: str = "") -> str:
    return f"WITH {MATRIX}{extra}, y AS (SELECT row_id, {expression} AS y FROM {'h' if extra else 'm'}) SELECT row_id, unnest(range(0, len(y))) AS j, {r('unnest(y)', digits)} AS v FROM y"


NORMED = "list_transform(x, lambda v: (v - list_avg(x)) / sqrt(list_avg(list_transform(x, lambda u: (u - list_avg(x)) * (u - list_avg(x)))) + 1e-5))"
SOFT = "list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x)))))"
# erf by its series of positive terms: exp(-x^2) 2/sqrt(pi) sum 2^k x^(2k+1) / (2k+1)!!.
SERIES = "list_sum(list_transform(range(0, 120), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(a) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))"


def gelu() -> str:
    return f"""WITH {MATRIX}, c AS (SELECT row_id, unnest(range(0, len(x))) AS j, unnest(x) AS v FROM m), e AS (SELECT *, abs(v) / sqrt(2) AS a FROM c),
f AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE sign(v) * 2 / sqrt(pi()) * exp(-a * a) * {SERIES} END AS erf FROM e) SELECT row_id, j, {r('0.5 * v * (1 + erf)', 9)} AS v FROM f"""


def mlp() -> str:
    columns = list(zip(*weights(), strict=True))
    products = ", ".join("list_sum(list_transform(list_zip(x, [" + ", ".join(map(str, c)) + "]), lambda z: z[1] * z[2]))" for c in columns)
    return f"WITH {MATRIX}, p AS (SELECT row_id, [{products}] AS x FROM m), h AS (SELECT row_id, {NORMED} AS x FROM p), y AS (SELECT row_id, {SOFT} AS y FROM h) SELECT row_id, unnest(range(0, len(y))) AS j, {r('unnest(y)', 9)} AS v FROM y"


def reports(key: str = "event_type", source: str = "t", head: bool = True) -> str:
    """CTE rep: all metrics, not rounded."""
    return (f"{ticks(key)}, " if head else "") + f"""
m AS (SELECT *, {div('price', 'before')} AS ratio, max(CASE WHEN isnan(price) THEN -{INF} ELSE price END) OVER (PARTITION BY instrument ORDER BY rn) AS high,
  row_number() OVER (PARTITION BY instrument ORDER BY volume, ord) - 1 AS vi FROM {source}),
s AS (SELECT *, {log('ratio')} AS r, {div('price', 'high')} - 1 AS dd, least(20, n // 2) AS w FROM m),
q AS (SELECT instrument, max(volume) FILTER (vi = n // 2) AS median_volume, max(volume) FILTER (vi = floor(0.9 * (n - 1))) AS block_threshold FROM s GROUP BY instrument),
a AS (SELECT instrument, max(n) AS rows, max(w) AS window_, arg_min(price, rn) AS first_, arg_max(price, rn) AS last_, 
  CASE WHEN isnan(arg_min(price, rn)) THEN {NAN} ELSE min(price) END AS min_, CASE WHEN isnan(arg_min(price, rn)) THEN {NAN} ELSE max(price) FILTER (NOT isnan(price)) END AS max_, avg(r) AS mu, {deviation('r')} AS sd_,
  least(coalesce(min(dd) FILTER (NOT isnan(dd)), {INF}), 0.0) AS mdd, count(*) FILTER (r > 0 AND NOT isnan(r)) AS up, max(r) FILTER (NOT isnan(r)) AS best, min(r) FILTER (NOT isnan(r)) AS worst, sum(volume) AS total_volume, sum(price * volume) AS dollar_volume,
  coalesce(sum(volume) FILTER (r > 0 AND NOT isnan(r)), 0) AS upv, coalesce(sum(volume) FILTER (r < 0), 0) AS downv, count(*) FILTER (volume >= block_threshold) AS block_days,
  avg(price) FILTER (rn > n - w) AS latest_mean, sum(price * volume) FILTER (rn > n - w) AS pv, sum(volume) FILTER (rn > n - w) AS lv, any_value(median_volume) AS median_volume, any_value(block_threshold) AS block_threshold
  FROM s JOIN q USING (instrument) WHERE n >= 8 GROUP BY instrument),
d AS (SELECT *, CASE WHEN isnan(sd_) OR sd_ <= 1e-15 THEN 0 ELSE sd_ END AS sd FROM a),
rep AS (SELECT instrument, rows, window_ AS "window", first_ AS "first", last_ AS "last", min_ AS "min", max_ AS "max", ({div('last_', 'first_')} - 1) * 100 AS total_return_pct, mu * 252 * 100 AS ann_return_pct,
  sd * sqrt(252) * 100 AS ann_vol_pct, CASE WHEN sd > 0 THEN mu * 252 / (sd * sqrt(252)) ELSE 0 END AS sharpe, mdd * 100 AS max_drawdown_pct, mu * 100 AS mean_daily_pct, up / (rows - 1) AS win_rate,
  best * 100 AS best_day_pct, worst * 100 AS worst_day_pct, total_volume / rows AS avg_volume, median_volume, total_volume, block_threshold, block_days, dollar_volume,
  CASE WHEN upv + downv > 0 THEN upv / (upv + downv) ELSE 0 END AS up_volume_frac, upv - downv AS obv_last, CASE WHEN lv > 0 THEN pv / lv END AS latest_vwap, latest_mean, upv + downv AS moved FROM d)"""


def shown(names: list[str], digits: int, coarse: tuple = ()) -> str:
    return ", ".join(f'{r(chr(34) + n + chr(34), 2 if n in coarse else digits)} AS "{n}"' for n in names)


TABLE = ["total_return_pct", "ann_vol_pct", "sharpe", "max_drawdown_pct", "median_volume", "block_days", "latest_vwap", "latest_mean"]
LIVE = ["first", "last", "min", "max", "total_return_pct", "ann_return_pct", "win_rate", "median_volume", "obv_last", "latest_mean", "latest_vwap"]


def live() -> str:
    patched = """l AS (SELECT instrument, ord, ts_ns, rn, n, before, CASE WHEN rn = n THEN price * 1.1 ELSE price END AS price, CASE WHEN rn = n THEN 50.0 ELSE volume END AS volume FROM t)"""
    old = reports().replace("s AS (", "s0 AS (").replace("FROM s ", "FROM s0 ").replace("q AS (", "q0 AS (").replace("JOIN q ", "JOIN q0 ").replace("\na AS (", "\na0 AS (").replace("m AS (", "m0 AS (").replace("FROM m)", "FROM m0)").replace("\nd AS (", "\nd0 AS (").replace("FROM a)", "FROM a0)").replace("FROM d)", "FROM d0)").replace("rep AS (", "old AS (")
    return f"WITH {old}, {patched}, {reports(source='l', head=False)} SELECT instrument, " + ", ".join(f'{r(("old" if n in ("median_volume", "obv_last") else "rep") + "." + chr(34) + n + chr(34), 5)} AS "{n}"' for n in LIVE) + " FROM rep JOIN old USING (instrument)"


def market() -> str:
    return f"""WITH RECURSIVE {ticks()}, b AS (SELECT *, (rn - 1) // 1000 AS batch, (rn - 1) % 1000 + 1 AS place FROM t),
f AS MATERIALIZED (SELECT instrument, batch, place, price, {rolled(20, 'instrument, batch')}, coalesce({log('ratio')}, 0) AS ret
  FROM (SELECT *, {div('price', 'lag(price) OVER (PARTITION BY instrument, batch ORDER BY rn)')} AS ratio FROM b)),
{recursion('e', 'f', 'instrument, batch', 'price', 0.08)},
s AS MATERIALIZED (SELECT instrument, batch, place, CASE WHEN place >= 20 AND std > 1e-12 AND NOT isnan(std) AND vwap IS NOT NULL THEN CASE WHEN isnan(ret) THEN ret ELSE
  greatest(-1, least(1, -0.35 * ((price - 0.5 * (mean + vwap)) / std) + 2000 * ret + 0.05 * CASE WHEN y >= mean AND NOT isnan(y) THEN 1 ELSE -1 END)) END ELSE 0 END::DOUBLE AS signal FROM f JOIN e USING (instrument, batch, place)),
{recursion('x', 's', 'instrument, batch', 'signal', 0.02, 'zero')}
SELECT instrument, batch, count(*) AS n, {r('sum(y * ((place - 1) % 17 + 1))', 5)} AS checksum FROM x GROUP BY instrument, batch"""


def listed() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(n)}, [{', '.join(map(quote, al))}])" for s, n, _, _, al in LISTED)
    key = f"regexp_replace(regexp_replace(regexp_replace(symbol, '^\\^', ''), '\\.({'|'.join(EXCHANGES)})$', '', 'i'), '-USD$', '')"
    return f"u AS (SELECT *, {key} AS key FROM (VALUES {values}) v(symbol, name, aliases))"


REGIONS = "CASE WHEN symbol LIKE '%.NS' OR symbol LIKE '%.BO' THEN 'India' WHEN symbol LIKE '%-USD' THEN 'Crypto' WHEN symbol LIKE '^%' THEN 'Index' WHEN symbol LIKE '%.L' THEN 'UK' WHEN symbol LIKE '%.KS' THEN 'Korea' WHEN symbol LIKE '%.TO' THEN 'Canada' WHEN symbol LIKE '%.HK' THEN 'Hong Kong' ELSE 'US' END"
SEARCH = """, q AS (SELECT unnest(['ta', 's&p', 'n', 'bitcoin', 'zzz']) AS q), k AS (SELECT q, symbol, key, CASE WHEN lower(key) = q THEN 0 WHEN starts_with(lower(key), q) THEN 1 WHEN starts_with(lower(name), q) THEN 2
  WHEN len(list_filter(aliases, lambda a: starts_with(a, q))) > 0 THEN 3 WHEN contains(lower(key), q) OR contains(lower(name), q) OR len(list_filter(aliases, lambda a: contains(a, q))) > 0 THEN 4 END AS rank FROM u, q)
SELECT q, symbol, key, rank FROM k WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank, lower(key), symbol) <= 10"""

BIG = "CASE WHEN v >= 1e12 THEN printf('%.2fT', v / 1e12) WHEN v >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END"



def queue(step: str) -> str:
    """q: the trace of channel_trace with the level y after each event, one event at a time."""
    return f"""WITH RECURSIVE e AS (SELECT event_type::VARCHAR AS channel, event_id * 2 + 1 AS moment, 1 AS step FROM events UNION ALL SELECT event_type::VARCHAR, event_id * 2, -1 FROM events WHERE event_id % 3 = 0),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY moment) AS place FROM e),
q AS (SELECT channel, place, step, greatest(step, 0)::BIGINT AS y, 0::BIGINT AS old FROM p WHERE place = 1
  UNION ALL SELECT p.channel, p.place, p.step, ({step})::BIGINT, q.y FROM q JOIN p ON p.channel = q.channel AND p.place = q.place + 1)"""


ORACLES = {
    "market_pipeline": market(),
    "rolling_features": features(20),
    "rolling_one_row": features(1),
    "rolling_online_mean": f"WITH {ticks()} SELECT instrument, ord, {r('avg(price) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)', 8)} AS mean FROM t",
    "rolling_by_batch": f"WITH {ticks()}, b AS (SELECT *, (rn - 1) // 256 AS batch FROM t), f AS (SELECT instrument, ord, batch, {rolled(20, 'instrument, batch')} FROM b) SELECT instrument, ord, batch, {r('mean', 8)} AS mean, {r('std', 8)} AS std, {r('vwap', 8)} AS vwap FROM f",
    "rolling_halo": features(20),
    "returns_drawdown_obv": f"""WITH {ticks()} SELECT instrument, ord, {r('ret')} AS ret, {r('dd')} AS dd, {r('obv')} AS obv FROM (SELECT instrument, ord, coalesce({log('ratio')}, 0) AS ret, {div('price', 'high')} - 1 AS dd, sum(flow) OVER w AS obv
  FROM (SELECT *, {div('price', 'before')} AS ratio, CASE WHEN isnan(price - before) THEN 0 ELSE coalesce(sign(price - before), 0) END * volume AS flow, max(CASE WHEN isnan(price) THEN -{INF} ELSE price END) OVER w AS high FROM t WINDOW w AS (PARTITION BY instrument ORDER BY rn)) WINDOW w AS (PARTITION BY instrument ORDER BY rn))""",
    "zscore": f"WITH {ticks()}, s AS (SELECT *, avg(price) OVER w AS mean, {deviation('price', 'OVER w')} AS sd FROM t WINDOW w AS (PARTITION BY instrument)) SELECT instrument, ord, {r('CASE WHEN sd = 0 THEN 0 ELSE (price - mean) / sd END')} AS z FROM s",
    "ema": ema(),
    "ema_chunked": ema(),
    "ema_folded": ema("user_id"),
    "reduce_sum_max_dot": f"WITH {ticks()} SELECT instrument, {r('sum(price)', 3)} AS price_sum, {r('max(price)', 3)} AS price_max, {r('sum(price * volume)', 3)} AS price_dot_volume, count(*) AS n FROM t GROUP BY instrument",
    "order_statistics": f"WITH {reports()} SELECT instrument, median_volume, block_threshold, block_days FROM rep",
    "nearest_rank": f"WITH {ticks()}, s AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY price, ord) - 1 AS i FROM t) SELECT instrument, max(price) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(price) FILTER (i = floor(0.99 * (n - 1))) AS p99 FROM s GROUP BY instrument",
    "latency_percentiles": f"""WITH {ticks()}, s AS (SELECT *, floor(price * 1000) AS ns FROM t), b AS (SELECT instrument, n, ns, (SELECT min(k) FROM range(0, 24) g(k) WHERE ns <= 64 * (1 << k) OR k = 23) AS bucket FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket) AS i FROM b) SELECT instrument, {', '.join(f"CASE WHEN floor(max(n) * {p}) = 0 THEN 64 ELSE 64 * (1 << max(bucket) FILTER (i = floor(n * {p}))) END::BIGINT AS {c}" for p, c in ((0.5, 'p50'), (0.99, 'p99'), (0.999, 'p99_9')))} FROM o GROUP BY instrument""",
    "weighted_checksum": f"WITH {ticks()} SELECT instrument, {r('sum(price * ((rn - 1) % 17 + 1))', 3)} AS checksum FROM t GROUP BY instrument",
    "zone_map": "SELECT o_orderpriority AS instrument, count(*) AS n, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, 1.0::DOUBLE AS min_volume, 1.0::DOUBLE AS max_volume, min(epoch_ns(o_orderdate))::DOUBLE AS min_ts_ns, max(epoch_ns(o_orderdate))::DOUBLE AS max_ts_ns FROM orders GROUP BY 1",
    "expression_feature": f"""WITH RECURSIVE {ticks()}, src AS MATERIALIZED (SELECT instrument, rn AS place, price, ord FROM t), {recursion('e', 'src', 'instrument', 'price', 0.1)},
f AS (SELECT instrument, rn AS place, {rolled(50)} FROM t), g AS (SELECT instrument, rn AS place, {rolled(20)} FROM t)
SELECT instrument, ord, {r('f.vwap - y')} AS feature, {r('CASE WHEN g.std = 0 THEN NULL ELSE (price - g.mean) / g.std END')} AS score, {r('7 + price / 2')} AS plain FROM src JOIN e USING (instrument, place) JOIN f USING (instrument, place) JOIN g USING (instrument, place)""",
    "softmax": rows(SOFT, 9),
    "layernorm": rows(NORMED, 6),
    "gelu": gelu(),
    "matmul": f"WITH {MATRIX}, c AS (SELECT row_id, unnest(range(0, len(x))) AS j, unnest(x) AS v FROM m) SELECT a.j AS i, b.j AS j, {r('sum(a.v * b.v)')} AS v FROM c a JOIN c b USING (row_id) GROUP BY 1, 2",
    "mlp": mlp(),
    "instrument_report": f"WITH {reports()} SELECT instrument, rows, \"window\", {shown(METRICS, 6, ('dollar_volume', 'total_volume'))} FROM rep",
    "report_table": f"WITH {reports('user_id')} SELECT instrument, rows, \"window\", {shown(TABLE, 5)} FROM rep",
    "live_update": live(),
    "downsample": f"WITH {ticks()} SELECT instrument, ord, {r('price')} AS price FROM t WHERE (rn - 1) % greatest(1, n // 120) = 0",
    "shown_numbers": f"SELECT o_orderkey, CASE WHEN p >= 0 THEN '+' ELSE '' END || printf('%.2f%%', p) AS pct, {BIG} AS big, CASE WHEN v < 1e6 THEN printf('%.0f ns', v / 1e3) WHEN v < 1e9 THEN printf('%.1f µs', v / 1e6) ELSE printf('%.2f ms', v / 1e9) END AS lat FROM (SELECT o_orderkey, o_totalprice * 1.000371::DOUBLE / 1000 - 100 AS p, o_totalprice * 1.000371::DOUBLE * 1000 AS v FROM orders)",
    "regions": f"WITH {listed()} SELECT symbol, {REGIONS} AS market, key FROM u",
    "search": f"WITH {listed()}{SEARCH}",
    "time_range": "SELECT event_id, event_type, round(value, 6) AS value FROM events, (SELECT min(ts) AS a, max(ts) AS b FROM events) WHERE ts >= a + (b - a) / 4 AND ts <= b - (b - a) / 4",
    "replay_batches": f"WITH {ticks()} SELECT instrument, (rn - 1) // 500 AS batch, count(*) AS n, {r('sum(price)', 4)} AS price_sum FROM t GROUP BY 1, 2",
    "bounded_channel": f"{queue('least(64, greatest(0, q.y + p.step))')} SELECT channel, count(*) FILTER (step = 1 AND old < 64) AS accepted, count(*) FILTER (step = 1 AND old = 64) AS dropped, max(y) AS most FROM q GROUP BY channel",
    "blocking_channel": f"{queue('greatest(0, q.y + p.step)')} SELECT channel, count(*) FILTER (step = 1 AND y <= 64) AS accepted, count(*) FILTER (step = 1 AND y > 64) AS waited, least(64, max_by(y, place)) AS depth, greatest(0, max(y) - 64) AS most_waiting FROM q GROUP BY channel",
    "sequence_gaps": f"WITH {ticks()}, g AS (SELECT instrument, ord - lag(ord) OVER (PARTITION BY instrument ORDER BY ord) - 1 AS missing FROM t) SELECT instrument, count(*) AS n_gaps, sum(missing)::BIGINT AS n_missing FROM g WHERE missing <> 0 GROUP BY 1",
    "analytics_chain": f"""WITH RECURSIVE {ticks()}, src AS MATERIALIZED (SELECT instrument, rn AS place, price, ord FROM t), {recursion('e', 'src', 'instrument', 'price', 0.1)},
m AS (SELECT instrument, place, y, avg(y) OVER w AS mean, {deviation('y', 'OVER w')} AS sd FROM e WINDOW w AS (PARTITION BY instrument)),
z AS (SELECT instrument, place, y, CASE WHEN sd = 0 THEN 0 ELSE (y - mean) / sd END AS z FROM m)
SELECT instrument, ord, {r('y')} AS ema, {r('z')} AS z, CASE WHEN z > 1 AND NOT isnan(z) THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM z JOIN src USING (instrument, place)""",
}
