"""The catalogue's queries as SQL for another engine, written from their definitions."""

from __future__ import annotations

#: Fixed values, written out here so that a change of the operators' own cannot pass unseen.
LOOSE = dict(oversold=40.0, overbought=60.0, vol_mult=1.0)
POSITIVE, NEGATIVE, ALIASES = ['good', 'great', 'thanks', 'the', 'for'], ['bad', 'worthless', 'no', 'not', 'of'], ['tion', 'worthless']
RULES = [
    (1, "1a", "market", "return_pct > 2", "bull", 1.0),
    (1, "1b", "market", "return_pct < -2", "bear", 1.0),
    (1, "1c", "market", "return_pct between -2 and 2", "neutral", 0.5),
    (2, "2a", "vegas_channel", "trend = 'bullish_aligned'", "bull", 1.2),
    (2, "2b", "vegas_channel", "trend = 'bearish_aligned'", "bear", 1.2),
    (3, "3", "vegas_channel", "not aligned", "neutral", 1.0),
    (4, "4a", "vegas_channel", "rsi > 80", "bear", 1.0),
    (4, "4b", "vegas_channel", "rsi < 20", "bull", 1.0),
    (5, "5", "vegas_channel", "volume_spike", "neutral", 0.8),
    (6, "6a", "derivatives", "funding_bias = 'long_crowded'", "bear", 1.1),
    (6, "6b", "derivatives", "funding_bias = 'short_crowded'", "bull", 1.1),
    (6, "6c", "derivatives", "funding_bias = 'balanced'", "neutral", 0.5),
    (7, "7a", "long_short_ratio", "ratio_bias = 'long_dominant'", "bear", 0.9),
    (7, "7b", "long_short_ratio", "ratio_bias = 'short_dominant'", "bull", 0.9),
    (8, "8a", "social", "sentiment = 'positive'", "bull", 0.4),
    (8, "8b", "social", "sentiment = 'negative'", "bear", 0.4),
    (9, "9a", "macro", "fear_greed <= 25", "bull", 0.9),
    (9, "9b", "macro", "fear_greed >= 75", "bear", 0.9),
    (9, "9c", "macro", "fear_greed > 25 and fear_greed < 75", "neutral", 0.5),
    (10, "10a", "macro", "risk_appetite = 'deteriorating'", "bear", 0.8),
    (10, "10b", "macro", "risk_appetite = 'improving'", "bull", 0.8),
    (11, "11", "announcement", "announcements > 0", "neutral", 0.4),
    (12, "12a", "tvl", "change_30d is not null and tvl_direction = 'expanding'", "bull", 0.7),
    (12, "12b", "tvl", "change_30d is not null and tvl_direction = 'contracting'", "bear", 0.7),
    (12, "12c", "tvl", "change_30d is not null and tvl_direction not in ('expanding', 'contracting')", "neutral", 0.4),
]
SOURCES = [
    (0, "market", "market_agent"),
    (1, "news", "news_agent"),
    (2, "macro", "macro_agent"),
    (3, "announcement", "macro_agent"),
    (4, "onchain", "onchain_agent"),
    (5, "social", "social_agent"),
    (6, "derivatives", "technical_agent"),
    (7, "whale", "onchain_agent"),
    (8, "vegas_channel", "technical_agent"),
    (9, "long_short_ratio", "technical_agent"),
    (10, "tvl", "onchain_agent"),
]


def r(x: str, d: int = 2) -> str:
    return f"(round(({x})::DOUBLE * {10**d}::DOUBLE) / {10**d}::DOUBLE)"


DIMS = "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
REGION = f"""days AS (SELECT r_name AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS bar, {r("avg(l_extendedprice / l_quantity)", 4)} AS close,
  {r("max(l_extendedprice / l_quantity)", 4)} AS high, {r("min(l_extendedprice / l_quantity)", 4)} AS low, {r("sum(l_quantity)", 4)} AS volume,
  count(*) AS n FROM lineitem {DIMS} GROUP BY ALL),
bars AS (SELECT symbol, bar, close AS open, high, low, close, volume, n, (row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1)::INT AS idx FROM days)"""


def events(minutes: int, name: str = "bars") -> str:
    return f"""{name}_t AS (SELECT event_type AS symbol, strftime(time_bucket(INTERVAL '{minutes} minutes', ts), '%Y-%m-%d %H:%M') AS bar,
  {r("arg_min(value, (ts, event_id))", 4)} AS open, {r("max(value)", 4)} AS high, {r("min(value)", 4)} AS low,
  {r("arg_max(value, (ts, event_id))", 4)} AS close, {r("sum(value)", 4)} AS volume, count(*) AS n FROM events GROUP BY 1, 2),
{name} AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1)::INT AS idx FROM {name}_t)"""


BY = "PARTITION BY symbol ORDER BY idx"
RUN = f"({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


PERIODS = (144, 233, 377, 610, 987)


def walk(source: str, out: str, periods: tuple = PERIODS) -> str:
    """`source` with e<period>, v144 (of volume) and rsi, bar after bar as the recurrences say."""
    up, down = "greatest(b.close - w.last, 0)", "greatest(w.last - b.close, 0)"

    def ema(x: str, total: str, name: str, p: int) -> str:
        k = f"(2.0::DOUBLE / {p + 1})"
        return f"CASE WHEN b.idx < {p - 1} THEN NULL WHEN b.idx = {p - 1} THEN (w.{total} + b.{x}) / {p} ELSE b.{x} * {k} + w.{name} * (1 - {k}) END"

    def wilder(move: str, total: str, name: str) -> str:
        return f"CASE WHEN b.idx < 6 THEN NULL WHEN b.idx = 6 THEN (w.{total} + {move}) / 6 ELSE (w.{name} * 5 + {move}) / 6 END"

    return f"""{out}_w AS (SELECT symbol, idx, close AS last, close AS csum, volume AS vsum, 0.0::DOUBLE AS ups, 0.0::DOUBLE AS downs,
  {", ".join(f"NULL::DOUBLE AS e{p}" for p in periods)}, NULL::DOUBLE AS v144, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM {source} WHERE idx = 0
  UNION ALL SELECT b.symbol, b.idx, b.close, w.csum + b.close, w.vsum + b.volume, w.ups + {up}, w.downs + {down},
  {", ".join(ema("close", "csum", f"e{p}", p) for p in periods)}, {ema("volume", "vsum", "v144", 144)}, {wilder(up, "ups", "g")}, {wilder(down, "downs", "l")}
  FROM {out}_w w JOIN {source} b ON b.symbol = w.symbol AND b.idx = w.idx + 1),
{out} AS (SELECT b.*, {", ".join(f"e{p}" for p in periods)}, v144, CASE WHEN g IS NULL THEN NULL WHEN l = 0 THEN 100.0 WHEN g = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS rsi
  FROM {source} b JOIN {out}_w w ON b.symbol = w.symbol AND b.idx = w.idx)"""


def ribbon(source: str, out: str) -> str:
    less = " AND ".join(f"e{a} < e{b}" for a, b in zip(PERIODS, PERIODS[1:]))
    inside = " OR ".join(f"{c} BETWEEN tb AND tt" for c in ("close", "high", "low"))
    return f"""{walk(source, out + "_e")},
{out}_t AS (SELECT *, CASE WHEN e987 IS NOT NULL THEN greatest(e144, e987) END AS tt, CASE WHEN e987 IS NOT NULL THEN least(e144, e987) END AS tb FROM {out}_e),
{out} AS (SELECT *, coalesce({less.replace("<", ">")}, false) AS bull, coalesce({less}, false) AS bear, coalesce({inside}, false) AS in_tunnel FROM {out}_t)"""


def strat(source: str, out: str, oversold: float = 20.0, overbought: float = 80.0, vol_mult: float = 2.0) -> str:
    return f"""{ribbon(source, out + "_b")},
{out}_v AS (SELECT *, coalesce(volume > {vol_mult} * v144, false) AS volume_spike,
  CASE WHEN rsi < {oversold} THEN -1 WHEN rsi > {overbought} THEN 1 ELSE 0 END AS zone FROM {out}_b),
{out}_n AS (SELECT *, coalesce((zone <> lag(zone) OVER ({BY}))::INT, 0) AS fresh FROM {out}_v),
{out}_i AS (SELECT *, sum(fresh) OVER {RUN} AS island FROM {out}_n),
{out}_s AS (SELECT *, zone * max(volume_spike::INT) OVER (PARTITION BY symbol, island ORDER BY idx ROWS UNBOUNDED PRECEDING) AS spiked FROM {out}_i),
{out}_w AS (SELECT *, lag(spiked) OVER ({BY}) AS was, lag(rsi) OVER ({BY}) AS before FROM {out}_s),
{out}_x AS (SELECT *, CASE
  WHEN before < {oversold} AND rsi >= {oversold} AND bull AND in_tunnel AND was = -1 THEN 'bull_entry'
  WHEN before > {overbought} AND rsi <= {overbought} AND bear AND in_tunnel AND was = 1 THEN 'bear_entry'
  WHEN before > {overbought} AND rsi <= {overbought} AND was = 1 THEN 'take_profit_bull'
  WHEN before < {oversold} AND rsi >= {oversold} AND was = -1 THEN 'take_profit_bear' END AS any_signal FROM {out}_w),
{out} AS (SELECT *, CASE WHEN idx >= 988 THEN any_signal END AS signal,
  CASE WHEN bull THEN 'bullish_aligned' WHEN bear THEN 'bearish_aligned' ELSE 'mixed' END AS trend FROM {out}_x)"""


def latest(source: str, out: str, least: int = 988) -> str:
    return f"""{out}_l AS (SELECT *, last_value(any_signal IGNORE NULLS) OVER {RUN} AS last_signal,
  last_value(CASE WHEN any_signal IS NOT NULL THEN idx END IGNORE NULLS) OVER {RUN} AS at_idx, count(*) OVER (PARTITION BY symbol) AS total FROM {source}),
{out} AS (SELECT symbol, bar, trend, {r("tt", 4)} AS tunnel_top, {r("tb", 4)} AS tunnel_bottom, in_tunnel, {r("rsi", 4)} AS rsi, volume_spike,
  last_signal, (idx - at_idx)::INT AS bars_since_signal FROM {out}_l WHERE idx = total - 1 AND total >= {least})"""


LOOSE_STATES = f"WITH RECURSIVE {REGION}, {strat('bars', 'st', **LOOSE)}"
FEE = "0.998001::DOUBLE"
POSITIONS = """p1 AS (SELECT symbol, bar, idx, close, variant, CASE WHEN variant = 'long_only' AND signal = 'bear_entry' THEN NULL ELSE signal END AS s
  FROM st, (VALUES ('long_only'), ('long_short')) v(variant)),
p2 AS (SELECT *, CASE s WHEN 'bull_entry' THEN 'long' WHEN 'bear_entry' THEN 'short' END AS entry FROM p1),
p3 AS (SELECT *, last_value(entry IGNORE NULLS) OVER w AS side, count(entry) OVER w AS seg FROM p2
  WINDOW w AS (PARTITION BY symbol, variant ORDER BY idx ROWS UNBOUNDED PRECEDING)),
p4 AS (SELECT *, max(coalesce((CASE s WHEN 'take_profit_bull' THEN 'long' WHEN 'take_profit_bear' THEN 'short' END = side)::INT, 0))
  OVER (PARTITION BY symbol, variant, seg ORDER BY idx ROWS UNBOUNDED PRECEDING) AS gone FROM p3),
p5 AS (SELECT *, CASE WHEN gone = 0 THEN side END AS state FROM p4),
held AS (SELECT *, lag(state) OVER (PARTITION BY symbol, variant ORDER BY idx) AS prior FROM p5)"""
TRADES = f"""ends AS (SELECT symbol, variant, max(idx) AS li, arg_max(bar, idx) AS lb, arg_max(close, idx) AS lc FROM held GROUP BY 1, 2),
chg AS (SELECT *, lead(idx) OVER w AS ni, lead(bar) OVER w AS nb, lead(close) OVER w AS nc, lead(state) OVER w AS ns
  FROM held WHERE state IS DISTINCT FROM prior WINDOW w AS (PARTITION BY symbol, variant ORDER BY idx)),
opened AS (SELECT symbol, variant, state AS side, idx AS entry_idx, coalesce(ni, li) AS exit_idx, bar AS entry_date, coalesce(nb, lb) AS exit_date,
  close AS pin, coalesce(nc, lc) AS pout, CASE WHEN ni IS NULL THEN 'end_of_data' WHEN ns IS NULL THEN 'take_profit' ELSE 'reverse' END AS exit_reason
  FROM chg JOIN ends USING (symbol, variant) WHERE state IS NOT NULL),
tr AS (SELECT *, (1 + CASE side WHEN 'long' THEN 1 ELSE -1 END * (pout - pin) / pin) * {FEE} - 1 AS net FROM opened),
trades AS (SELECT *, {r("net * 100", 2)} AS return_pct, exit_idx - entry_idx AS bars_held FROM tr)"""
EQUITY = f"""q1 AS (SELECT h.*, c.net AS cnet, o.entry_idx IS NOT NULL AS opens FROM held h
  LEFT JOIN trades c ON h.symbol = c.symbol AND h.variant = c.variant AND h.idx = c.exit_idx AND c.exit_reason <> 'end_of_data'
  LEFT JOIN trades o ON h.symbol = o.symbol AND h.variant = o.variant AND h.idx = o.entry_idx),
q2 AS (SELECT *, coalesce(product(1 + coalesce(cnet, 0)) OVER w, 1) AS done, last_value(CASE WHEN opens THEN close END IGNORE NULLS) OVER w AS pin FROM q1
  WINDOW w AS (PARTITION BY symbol, variant ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT symbol, variant, product(1 + net) AS final, max(CASE WHEN exit_reason = 'end_of_data' THEN exit_idx END) AS forced FROM trades GROUP BY 1, 2),
curve AS (SELECT q2.symbol, q2.variant, bar, idx, {r(f"CASE WHEN idx = forced THEN final WHEN prior IS NOT NULL THEN done * (1 + CASE prior WHEN 'long' THEN 1 ELSE -1 END * (close - pin) / pin) * {FEE} ELSE done END", 6)} AS equity
  FROM q2 LEFT JOIN fin USING (symbol, variant) WHERE idx >= 988)"""


def windows(labels: str = "('14d', 14), ('90d', 90), ('365d', 365), ('full', 1000000000)", out: str = "pw") -> str:
    return f"""{out}_l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS late FROM bars),
{out}_w AS (SELECT b.*, label FROM {out}_l b JOIN (VALUES {labels}) v(label, k) ON late <= k),
{out}_r AS (SELECT *, close / nullif(lag(close) OVER o, 0) - 1 AS ret, max(close) OVER (PARTITION BY symbol, label ORDER BY idx ROWS UNBOUNDED PRECEDING) AS peak
  FROM {out}_w WINDOW o AS (PARTITION BY symbol, label ORDER BY idx)),
{out} AS (SELECT symbol, label, count(*) AS days, min(bar) AS date_start, max(bar) AS date_end, arg_min(close, idx) AS start_price, arg_max(close, idx) AS end_price,
  {r("(arg_max(close, idx) - arg_min(close, idx)) / nullif(arg_min(close, idx), 0) * 100")} AS return_pct,
  {r("CASE WHEN count(ret) >= 2 THEN stddev_samp(ret) END * sqrt(365) * 100")} AS volatility_annualised_pct,
  {r("least(0, coalesce(min((close - peak) / nullif(peak, 0)), 0)) * 100")} AS max_drawdown_pct, min(close) AS low, max(close) AS high,
  {r("(arg_max(close, idx) - min(close)) / nullif(max(close) - min(close), 0) * 100", 1)} AS percentile_in_range
  FROM {out}_r GROUP BY 1, 2 HAVING count(*) >= 2)"""


def tail(n: int, out: str = "tl") -> str:
    return f"""{out}_l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS late FROM bars),
{out} AS (SELECT * EXCLUDE (late, idx), (row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1)::INT AS idx FROM {out}_l WHERE late <= {n})"""


SIDE = f"""{tail(24, "t24")},
rt AS (SELECT *, close / nullif(lag(close) OVER ({BY}), 0) AS ratio FROM t24),
sd AS (SELECT symbol, arg_max(ratio, idx) AS cur, count(ratio) AS n, count(*) FILTER (ratio > 1) AS longs FROM rt GROUP BY 1),
side AS (SELECT symbol, {r("cur", 4)} AS current, CASE WHEN cur > 1.02 THEN 'long_dominant' WHEN cur < 0.98 THEN 'short_dominant' ELSE 'balanced' END AS bias,
  {r("CASE WHEN cur > 1 THEN longs ELSE n - longs END * 100.0 / n", 1)} AS consistency_pct FROM sd)"""
FLOW = f"""fl AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS late FROM bars WHERE volume IS NOT NULL),
fa AS (SELECT symbol, count(*) AS n, arg_max(volume, idx) AS last, arg_min(volume, idx) AS first, max(CASE WHEN late = 31 THEN volume END) AS mid FROM fl WHERE late <= 90 GROUP BY 1),
fc AS (SELECT *, {r("(last - first) / nullif(first, 0) * 100")} AS change_pct, {r("(last - coalesce(mid, first)) / nullif(coalesce(mid, first), 0) * 100")} AS change_30d_pct FROM fa WHERE n >= 2),
flow AS (SELECT symbol, {r("last", 4)} AS latest, change_pct, change_30d_pct,
  CASE WHEN change_30d_pct > 3 THEN 'expanding' WHEN change_30d_pct < -3 THEN 'contracting' WHEN change_30d_pct IS NOT NULL THEN 'stable' ELSE 'unknown' END AS direction FROM fc)"""
METRICS = f"""{windows("('14d', 14), ('90d', 90)")}, {strat("bars", "st")}, {latest("st", "lt", 1)}, {SIDE}, {FLOW},
ws AS (SELECT symbol, max(return_pct) FILTER (label = '14d') AS r14, max(return_pct) FILTER (label = '90d') AS r90, max(percentile_in_range) FILTER (label = '90d') AS p90 FROM pw GROUP BY 1),
metrics AS (SELECT symbol, r14 AS return_pct, trend, sign(r14) = sign(r90) AS aligned, rsi, volume_spike, {r("r14 / 100", 4)} AS funding_pct,
  CASE WHEN {r("r14 / 100", 4)} > 0.01 THEN 'long_crowded' WHEN {r("r14 / 100", 4)} < -0.01 THEN 'short_crowded' WHEN r14 IS NOT NULL THEN 'balanced' END AS funding_bias,
  consistency_pct AS long_pct, bias AS ratio_bias, consistency_pct, CASE WHEN r90 > 0 THEN 'positive' WHEN r90 < 0 THEN 'negative' ELSE 'mixed' END AS sentiment,
  p90 AS fear_greed, CASE WHEN r14 - r90 > 5 THEN 'improving' WHEN r14 - r90 < -5 THEN 'deteriorating' ELSE 'stable' END AS risk_appetite,
  1 AS announcements, change_30d_pct AS change_30d, direction AS tvl_direction FROM ws JOIN lt USING (symbol) JOIN side USING (symbol) JOIN flow USING (symbol))"""
INVENTORY = "inv AS (" + " UNION ALL ".join(
    f"SELECT symbol, {o} AS ord, '{k}' AS rule, '{d}' AS data_type, '{s}' AS side, {w}::DOUBLE AS weight FROM metrics WHERE {c}" for o, k, d, c, s, w in RULES
) + ")"
STANCE = f"""sums AS (SELECT symbol, {r("coalesce(sum(weight) FILTER (side = 'bull'), 0)")} AS bull_weight,
  {r("coalesce(sum(weight) FILTER (side = 'bear'), 0)")} AS bear_weight, count(side) AS signal_count FROM (SELECT DISTINCT symbol FROM metrics) LEFT JOIN inv USING (symbol) GROUP BY 1),
mg AS (SELECT *, {r("bull_weight + bear_weight")} AS total, coalesce((bull_weight - bear_weight) / nullif({r("bull_weight + bear_weight")}, 0), 0) AS margin FROM sums),
stance AS (SELECT symbol, bull_weight, bear_weight, signal_count, CASE WHEN total < 1.5 THEN 'neutral' WHEN margin >= 0.25 THEN 'bullish' WHEN margin <= -0.25 THEN 'bearish'
  ELSE 'neutral' END AS stance, {r("margin * 100", 1)} AS net_margin_pct FROM mg)"""
LABELS = ", ".join(f"({o}, '{name}', '{a}')" for o, name, a in SOURCES)
COMPLETE = f"""src(ordinal, label, agent) AS (VALUES {LABELS}),
obs AS (SELECT r_name AS symbol, label, 'EV-' || min(n_name) AS evidence_id, CASE WHEN min(n_nationkey) % 5 = 0 THEN 'unsupported' ELSE 'success' END AS st
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN src ON ordinal = n_nationkey % {len(SOURCES)} GROUP BY 1, 2),
comp AS (SELECT symbol, ordinal, label, agent, CASE WHEN st = 'success' THEN evidence_id ELSE 'EV-' || upper(label) || '-' || symbol || '-FALLBACK' END AS evidence_id,
  CASE WHEN st = 'success' THEN 0.8 ELSE 0.2 END::DOUBLE AS reliability, CASE WHEN st = 'success' THEN 'success' WHEN st = 'unsupported' THEN 'unsupported' ELSE 'unavailable' END AS status,
  coalesce(st <> 'success', true) AS is_fallback FROM (SELECT DISTINCT r_name AS symbol FROM region) CROSS JOIN src LEFT JOIN obs USING (symbol, label))"""
LIQ = f"""lq_l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS late FROM bars),
liq AS (SELECT symbol, {r("avg(volume)")} AS avg_volume, {r("arg_max(volume, idx)")} AS latest_volume,
  {r("(CASE WHEN count(volume) >= 2 THEN arg_max(volume, idx) / nullif(arg_min(volume, idx), 0) - 1 END) * 100")} AS volume_trend_pct FROM lq_l WHERE late <= 14 GROUP BY 1)"""
VOL = f"""rv_l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS late FROM bars),
rv_r AS (SELECT *, close / nullif(lag(close) OVER ({BY}), 0) - 1 AS ret FROM rv_l WHERE late <= 14),
rv AS (SELECT symbol, {r("CASE WHEN count(close) >= 3 AND count(ret) >= 2 THEN least(100, stddev_pop(ret) / 0.05 * 100) END", 1)} AS realised_volatility FROM rv_r GROUP BY 1)"""
RISK = f"""rk AS (SELECT symbol, {r("CASE WHEN funding_pct IS NOT NULL THEN least(100, abs(funding_pct) / 0.05 * 100) END", 1)} AS funding_stress, {r("CASE WHEN long_pct IS NOT NULL THEN least(100, abs(long_pct - 50) * 2) END", 1)} AS positioning_crowding,
  {r("CASE WHEN rsi IS NOT NULL THEN least(100, abs(rsi - 50) / 50 * 100) END", 1)} AS rsi_extremity, CASE WHEN aligned THEN 0.0 WHEN NOT aligned THEN 100.0 END::DOUBLE AS timeframe_conflict, realised_volatility FROM metrics LEFT JOIN rv USING (symbol))"""
CONF = f"""fb AS (SELECT symbol, count(*) FILTER (is_fallback) AS source_failures FROM comp GROUP BY 1),
conf AS (SELECT symbol, source_failures, {r("greatest(0.2, least(0.85, 0.30 + 0.35 * coalesce(greatest(bull_weight, bear_weight) / nullif(bull_weight + bear_weight, 0), 0) - 0.06 * source_failures))")} AS confidence
  FROM stance JOIN fb USING (symbol))"""
POLICY = """rg AS (SELECT r_name AS symbol, r_regionkey AS k FROM region),
pg AS (SELECT symbol, page_id AS n, CASE WHEN page_id % 7 = 0 THEN 'Fomc ' ELSE '' END || coalesce(url, '') AS title, row_number() OVER (PARTITION BY symbol ORDER BY page_id) AS q FROM pages JOIN rg ON k = page_id % 4),
pol AS (SELECT symbol, CASE WHEN count(n) > 0 THEN 'available' ELSE 'unavailable:empty' END AS policy_status, count(n) AS releases,
  arg_min(title, n) FILTER (contains(upper(title), 'FOMC')) AS latest_fomc FROM rg LEFT JOIN (SELECT * FROM pg WHERE q <= 5) USING (symbol) GROUP BY 1)"""
RISKS = f"""{POLICY}, rx AS (SELECT * FROM metrics JOIN stance USING (symbol) LEFT JOIN pol USING (symbol)),
risks AS (SELECT symbol, 1 AS ord, 'degraded source: ' || label AS factor FROM comp WHERE is_fallback
UNION ALL SELECT symbol, 2, 'bull and bear weights are close' FROM rx WHERE bull_weight > 0 AND bull_weight / nullif(bear_weight, 0) BETWEEN 0.6 AND 1.67
UNION ALL SELECT symbol, 3, 'timeframes disagree' FROM rx WHERE NOT aligned
UNION ALL SELECT symbol, 4, 'positioning is unstable' FROM rx WHERE consistency_pct < 60
UNION ALL SELECT symbol, 5, 'policy releases are unavailable' FROM rx WHERE policy_status LIKE 'unavailable%'
UNION ALL SELECT symbol, 6, 'signals are simultaneous, not causal' FROM rx UNION ALL SELECT symbol, 7, 'social and news sources are less reliable' FROM rx)"""
NARRATIVE = f"""{CONF}, net AS (SELECT symbol, CASE WHEN bull_weight > bear_weight THEN 'bull' WHEN bear_weight > bull_weight THEN 'bear' ELSE 'neutral' END AS net FROM stance),
pn AS (SELECT inv.*, net, data_type || ' rule ' || rule AS name, CASE WHEN side = 'neutral' THEN 'undecided' WHEN net = side THEN 'supporting' WHEN net <> 'neutral' THEN 'opposing' END AS part
  FROM inv JOIN net USING (symbol)),
pt AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY ord, rule) AS k FROM pn),
ct AS (SELECT net.symbol, net.net, count(*) FILTER (part = 'supporting') AS sup, count(*) FILTER (part = 'opposing') AS opp, count(*) FILTER (part = 'undecided') AS und
  FROM net LEFT JOIN pt USING (symbol) GROUP BY 1, 2),
cx AS (SELECT ct.*, confidence, fear_greed FROM ct LEFT JOIN conf USING (symbol) LEFT JOIN metrics USING (symbol)),
nar(symbol, section, ord, line) AS (SELECT symbol, 'inferences', k::INT, name || ' points to ' || net FROM pt WHERE part = 'supporting' AND k <= 4
UNION ALL SELECT symbol, 'inferences', k + 10, name || ' gives no direction' FROM pt WHERE part = 'undecided' AND k <= 2
UNION ALL SELECT symbol, 'inferences', 20, 'no signal gives a direction' FROM cx WHERE sup = 0 AND und = 0
UNION ALL SELECT symbol, 'inferences', 30, opp || ' signals oppose this; confidence ' || printf('%.2f', confidence) FROM cx WHERE opp > 0
UNION ALL SELECT symbol, 'counter_evidence', k, name || ' points to ' || side FROM pt WHERE part = 'opposing'
UNION ALL SELECT symbol, 'counter_evidence', k + 100, name || ' is undecided' FROM pt WHERE part = 'undecided' AND k <= 3
UNION ALL SELECT symbol, 'counter_evidence', 200, 'nothing opposes; that ' || sup || ' signals agree proves no cause' FROM cx WHERE net <> 'neutral' AND opp = 0
UNION ALL SELECT symbol, 'counter_evidence', ordinal + 300, label || ' has no live data, so nothing from there can oppose' FROM comp WHERE is_fallback
UNION ALL SELECT symbol, 'counter_evidence', 400, 'weighed by rules, not checked by a model' FROM cx
UNION ALL SELECT symbol, 'observations', 1, 'whether ' || name || ' grows stronger' FROM pt WHERE part = 'opposing' AND k = 1
UNION ALL SELECT symbol, 'observations', 2, 'whether price and volume of the next day go on ' || net FROM cx WHERE net <> 'neutral'
UNION ALL SELECT symbol, 'observations', 3, 'whether fear and greed leave ' || printf('%.1f', fear_greed) FROM cx WHERE fear_greed IS NOT NULL
UNION ALL SELECT symbol, 'observations', 4, 'whether announcements and chain activity go with the price' FROM cx
UNION ALL SELECT symbol, 'judgment', 1, symbol || ' leans ' || net || ': ' || sup || ' signals for it, ' || opp || ' against' FROM cx
UNION ALL SELECT symbol, 'facts', ordinal, evidence_id || ': ' || label || CASE WHEN is_fallback THEN ' is unavailable' ELSE ' was observed' END FROM comp)"""
SHOWN = ["trend", "funding_bias", "ratio_bias", "sentiment", "risk_appetite", "tvl_direction"]
INDICATORS = "shown AS (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS indicator, {n} AS value FROM metrics WHERE {n} IS NOT NULL" for n in SHOWN) + ")"


def rank_of(name: str, m: str) -> str:
    both = f"x.{m} IS NOT NULL AND y.{m} IS NOT NULL"
    ratio = f"greatest(x.{m}, y.{m}) / nullif(least(x.{m}, y.{m}), 0)"
    return f"""CASE WHEN x.{m} IS NULL AND y.{m} IS NULL THEN NULL WHEN x.{m} IS NULL THEN b WHEN y.{m} IS NULL THEN a WHEN x.{m} > y.{m} THEN a WHEN y.{m} > x.{m} THEN b END AS {name}_leader,
  CASE WHEN x.{m} IS NULL AND y.{m} IS NULL THEN 'unknown' WHEN x.{m} IS NULL OR y.{m} IS NULL THEN 'only one known' WHEN x.{m} = y.{m} THEN 'tie' ELSE 'leads' END AS {name}_verdict,
  CASE WHEN {both} AND {ratio} >= 1.1 THEN {r(ratio)} END AS {name}_ratio"""


PARTS = ["funding_stress", "positioning_crowding", "rsi_extremity", "timeframe_conflict", "realised_volatility"]
SQUASH = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
ENTITY = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]


def unescape(x: str) -> str:
    for a, b in ENTITY:
        x = f"replace({x}, '{a}', '{b}')"
    return x


PLAIN = SQUASH(unescape("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"))
DROPPED = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("script", "style", "nav", "header", "footer", "aside", "form"))
BLOCK = SQUASH(unescape("regexp_replace(x, '<[^>]+>', ' ', 'g')"))
WORDS = "list_distinct(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: trim(w, '.,!?():[]\"')))"
LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
SENT = f"""SELECT *, CASE WHEN positive_terms > negative_terms THEN 'positive' WHEN negative_terms > positive_terms THEN 'negative' ELSE 'mixed' END AS sentiment FROM (
  SELECT role, count(*) AS posts, sum(len(list_intersect({WORDS}, {LIST(POSITIVE)})))::BIGINT AS positive_terms, sum(len(list_intersect({WORDS}, {LIST(NEGATIVE)})))::BIGINT AS negative_terms
  FROM conversations GROUP BY role)"""
FMT = lambda x, d: f"coalesce(printf('%.{d}f', {x}), 'N/A')"

ORACLE_SQL = {
    "bars_from_events": f"WITH RECURSIVE {events(30)} SELECT * FROM bars",
    "bars_daily_region": f"WITH RECURSIVE {REGION} SELECT * FROM bars",
    "ohlcv_tail": f"WITH RECURSIVE {REGION}, {tail(14)} SELECT symbol, bar, idx, close, volume FROM tl",
    "manifest": f'WITH RECURSIVE {REGION} SELECT symbol, count(*) AS rows, min(bar) AS "first", max(bar) AS "last" FROM bars GROUP BY 1',
    "price_windows": f"WITH RECURSIVE {REGION}, {windows()} SELECT * FROM pw",
    "returns_lag": f"WITH RECURSIVE {REGION} SELECT symbol, bar, {r(f'close / nullif(lag(close) OVER ({BY}), 0) - 1', 6)} AS ret FROM bars",
    "downsample": f"""WITH RECURSIVE {REGION}, k AS (SELECT symbol, n, round_even(i * (n - 1) / 259.0, 0)::INT AS idx FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), range(260) t(i))
SELECT symbol, bar, close FROM bars JOIN (SELECT symbol, count(*) AS total FROM bars GROUP BY 1) USING (symbol)
WHERE total <= 260 OR (symbol, idx) IN (SELECT (symbol, idx) FROM k)""",
    "ema": f"WITH RECURSIVE {REGION}, {walk('bars', 'x', (12, 144))} SELECT symbol, bar, {r('e12', 4)} AS ema12, {r('e144', 4)} AS ema144 FROM x",
    "minute_series": f"""WITH RECURSIVE {events(1).replace("event_type AS symbol", "'all' AS symbol")}, {walk("bars", "x", (12, 144))}
SELECT bar, {r("e12", 4)} AS ema12, {r("e144", 4)} AS ema144, {r("rsi", 4)} AS rsi FROM x""",
    "rsi": f"WITH RECURSIVE {REGION}, {walk('bars', 'x', (12,))} SELECT symbol, bar, {r('rsi', 4)} AS rsi FROM x",
    "ribbon_tunnel": f"WITH RECURSIVE {REGION}, {ribbon('bars', 'x')} SELECT symbol, bar, bull, bear, in_tunnel, {r('tt', 4)} AS tunnel_top, {r('tb', 4)} AS tunnel_bottom FROM x",
    "volume_spike": f"WITH RECURSIVE {events(30)}, {walk('bars', 'x', (12,))} SELECT symbol, bar, coalesce(volume > 2.0 * v144, false) AS volume_spike FROM x",
    "crossovers": f"""WITH RECURSIVE {events(30)}, {walk("bars", "x", (12,))}, y AS (SELECT *, lag(rsi) OVER ({BY}) AS b FROM x)
SELECT * FROM (SELECT symbol, bar, coalesce(b < 20 AND rsi >= 20, false) AS over, coalesce(b > 80 AND rsi <= 80, false) AS under FROM y) WHERE over OR under""",
    "strategy_signals": f"{LOOSE_STATES} SELECT symbol, bar, trend, in_tunnel, volume_spike, coalesce(signal, '-') AS signal FROM st",
    "strategy_signals_default": f"WITH RECURSIVE {REGION}, {strat('bars', 'st')} SELECT symbol, bar, trend, in_tunnel, volume_spike, coalesce(signal, '-') AS signal FROM st",
    "last_signal": f"{LOOSE_STATES}, {latest('st', 'lt')} SELECT * FROM lt",
    "timeframe_alignment": f"""WITH RECURSIVE {events(30, "b30")}, {events(20, "b20")}, {strat("b30", "hi")}, {strat("b20", "lo")}, {latest("hi", "h", 1)}, {latest("lo", "l", 1)},
d AS (SELECT symbol, CASE h.trend WHEN 'bullish_aligned' THEN 'long' WHEN 'bearish_aligned' THEN 'short' ELSE 'neutral' END AS higher_direction,
  CASE l.trend WHEN 'bullish_aligned' THEN 'long' WHEN 'bearish_aligned' THEN 'short' ELSE 'neutral' END AS lower_direction FROM h JOIN l USING (symbol))
SELECT *, higher_direction = lower_direction AND higher_direction <> 'neutral' AS passed FROM d""",
    **{
        f"trades_{v}": f"""{LOOSE_STATES}, {POSITIONS}, {TRADES} SELECT symbol, side, entry_date, exit_date, {r("pin", 4)} AS entry_price,
{r("pout", 4)} AS exit_price, bars_held, return_pct, exit_reason FROM trades WHERE variant = '{v}'"""
        for v in ("long_only", "long_short")
    },
    "equity_curve": f"{LOOSE_STATES}, {POSITIONS}, {TRADES}, {EQUITY} SELECT symbol, variant, bar, equity FROM curve",
    "backtest_summary": f"""{LOOSE_STATES}, {POSITIONS}, {TRADES}, {EQUITY},
bh AS (SELECT symbol, variant, min(bar) AS date_start, max(bar) AS date_end, count(*) AS test_bars, count(prior) AS inside,
  {r("(arg_max(close, idx) - arg_min(close, idx)) / arg_min(close, idx) * 100")} AS buy_hold_return_pct FROM held WHERE idx >= 988 GROUP BY 1, 2),
dd AS (SELECT symbol, variant, {r("least(0, min((equity - peak) / peak)) * 100")} AS max_drawdown_pct FROM
  (SELECT *, max(equity) OVER (PARTITION BY symbol, variant ORDER BY idx ROWS UNBOUNDED PRECEDING) AS peak FROM curve) GROUP BY 1, 2),
ts AS (SELECT symbol, variant, product(1 + net) AS eq, count(*) AS c, count(*) FILTER (return_pct > 0) AS w, count(*) FILTER (return_pct <= 0) AS l,
  sum(return_pct) FILTER (return_pct > 0) AS gw, -sum(return_pct) FILTER (return_pct <= 0) AS gl, avg(bars_held) AS bars FROM trades GROUP BY 1, 2)
SELECT symbol, variant, date_start, date_end, test_bars, {r("(coalesce(eq, 1) - 1) * 100")} AS strategy_return_pct, buy_hold_return_pct,
  {r("(coalesce(eq, 1) - 1) * 100 - buy_hold_return_pct")} AS excess_return_pct, coalesce(c, 0) AS trade_count, coalesce(w, 0) AS win_count, coalesce(l, 0) AS loss_count,
  {r("w * 100.0 / c", 1)} AS win_rate_pct, {r("gw / nullif(w, 0)")} AS avg_win_pct, {r("-gl / nullif(l, 0)")} AS avg_loss_pct,
  {r("coalesce(gw, 0) / nullif(gl, 0)")} AS profit_factor, max_drawdown_pct, {r("inside * 100.0 / test_bars", 1)} AS exposure_pct, {r("bars", 1)} AS avg_bars_held
FROM bh LEFT JOIN dd USING (symbol, variant) LEFT JOIN ts USING (symbol, variant)""",
    "buy_hold": f"""WITH RECURSIVE {REGION} SELECT symbol, min(bar) AS date_start, max(bar) AS date_end, count(*) AS test_bars,
{r("(arg_max(close, idx) - arg_min(close, idx)) / arg_min(close, idx) * 100")} AS buy_hold_return_pct FROM bars WHERE idx >= 988 GROUP BY 1""",
    "side_consistency": f"WITH RECURSIVE {REGION}, {SIDE} SELECT * FROM side",
    "trend_30_90": f"WITH RECURSIVE {REGION}, {FLOW} SELECT * FROM flow",
    "index_direction": f"""WITH RECURSIVE {REGION}, {tail(14)}, x AS (SELECT symbol, arg_min(close, idx) AS "first", arg_max(close, idx) AS "last" FROM tl GROUP BY 1)
SELECT symbol, "first", "last", {r('"last" - "first"')} AS delta, CASE WHEN "last" - "first" > 5 THEN 'improving' WHEN "last" - "first" < -5 THEN 'deteriorating' ELSE 'stable' END AS direction FROM x""",
    "liquidity_profile": f"WITH RECURSIVE {REGION}, {LIQ} SELECT * FROM liq",
    "symbol_metrics": f"WITH RECURSIVE {REGION}, {METRICS} SELECT * FROM metrics",
    "risk_composite": f"""WITH RECURSIVE {REGION}, {METRICS}, {VOL}, {RISK} SELECT *, ({" + ".join(f"({p} IS NOT NULL)::INT" for p in PARTS)})::INT AS components_available,
{r("(" + " + ".join(f"coalesce({p}, 0)" for p in PARTS) + ") / (" + " + ".join(f"({p} IS NOT NULL)::INT" for p in PARTS) + ")", 1)} AS composite_score FROM rk""",
    "attention_profile": "SELECT *, posts >= 25 AS capped FROM (SELECT role AS symbol, count(*) AS posts, sum(coalesce(length(text), 0) + CASE WHEN turn > 0 THEN turn ELSE 0 END)::BIGINT AS engagement FROM conversations GROUP BY 1)",
    "pairwise_compare": f"""WITH RECURSIVE {REGION}, {LIQ} SELECT a.symbol AS a, b.symbol AS b, CASE WHEN a.avg_volume > b.avg_volume THEN a.symbol WHEN b.avg_volume > a.avg_volume THEN b.symbol END AS leader,
CASE WHEN a.avg_volume = b.avg_volume THEN 'tie' ELSE 'leads' END AS verdict,
CASE WHEN greatest(a.avg_volume, b.avg_volume) / least(a.avg_volume, b.avg_volume) >= 1.1 THEN {r("greatest(a.avg_volume, b.avg_volume) / least(a.avg_volume, b.avg_volume)")} END AS ratio
FROM liq a JOIN liq b ON a.symbol < b.symbol""",
    "signal_inventory": f"WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY} SELECT * FROM inv",
    "stance": f"WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY}, {STANCE} SELECT * FROM stance",
    "stance_drivers": f"""WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY}, {STANCE} SELECT symbol, rank, rule, weight FROM (SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, ord, rule))::INT AS rank, rule, weight
FROM inv JOIN stance USING (symbol) WHERE side = CASE stance WHEN 'bullish' THEN 'bull' WHEN 'bearish' THEN 'bear' END) WHERE rank <= 3""",
    "confidence": f"WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY}, {STANCE}, {COMPLETE}, {CONF} SELECT * FROM conf",
    "risk_factors": f"WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY}, {STANCE}, {COMPLETE}, {RISKS} SELECT * FROM risks",
    "narrative": f"WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY}, {STANCE}, {COMPLETE}, {NARRATIVE} SELECT * FROM nar",
    "policy_releases": f"WITH {POLICY} SELECT * FROM pol",
    "evidence_by_type": f"WITH RECURSIVE {COMPLETE} SELECT symbol, " + ", ".join(f"max(evidence_id) FILTER (label = '{x[1]}') AS {x[1]}" for x in SOURCES) + " FROM comp WHERE NOT is_fallback GROUP BY 1",
    "footnotes": f"""WITH RECURSIVE {REGION}, {METRICS}, {INVENTORY}, {COMPLETE}, pl AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ordinal))::INT AS number FROM comp)
SELECT inv.symbol, rule, coalesce(evidence_id, data_type) AS evidence_id, number FROM inv LEFT JOIN pl ON pl.symbol = inv.symbol AND label = data_type""",
    "indicators_shown": f"WITH RECURSIVE {REGION}, {METRICS}, {INDICATORS} SELECT * FROM shown",
    "run_state": f"WITH RECURSIVE {COMPLETE} SELECT symbol, CASE WHEN bool_or(is_fallback) THEN 'degraded' ELSE 'clean' END AS state, count(*) FILTER (is_fallback) AS degraded FROM comp GROUP BY 1",
    "numeric_elements": "SELECT conv_id, turn, concat_ws(',', printf('%.1f', length(text)::DOUBLE), printf('%.1f', turn::DOUBLE), '0.5') AS numbers FROM conversations",
    "sentence_blocks": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？；!?;]+[。！？；!?;]*'),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS cs FROM conversations),
s AS (SELECT *, string_split(list_reduce(list_prepend('', cs), lambda a, x: a || x || CASE WHEN length(string_split(a || x, chr(1))[-1]) >= 24 THEN chr(1) ELSE '' END), chr(1)) AS p FROM c)
SELECT conv_id, turn, CASE WHEN len(cs) = 0 THEN text WHEN p[-1] = '' THEN array_to_string(p[:-2], '|')
  WHEN len(p) > 1 AND length(p[-1]) < 12 THEN array_to_string(p[:-2], '|') || p[-1] ELSE array_to_string(p, '|') END AS blocks FROM s""",
    "fuller_text": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, coalesce(CASE WHEN turn % 2 = 0 THEN replace(text, ' ', '  ') ELSE role END, '') AS j FROM conversations),
d AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS u, regexp_replace(j, '\\s+', '', 'g') AS v FROM c)
SELECT conv_id, turn, CASE WHEN contains(u, v) OR contains(v, u) THEN CASE WHEN length(trim(j)) > length(trim(t)) THEN trim(j) ELSE trim(t) END ELSE '-' END AS shown FROM d""",
    "minutes_shown": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events",
    "news_union": """WITH good AS (SELECT doc_id FROM labels WHERE quality = 1),
p AS (SELECT * FROM (SELECT lang, doc_id, lower(text) AS low, row_number() OVER (PARTITION BY lang, lower(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id IN (FROM good) AND text <> '') WHERE k = 1),
s AS (SELECT * FROM (SELECT lang, doc_id, lower(coalesce(text, '')) AS low, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (FROM good)) WHERE n <= 5),
u AS (SELECT lang, doc_id, true AS from_publisher FROM p UNION ALL
  SELECT lang, doc_id, false FROM s WHERE NOT EXISTS (FROM p WHERE p.lang IS NOT DISTINCT FROM s.lang AND p.low = s.low))
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY from_publisher DESC, doc_id))::INT AS rank FROM u) WHERE rank <= 5""",
    "comparison_report": f"""WITH RECURSIVE {REGION}, {METRICS}, {VOL}, {RISK}, {LIQ},
cs AS (SELECT symbol, {r("(" + " + ".join(f"coalesce({p}, 0)" for p in PARTS) + ") / (" + " + ".join(f"({p} IS NOT NULL)::INT" for p in PARTS) + ")", 1)} AS composite_score FROM rk),
rgn AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT r_name AS symbol FROM region)),
po AS (SELECT symbol, count(*) AS posts, sum(coalesce(length(text), 0) + coalesce(turn, 0))::BIGINT AS engagement FROM conversations JOIN rgn ON k = conv_id % 5 GROUP BY 1),
ne AS (SELECT symbol, count(*) AS news FROM documents JOIN rgn ON k = doc_id % 5 GROUP BY 1),
pf AS (SELECT symbol, avg_volume, composite_score, coalesce(posts, 0) AS posts, coalesce(engagement, 0) AS engagement, coalesce(news, 0) AS news
  FROM liq LEFT JOIN cs USING (symbol) LEFT JOIN po USING (symbol) LEFT JOIN ne USING (symbol)),
ask AS (SELECT p.symbol AS a, q.symbol AS b FROM rgn p JOIN rgn q ON p.k < q.k UNION ALL SELECT 'AFRICA', 'NOWHERE'),
cm AS (SELECT a, b, {rank_of("liquidity", "avg_volume")}, {rank_of("risk", "composite_score")}, {rank_of("attention", "engagement")},
  CASE WHEN coalesce(x.posts >= 25 OR x.news >= 5, false) OR coalesce(y.posts >= 25 OR y.news >= 5, false) THEN 'counts are at their fetch limits' END AS note,
  {", ".join(f"coalesce(printf('%.{d}f', {t}.{m}::DOUBLE), 'N/A') AS {t}_{m}" for t in "xy" for m, d in (("avg_volume", 2), ("composite_score", 2), ("engagement", 2), ("news", 0), ("posts", 0)))}
  FROM ask LEFT JOIN pf x ON x.symbol = a LEFT JOIN pf y ON y.symbol = b),
sm AS (SELECT *, concat_ws('; ', 'more liquid: ' || liquidity_leader, 'more exposed: ' || risk_leader, 'more attention: ' || attention_leader) AS said FROM cm),
su AS (SELECT *, CASE WHEN said = '' THEN 'too little data to tell them apart' ELSE said || CASE WHEN liquidity_leader = risk_leader THEN '; ' || risk_leader || ' moves by active trade'
  WHEN liquidity_leader <> risk_leader THEN '; ' || risk_leader || ' is exposed at less liquidity' ELSE '' END END AS summary FROM sm)
SELECT a, b, {", ".join(f"{n}_{c}" for n in ("liquidity", "risk", "attention") for c in ("leader", "verdict", "ratio"))}, note, summary,
  concat_ws(chr(10), '## ' || a || ' vs ' || b, summary, '| | ' || a || ' | ' || b || ' | verdict |', '|---|---|---|---|',
  {", ".join(f"'| {n} | ' || x_{m} || ' | ' || y_{m} || ' | ' || concat_ws(' ', {n}_leader, {n}_verdict) || ' |'" for n, m in (("liquidity", "avg_volume"), ("risk", "composite_score"), ("attention", "engagement")))},
  '| news | ' || x_news || ' | ' || y_news || ' | ' || coalesce(note, '') || ' |', '| posts | ' || x_posts || ' | ' || y_posts || ' |  |') AS report FROM su""",
    "fallback_fill": f"WITH RECURSIVE {COMPLETE} SELECT * FROM comp",
    "first_available": "SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 5000 GROUP BY 1",
    "dq_rules": """WITH x AS (SELECT 'EV-' || (o_orderkey % 5000) AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS source, o_orderkey % 13 = 0 AS bad,
  CASE WHEN o_orderkey % 17 <> 0 THEN 'market' END AS dt, CASE WHEN o_orderkey % 19 <> 0 THEN 'x' END AS content, o_totalprice / 400000 AS score FROM orders),
y AS (SELECT *, concat_ws(', ', CASE WHEN content IS NULL THEN 'content' END, CASE WHEN dt IS NULL THEN 'data_type' END, CASE WHEN source IS NULL THEN 'source' END) AS absent FROM x)
SELECT 'duplicate id' AS finding, count(*) - count(DISTINCT id) AS records FROM x HAVING count(*) > count(DISTINCT id)
UNION ALL SELECT 'missing ' || absent, count(*) FROM y WHERE absent <> '' GROUP BY 1 UNION ALL SELECT 'empty source', count(*) FROM x WHERE source IS NULL HAVING count(*) > 0
UNION ALL SELECT 'score out of range', count(*) FROM x WHERE score < 0 OR score > 1 HAVING count(*) > 0 UNION ALL SELECT 'bad timestamp', count(*) FROM x WHERE bad HAVING count(*) > 0""",
    "dq_dangling_refs": "SELECT doc_id * 3 AS doc_id FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)",
    "dedupe_topn": """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lower(text) ORDER BY doc_id) AS k FROM documents)
SELECT source, doc_id, rank FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS rank FROM d WHERE k = 1) WHERE rank <= 5""",
    "snapshot_delta": f"""WITH l0 AS (SELECT event_type AS coin, strftime(ts, '%Y-%m-%d') AS fetched_at, 'w' || (user_id % 7) AS label, {r("sum(value)", 4)} AS balance FROM events GROUP BY 1, 2, 3),
l AS (SELECT * EXCLUDE k FROM (SELECT *, dense_rank() OVER (PARTITION BY coin ORDER BY fetched_at DESC) AS k FROM l0) WHERE k <= 30),
n AS (SELECT l.* FROM l JOIN (SELECT coin, max(fetched_at) AS now FROM l GROUP BY 1) m ON l.coin = m.coin AND fetched_at = now),
p AS (SELECT l.coin, max(l.fetched_at) AS previous_at FROM l JOIN n ON l.coin = n.coin AND l.label = n.label AND l.fetched_at < n.fetched_at GROUP BY 1)
SELECT n.coin, n.label, n.fetched_at, n.balance, previous_at, b.balance AS previous, {r("n.balance - b.balance", 4)} AS delta
FROM n LEFT JOIN p ON n.coin = p.coin LEFT JOIN l b ON b.coin = n.coin AND b.label = n.label AND b.fetched_at = previous_at""",
    "request_validation": """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'unsupported symbol' WHEN trim(coalesce(text, '')) = '' THEN 'question is empty'
WHEN length(trim(text)) > 500 THEN 'question is too long' ELSE 'ok' END AS outcome FROM conversations""",
    "mention_filter": "SELECT source, count(*) AS documents FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{a}')" for a in ALIASES) + " GROUP BY 1",
    "lexicon_sentiment": SENT,
    "matched_words": f"""SELECT role, string_agg(w, ',' ORDER BY w) AS matched FROM (SELECT DISTINCT role, unnest(list_intersect({WORDS}, {LIST(POSITIVE)})) AS w FROM conversations) GROUP BY 1""",
    "strip_truncate": f"""WITH p AS (SELECT page_id, {PLAIN} AS t FROM pages), c AS (SELECT *, substr(t, 1, 420) AS cut FROM p),
e AS (SELECT *, regexp_extract(cut, '(?s)^(.*(?:。|[.!?])) ', 1) AS whole FROM c)
SELECT page_id, CASE WHEN length(t) <= 420 THEN t ELSE trim(CASE WHEN length(whole) > 211 THEN whole ELSE cut END) || '…' END AS lede FROM e""",
    "article_text": f"""WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is){DROPPED}', ' ', 'g'), '(?is)<p[^>]*>(.*?)</p>', 1) AS blocks FROM pages),
t AS (SELECT page_id, list_transform(blocks, lambda x: {BLOCK}) AS ts FROM b)
SELECT page_id, substr(array_to_string(list_filter(ts, lambda x: length(x) >= 80 AND
  len(list_filter(string_split(x, ' '), lambda w: starts_with(w, '$') OR ends_with(w, '%'))) <= 0.2 * len(string_split(x, ' '))), chr(10)), 1, 4000) AS body FROM t""",
    "citations": "SELECT doc_id, ref, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]{4,}')) AS ref FROM documents) GROUP BY 1, 2",
    "feed_parse": """SELECT page_id, n, title, url, published, summary FROM (
  SELECT page_id, 0 AS n, 'first ' || page_id AS title, '' AS url, '' AS published, 'Fed holds & waits ’til' AS summary FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 1, 'second', coalesce(url, ''), 'd' || page_id, '' FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 0, 'one', coalesce(url, ''), 'p', 'body ' || page_id FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 1, 'two', '', 'u', 's' FROM pages WHERE page_id % 2 = 1)""",
    "critic_validate": """WITH x AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, (conv_id % 13 - 11) / 10.0::DOUBLE AS adj,
  conv_id % 3 <> 0 AND conv_id * 2 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 < 2) AS unknown FROM conversations),
y AS (SELECT *, CASE WHEN turn % 7 = 6 THEN 'not of the schema' WHEN turn % 4 = 3 THEN 'unknown verdict' WHEN adj NOT BETWEEN -1 AND 0 THEN 'adjustment out of range'
  WHEN unknown THEN 'unknown evidence' ELSE '-' END AS reason FROM x)
SELECT id, reason = '-' AS accepted, reason, 0.6::DOUBLE AS confidence, CASE WHEN reason = '-' THEN round(greatest(0.0, least(1.0, 0.6 + adj)) * 10000) / 10000 ELSE 0.6 END::DOUBLE AS adjusted FROM y""",
    "report_markdown": f"""WITH RECURSIVE {REGION}, {METRICS}, {windows(out="fw")}, {INVENTORY}, {STANCE}, {COMPLETE}, {NARRATIVE}, {RISKS}, {INDICATORS},
ln(symbol, no, title, ord, line) AS (SELECT symbol, 1, 'Question', 0, 'Where is ' || symbol || ' heading?' FROM metrics
UNION ALL SELECT symbol, 2, 'Stance', 0, stance || ' (' || {FMT("net_margin_pct", 1)} || ' %), bull ' || {FMT("bull_weight", 2)} || ', bear ' || {FMT("bear_weight", 2)} FROM stance
UNION ALL SELECT symbol, 3, 'Market Judgment', ord, line FROM nar WHERE section = 'judgment'
UNION ALL SELECT symbol, 4, 'Long-horizon Context', 0, label || ': ' || {FMT("return_pct", 2)} || ' %, drawdown ' || {FMT("max_drawdown_pct", 2)} || ' %' FROM fw
UNION ALL SELECT symbol, 5, 'Facts', ord, line FROM nar WHERE section = 'facts' UNION ALL SELECT symbol, 6, 'Inferences', ord, line FROM nar WHERE section = 'inferences'
UNION ALL SELECT symbol, 7, 'Conclusion', ord, line FROM nar WHERE section = 'judgment' UNION ALL SELECT symbol, 9, 'Confidence', 0, {FMT("confidence", 2)} FROM conf
UNION ALL SELECT symbol, 10, 'Indicators', 0, indicator || ': ' || value FROM shown UNION ALL SELECT symbol, 11, 'Counter Evidence', ord, line FROM nar WHERE section = 'counter_evidence'
UNION ALL SELECT symbol, 12, 'Evidence Sources', ordinal, evidence_id || ' by ' || agent || ', reliability ' || {FMT("reliability", 2)} FROM comp
UNION ALL SELECT symbol, 13, 'Next Observations', ord, line FROM nar WHERE section = 'observations' UNION ALL SELECT symbol, 14, 'Risks and Limitations', ord, factor FROM risks),
sc AS (SELECT symbol, no, '## ' || title || chr(10) || string_agg('- ' || line, chr(10) ORDER BY ord, line) AS t FROM ln GROUP BY symbol, no, title)
SELECT symbol, '# ' || symbol || chr(10) || string_agg(t, chr(10) ORDER BY no) AS report FROM sc GROUP BY 1""",
}
