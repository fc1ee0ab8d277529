"""Queries of evidence records and their content, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evidence, records, rules, signals
from tidemark.plans import oracle
from tidemark.plans.catalogue import completed, stances
from tidemark.sources.shared import staged
from tidemark.sources.tables import read

SYMBOLS = ["BTC", "ETH", "SOL", "BNB", "XRP"]


def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ordinal, data_type, evidence_id, content): ten records of each symbol, from events, pages and turns dealt by number."""
    n = read(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    pages = read(spark, sf, "pages").groupBy((F.col("page_id") % 5).alias("k")).agg(F.array_sort(F.collect_list(F.struct("page_id", F.struct(F.coalesce("url", F.lit("")).alias("title")).alias("item")))).alias("p"))
    said = read(spark, sf, "conversations").groupBy((F.col("conv_id") % 5).alias("k")).agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("turns"))
    x = n.join(pages, "k").join(said, "k").withColumn("items", F.expr("transform(slice(p, 1, 5), x -> x.item)"))
    text = {
        "market": "named_struct('return_pct', n % 9 - 4)",
        "news": "named_struct('items', items)",
        "macro": "named_struct('fear_greed_value', n % 100, 'fear_greed_classification', 'c', 'fear_greed_change_14d', CAST(turns % 7 - 3 AS int), 'risk_appetite_direction', CASE WHEN turns % 2 = 0 THEN 'improving' ELSE 'deteriorating' END, 'latest_fomc_release', CASE WHEN k > 0 THEN named_struct('title', 'FOMC') END)",
        "announcement": "named_struct('first_party', k % 2 = 0, 'items', CASE WHEN k = 1 THEN slice(items, 1, 0) ELSE items END)",
        "onchain": "named_struct('chain', k)",
        "social": "named_struct('sentiment', CASE turns % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'mixed' END, 'posts', array(named_struct('matched_positive', roles, 'matched_negative', CASE WHEN k = 2 THEN array('drop') ELSE slice(roles, 1, 0) END)))",
        "derivatives": "named_struct('funding_rate_pct', CASE WHEN k <> 3 THEN n % 7 - 3 END, 'bias', CASE WHEN n % 7 > 3 THEN 'long_crowded' WHEN n % 7 < 3 THEN 'short_crowded' ELSE 'balanced' END)",
        "whale": "named_struct('wallets', CASE WHEN k <> 4 THEN array(named_struct('label', 'one', 'balance', n * 1000), named_struct('label', 'two', 'balance', turns)) END)",
        "vegas_channel": "named_struct('4h', named_struct('trend', CASE WHEN k <> 2 THEN CASE WHEN n % 2 = 0 THEN 'bullish_aligned' ELSE 'mixed' END END), '1h', named_struct('trend', 'mixed', 'rsi', n % 100, 'volume_spike', n % 3 = 0, 'last_signal', CASE WHEN k = 0 THEN 'bull_entry' END, 'bars_since_signal', turns), 'alignment', named_struct('passed', n % 2 = 0))",
        "long_short_ratio": "named_struct('current', named_struct('long_pct', n % 100, 'short_pct', 100 - n % 100), 'bias', CASE WHEN n % 100 > 50 THEN 'long_dominant' ELSE 'short_dominant' END, 'consistency_pct', turns % 100)",
    }
    each = [f"named_struct('ordinal', {i}, 'data_type', '{t}', 'content', to_json({e}))" for i, (t, e) in enumerate(text.items())]
    rows = x.select("k", F.expr(f"inline(array({', '.join(each)}))"))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("k") + 1).cast("int"))
    return rows.select(symbol.alias("symbol"), "ordinal", "data_type", F.concat_ws("-", F.lit("EV"), F.upper("data_type"), symbol).alias("evidence_id"), "content")


def q_facts(spark: SparkSession, sf: str) -> DataFrame:
    return records.facts(recorded(spark, sf))


def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The rules on metrics that each come from a record of their own."""
    found = rules.fired(staged(records.metrics_of_records(recorded(spark, sf)), "record-metrics"), rules.built_in(spark))
    return found.withColumn("weight", F.col("weight").cast("double"))


def q_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    lost = completed(spark, sf).where("is_fallback").select("symbol", F.col("label").alias("data_type"), "status", F.when(F.col("status") == "unsupported", "NotImplementedError").otherwise("TimeoutError").alias("reason"))
    return records.fallback_records(lost, spark)


def q_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of all symbols by the agent that collected them, with made-up times of a second for each place, slowest first."""
    steps = completed(spark, sf).select("agent", "label", "status", (F.col("ordinal") * 1000).cast("long").alias("duration_ms"))
    x = evidence.agent_rollup(steps)
    return x.withColumn("sources", F.array_join("sources", ","))


def q_once(spark: SparkSession, sf: str) -> DataFrame:
    """How many agents each source of each symbol is in: one."""
    return completed(spark, sf).groupBy("symbol", "label").agg(F.countDistinct("agent").alias("agents"))


def q_elided(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns as a list, long ones by their length alone."""
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", evidence.elided("turns", 3).alias("shown"))


def q_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = signals.confidence(stances(spark, sf), completed(spark, sf))
    return x.select("symbol", "confidence", evidence.confidence_label("confidence").alias("label"))


QUERIES = {"evidence_facts": q_facts, "signals_of_records": q_signals, "fallback_records": q_fallbacks, "agent_rollup": q_agents, "agents_once": q_once, "elided_series": q_elided, "confidence_labels": q_labels}

_S = "CASE {} WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' WHEN 3 THEN 'BNB' ELSE 'XRP' END"
BASE = f"""n AS (SELECT user_id % 5 AS k, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT conv_id % 5 AS k, count(*) AS turns, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles FROM conversations GROUP BY 1),
p AS (SELECT page_id % 5 AS k, coalesce(url, '') AS url, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS i FROM pages),
u AS (SELECT k, string_agg('"' || url || '"', '; ' ORDER BY i) FILTER (i <= 3) AS three, string_agg('"' || substr(url, 1, 50) || '"', '; ' ORDER BY i) FILTER (i <= 2) AS two, least(count(*), 5) AS items FROM p GROUP BY 1),
b AS (SELECT {_S.format("k")} AS symbol, * FROM n JOIN t USING (k) JOIN u USING (k))"""
#: Conditions of the built-in rules over the same numbers.
FIRED = [
    ("1a", "market", 1, "bull", 1.0, "n % 9 > 6"), ("1b", "market", 1, "bear", 1.0, "n % 9 < 2"), ("1c", "market", 1, "neutral", 0.5, "n % 9 BETWEEN 2 AND 6"),
    ("2a", "vegas_channel", 2, "bull", 1.2, "k <> 2 AND n % 2 = 0"), ("3", "vegas_channel", 3, "neutral", 1.0, "n % 2 = 1"), ("4a", "vegas_channel", 4, "bear", 1.0, "n % 100 > 80"),
    ("4b", "vegas_channel", 4, "bull", 1.0, "n % 100 < 20"), ("5", "vegas_channel", 5, "neutral", 0.8, "n % 3 = 0"), ("6a", "derivatives", 6, "bear", 1.1, "n % 7 > 3"), ("6b", "derivatives", 6, "bull", 1.1, "n % 7 < 3"),
    ("6c", "derivatives", 6, "neutral", 0.5, "n % 7 = 3"), ("7a", "long_short_ratio", 7, "bear", 0.9, "n % 100 > 50"), ("7b", "long_short_ratio", 7, "bull", 0.9, "n % 100 <= 50"),
    ("8a", "social", 8, "bull", 0.4, "turns % 3 = 0"), ("8b", "social", 8, "bear", 0.4, "turns % 3 = 1"), ("9a", "macro", 9, "bull", 0.9, "n % 100 <= 25"), ("9b", "macro", 9, "bear", 0.9, "n % 100 >= 75"),
    ("9c", "macro", 9, "neutral", 0.5, "n % 100 > 25 AND n % 100 < 75"), ("10a", "macro", 10, "bear", 0.8, "turns % 2 = 1"), ("10b", "macro", 10, "bull", 0.8, "turns % 2 = 0"), ("11", "announcement", 11, "neutral", 0.4, "k <> 1"),
]
SPECS = ", ".join(
    "(" + ", ".join("'" + s.replace("'", "''") + "'" for s in (t, i, s, u, r, json.dumps(c, sort_keys=True)[1:-1])) + ")" for t, i, s, u, r, c in records.FALLBACKS
)

ORACLE_SQL = {
    "evidence_facts": f"""WITH {BASE}, f(symbol, data_type, fact) AS (SELECT symbol, 'market', 'the price moved ' || (n % 9 - 4) || ' % over the period' FROM b
UNION ALL SELECT symbol, 'news', 'recent headlines are ' || three FROM b
UNION ALL SELECT symbol, 'macro', 'fear and greed is ' || (n % 100) || ' (c), ' || CASE WHEN turns % 7 >= 3 THEN '+' ELSE '' END || (turns % 7 - 3) || ' in 14 days' || CASE WHEN k > 0 THEN '; latest policy release "FOMC"' ELSE '; no policy release' END FROM b
UNION ALL SELECT symbol, 'announcement', CASE WHEN k = 1 THEN 'there are no announcements' ELSE items || ' announcements from ' || CASE WHEN k % 2 = 0 THEN 'the project''s own feed' ELSE 'syndicated news' END || ': ' || two END FROM b
UNION ALL SELECT symbol, 'onchain', 'onchain was observed' FROM b
UNION ALL SELECT symbol, 'social', 'the mood is ' || CASE turns % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'mixed' END || ' (for: ' || roles || CASE WHEN k = 2 THEN '; against: drop' ELSE '' END || ')' FROM b
UNION ALL SELECT symbol, 'derivatives', CASE WHEN k = 3 THEN 'funding is not known' ELSE 'funding is ' || (n % 7 - 3) || ' %, ' || CASE WHEN n % 7 > 3 THEN 'longs pay much' WHEN n % 7 < 3 THEN 'shorts pay much' ELSE 'both sides pay alike' END END FROM b
UNION ALL SELECT symbol, 'whale', CASE WHEN k = 4 THEN 'no wallets are known' ELSE 'known wallets hold one ' || format('{{:,}}', n * 1000) || '; two ' || format('{{:,}}', turns) END FROM b
UNION ALL SELECT symbol, 'vegas_channel', CASE WHEN k = 2 THEN 'the channel is not known' ELSE 'the trend is ' || CASE WHEN n % 2 = 0 THEN 'bullish_aligned' ELSE 'mixed' END || ', RSI ' || (n % 100) || CASE WHEN n % 3 = 0 THEN ', volume spikes, ' ELSE ', volume is usual, ' END
  || CASE WHEN k = 0 THEN 'last signal bull_entry ' || turns || ' bars ago' ELSE 'no signal yet' END || CASE WHEN n % 2 = 0 THEN ', timeframes agree' ELSE ', timeframes disagree' END END FROM b
UNION ALL SELECT symbol, 'long_short_ratio', (n % 100) || ' % long and ' || (100 - n % 100) || ' % short, ' || CASE WHEN n % 100 > 50 THEN 'longs hold more, ' ELSE 'shorts hold more, ' END || (turns % 100) || ' % of the time' FROM b)
SELECT symbol, data_type, 'EV-' || upper(data_type) || '-' || symbol AS evidence_id, 'EV-' || upper(data_type) || '-' || symbol || ': ' || fact AS fact FROM f""",
    "signals_of_records": f"WITH {BASE} " + " UNION ALL ".join(f"SELECT symbol, {o} AS ord, '{k}' AS rule, '{t}' AS data_type, '{s}' AS side, {w}::DOUBLE AS weight FROM b WHERE {c}" for k, t, o, s, w, c in FIRED),
    "fallback_records": f"""WITH RECURSIVE {oracle.COMPLETE}, sp(data_type, prefix, source, source_url, time_range, extra) AS (VALUES {SPECS}),
l AS (SELECT symbol, label AS data_type, status, CASE WHEN status = 'unsupported' THEN 'NotImplementedError' ELSE 'TimeoutError' END AS reason FROM comp WHERE is_fallback)
SELECT prefix || '-' || symbol || '-FALLBACK' AS evidence_id, source, source_url, data_type, symbol, time_range,
  '{{"status":"' || status || '","reason":"' || reason || '"' || CASE WHEN extra <> '' THEN ', ' || extra ELSE '' END || '}}' AS content, 0.2::DOUBLE AS reliability_score,
  '{{"fallback":true,"error_type":"' || reason || '"}}' AS content_reference, data_type || ' is not known for ' || symbol || '; this record is no live evidence' AS related_claim FROM l JOIN sp USING (data_type)""",
    "agent_rollup": f"""WITH RECURSIVE {oracle.COMPLETE} SELECT agent, string_agg(DISTINCT label, ',' ORDER BY label) AS sources, count(*) FILTER (status <> 'success') AS degraded, sum(ordinal * 1000)::BIGINT AS duration_ms FROM comp GROUP BY 1""",
    "agents_once": f"WITH RECURSIVE {oracle.COMPLETE} SELECT symbol, label, count(DISTINCT agent) AS agents FROM comp GROUP BY 1, 2",
    "elided_series": "SELECT conv_id, CASE WHEN count(*) > 3 THEN '<' || count(*) || ' points>' ELSE '[' || string_agg(turn::VARCHAR, ',' ORDER BY turn) || ']' END AS shown FROM conversations GROUP BY 1",
    "confidence_labels": f"""WITH RECURSIVE {oracle.REGION}, {oracle.METRICS}, {oracle.INVENTORY}, {oracle.STANCE}, {oracle.COMPLETE}, {oracle.CONF}
SELECT symbol, confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM conf""",
}
