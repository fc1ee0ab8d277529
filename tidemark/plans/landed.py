"""Queries over landed payloads and what is read from them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import cell, rnd, series_texts, signed
from tidemark.plans.oracle import LIST, WORDS, r
from tidemark.sources import payloads, shapes
from tidemark.sources.klines import bulk_klines, land_pages
from tidemark.sources.shared import new_path
from tidemark.sources.tables import read


def q_bulk_klines(spark: SparkSession, sf: str) -> DataFrame:
    """Minute candles of even and odd users' events, landed as pages of 1000 and read back by the walk."""
    e = read(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    minute = F.unix_timestamp(F.date_trunc("minute", "ts")) * 1000
    bars = e.groupBy(F.when(F.col("user_id") % 2 == 0, "EVEN").otherwise("ODD").alias("symbol"), minute.alias("open_time_ms")).agg(
        rnd(F.min_by("value", "at"), 4).alias("open"), rnd(F.max("value"), 4).alias("high"), rnd(F.min("value"), 4).alias("low"),
        rnd(F.max_by("value", "at"), 4).alias("close"), rnd(F.sum("value"), 4).alias("volume"),
    )
    path = new_path(spark, "kline-pages")
    land_pages(bars, path)
    return bulk_klines(spark, path)


COINS = ["ETH", "BNB", "SOL", "XRP", "BTC", "DOGE"]


def q_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """A node's answer per turn, by chain; every fifth is broken and every fifth an error that still has a result."""
    coins = ", ".join(f"'{c}'" for c in COINS)
    body = """CASE WHEN turn % 5 = 4 THEN '{"result":' WHEN turn % 5 = 3 THEN '{"error": {"code": -1}, "result": "0x1"}'
        WHEN symbol IN ('ETH', 'BNB') THEN concat('{"jsonrpc": "2.0", "result": "0x', lower(hex(conv_id * 1000 + turn)), '"}') WHEN symbol = 'SOL' THEN concat('{"result": {"epoch": ', conv_id, ', "slotIndex": 3}}')
        WHEN symbol = 'XRP' THEN concat('{"result": {"ledger_current_index": ', conv_id * turn, '}}') ELSE concat(conv_id, '\\n') END"""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.expr(f"element_at(array({coins}), CAST(conv_id % 6 AS int) + 1)").alias("symbol"))
    return shapes.heartbeats(c.withColumn("body", F.expr(body)), "symbol", "body")


PROVIDERS = ["reddit", "bluesky", "hackernews", "elsewhere"]


def social_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, provider, body): each conversation's turns as the posts of a search answer, in the shape of one of the providers."""
    said = "concat(text, CASE turn % 3 WHEN 0 THEN ' Bullish, surge!' WHEN 1 THEN ' (crash)' ELSE '' END)"
    shape = {
        "reddit": f"named_struct('kind', 't3', 'data', named_struct('title', {said}, 'permalink', concat('/r/', turn), 'created_utc', turn * 60, 'score', turn, 'num_comments', conv_id % 7))",
        "bluesky": f"named_struct('uri', concat('at://x/', turn), 'author', named_struct('handle', CASE WHEN turn % 2 = 0 THEN role END), 'record', named_struct('text', {said}), 'indexedAt', 'then', 'likeCount', turn, 'replyCount', 2, 'repostCount', CASE WHEN turn > 1 THEN 3 END)",
        "hackernews": f"named_struct('objectID', cast(turn AS string), 'title', CASE WHEN turn % 2 = 0 THEN '' END, 'story_title', CASE WHEN turn % 4 = 1 THEN 'Story of adoption' END, 'comment_text', {said}, 'points', turn, 'num_comments', 4)",
    }
    c = read(spark, sf, "conversations")
    in_order = lambda what: F.expr(f"transform(array_sort(collect_list(named_struct('turn', turn, 'p', {what}))), x -> x.p)")
    x = c.groupBy("conv_id").agg(*[in_order(s).alias(name) for name, s in shape.items()])
    body = F.when(F.col("conv_id") % 4 == 0, F.to_json(F.struct(F.struct(F.col("reddit").alias("children")).alias("data")))).when(
        F.col("conv_id") % 4 == 1, F.to_json(F.struct(F.col("bluesky").alias("posts")))).when(F.col("conv_id") % 4 == 2, F.to_json(F.struct(F.col("hackernews").alias("hits"))))
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("conv_id") % 4 + 1).cast("int"))
    return x.select("conv_id", provider.alias("provider"), F.coalesce(body, F.lit('{"hits": [')).alias("body"))


def q_social(spark: SparkSession, sf: str) -> DataFrame:
    posts = shapes.social_posts(social_answers(spark, sf), "provider", "body")
    joined = {c: F.array_join(c, ",") for c in ("positive", "negative")}
    return posts.withColumns(joined | {c: F.coalesce(c, F.lit(-1)) for c in shapes.COUNTERS})


def q_social_profile(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.social_profile(shapes.social_posts(social_answers(spark, sf), "provider", "body"), ["provider"])


def q_live(spark: SparkSession, sf: str) -> DataFrame:
    """Records of documents whose reference is marked as a fallback in all ways that JSON has to say yes and no."""
    refs = ["{}", '{"fallback": true}', '{"fallback": false}', '{"fallback": 0}', '{"fallback": "x"}', '{"fallback": null}', '{"fallback"', '{"fallback": []}', '{"fallback": 1.5}']
    ref = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, refs)), (F.col("doc_id") % 10 + 1).cast("int"))
    return read(spark, sf, "labels").select("doc_id", ref.alias("reference")).select("doc_id", shapes.is_live("reference").alias("live"))


def q_balances(spark: SparkSession, sf: str) -> DataFrame:
    """Balances from sums over events; one wallet of BNB is not answered, and no wallet of SOL is known."""
    s = read(spark, sf, "events").agg(F.sum("user_id").alias("u"), F.sum("event_id").alias("e"), F.count(F.lit(1)).alias("n"))
    known = {(c, i): a for c in ("BTC", "ETH", "BNB") for i, a in enumerate(x[2] for x in shapes.WALLETS if x[0] == c)}
    wei = lambda c: F.concat(F.lit('{"result": "0x'), F.lower(F.hex(c)), F.lit('00000000000"}'))
    many = F.to_json(F.create_map(*[x for i, c in enumerate("un") for x in (F.lit(known["BTC", i]), F.struct((F.col(c) * 12_345_678).alias("final_balance")))]))
    rows = [("BTC", "", many), ("ETH", known["ETH", 0], wei("u")), ("ETH", known["ETH", 1], wei("e")), ("BNB", known["BNB", 0], wei("n")), ("BNB", known["BNB", 1], F.lit('{"error": 1}'))]
    answers = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("symbol"), F.lit(a).alias("address"), b.alias("body")) for c, a, b in rows])))
    asked = spark.createDataFrame([("btc",), ("ETH",), ("BNB",), ("SOL",)], "symbol string")
    return shapes.balances(asked, answers, shapes.wallets(spark))


def q_announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Page urls as entries of two feeds a symbol; the first feed of XRP and both of BTC are empty, DOGE's second is."""
    page = read(spark, sf, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("title"), (F.col("page_id") % 6).alias("k"), (F.floor(F.col("page_id") / 6) % 2 + 1).cast("int").alias("priority"))
    n = F.expr("row_number() OVER (PARTITION BY k, priority ORDER BY page_id) - 1")
    symbol = F.element_at(F.array(*map(F.lit, COINS)), (F.col("k") + 1).cast("int"))
    entries = page.withColumn("n", n).withColumn("symbol", symbol).where("NOT (k = 3 AND priority = 1 OR k = 4 OR k = 5 AND priority = 2)")
    feeds = spark.createDataFrame([(c, p, f"feed {p}", p == 1) for c in COINS for p in (1, 2)], "symbol string, priority int, source string, first_party boolean")
    x = shapes.announcements(entries.select("symbol", "priority", "n", "title"), feeds)
    return x.withColumn("items", F.array_join("items", "|"))


def q_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """A history of long and short accounts per event type and day, a point an event."""
    point = """named_struct('timestamp', event_id, 'longAccount', cast((30 + event_id % 40) / 100D AS string),
        'shortAccount', cast(1 - (30 + event_id % 40) / 100D AS string), 'longShortRatio', cast((30 + event_id % 40) / 100D / (1 - (30 + event_id % 40) / 100D) AS string))"""
    e = read(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    body = F.expr(f"to_json(transform(array_sort(collect_list(named_struct('e', event_id, 'p', {point}))), x -> x.p))")
    return shapes.ratio_history(e.agg(body.alias("body")), "body")


def q_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' numbers as a report shows them."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") * 1000).alias("key"))
    change = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 1000 - 500) / 4)
    series = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1000.0), F.lit(None), F.col("o_orderkey").cast("double"))).otherwise(F.array("price", F.lit(2.0)))
    x = o.withColumns({"change": change, "series": series})
    kinds = dict(x.dtypes)
    return x.select("o_orderkey", cell(kinds, "price").alias("price"), cell(kinds, "key").alias("key"), signed("change").alias("change"), F.array_join(series_texts("series", " x"), "|").alias("series"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, body) of market series payloads: a price and a volume for each day; one type lacks its last volume."""
    e = read(spark, sf, "events").groupBy("event_type", F.unix_millis(F.date_trunc("day", "ts")).alias("ms")).agg(rnd(F.avg("value"), 4).alias("p"), rnd(F.sum("value"), 4).alias("v"))
    e = e.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("ms", "p", "v"))).alias("d"))
    pair = lambda c: F.transform("d", lambda x: F.array(x["ms"].cast("double"), x[c]))
    volumes = F.when(F.col("event_type") == "click", F.slice(pair("v"), F.lit(1), F.size("d") - 1)).otherwise(pair("v"))
    return e.select("event_type", F.to_json(F.struct(pair("p").alias("prices"), volumes.alias("total_volumes"))).alias("body"))


def q_series(spark: SparkSession, sf: str) -> DataFrame:
    x = payloads.market_series(daily(spark, sf), "body")
    lists = {"dates": F.array_join("dates", ","), "volumes": F.coalesce(F.array_join(F.transform("volumes", lambda v: F.format_string("%.4f", v)), ","), F.lit("-"))}
    return x.withColumns(lists)


def q_funding(spark: SparkSession, sf: str) -> DataFrame:
    """A premium index payload per event; every seventh has no rate."""
    rate = "CASE WHEN event_id % 7 > 0 THEN concat('{\"lastFundingRate\": \"', (event_id % 41 - 20) / 100000D, '\"}') ELSE '{}' END"
    e = read(spark, sf, "events").select("event_id", F.expr(rate).alias("body"))
    x = payloads.funding(e, "body")
    return x.withColumn("bias", F.coalesce("bias", F.lit("-")))


def q_klines(spark: SparkSession, sf: str) -> DataFrame:
    """A payload of candles per user, with a repeat of each third open time behind it and one candle that is no number."""
    candle = lambda close: f"array(cast(event_id AS string), '1', '2.5', '0.5', cast({close} AS string), CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '7' END)"
    e = read(spark, sf, "events").groupBy("user_id").agg(
        F.expr(f"array_sort(collect_list({candle('event_id / 4D')}))").alias("a"), F.expr(f"array_sort(collect_list({candle('-1')}) FILTER (WHERE event_id % 3 = 0))").alias("b")
    )
    return payloads.klines(e.select("user_id", F.to_json(F.concat("a", "b")).alias("body")), "body").withColumn("volume", F.coalesce("volume", F.lit(-1.0)))


QUERIES = {
    "bulk_klines": q_bulk_klines,
    "market_payloads": q_series,
    "funding_payloads": q_funding,
    "kline_payloads": q_klines,
    "heartbeats": q_heartbeats,
    "social_posts": q_social,
    "social_profile": q_social_profile,
    "live_evidence": q_live,
    "wallet_balances": q_balances,
    "announcements": q_announcements,
    "ratio_history": q_ratios,
    "number_formats": q_formats,
}

COIN = "CASE {} WHEN 0 THEN 'ETH' WHEN 1 THEN 'BNB' WHEN 2 THEN 'SOL' WHEN 3 THEN 'XRP' WHEN 4 THEN 'BTC' ELSE 'DOGE' END"
SOCIAL = f"""c AS (SELECT conv_id, turn, role, conv_id % 4 AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n,
  text || CASE turn % 3 WHEN 0 THEN ' Bullish, surge!' WHEN 1 THEN ' (crash)' ELSE '' END AS said FROM conversations WHERE conv_id % 4 < 3),
d AS (SELECT *, coalesce(CASE WHEN w = 2 AND turn % 4 = 1 THEN 'Story of adoption' ELSE said END, '') AS text FROM c WHERE n < 25),
posts AS (SELECT conv_id, CASE w WHEN 0 THEN 'reddit' WHEN 1 THEN 'bluesky' ELSE 'hackernews' END AS provider, n::INT AS n, CASE WHEN w = 0 THEN text ELSE substr(text, 1, 500) END AS text,
  CASE w WHEN 0 THEN 'https://www.reddit.com/r/' || turn WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN 'https://bsky.app/profile/' || role || '/post/' || turn ELSE '' END
    ELSE 'https://news.ycombinator.com/item?id=' || turn END AS url, CASE w WHEN 0 THEN (turn * 60)::VARCHAR WHEN 1 THEN 'then' END AS at,
  CASE w WHEN 0 THEN turn END AS score, CASE w WHEN 2 THEN turn END AS points, CASE w WHEN 1 THEN turn END AS likes, CASE w WHEN 0 THEN conv_id % 7 WHEN 2 THEN 4 END AS comments,
  CASE w WHEN 1 THEN 2 END AS replies, CASE WHEN w = 1 AND turn > 1 THEN 3 END AS reposts,
  list_sort(list_intersect({WORDS}, {LIST(shapes.POSITIVE)})) AS positive, list_sort(list_intersect({WORDS}, {LIST(shapes.NEGATIVE)})) AS negative FROM d)"""

ORACLE_SQL = {
    "bulk_klines": f"""WITH b AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS symbol, epoch_ms(date_trunc('minute', ts)) AS open_time_ms,
  {r("arg_min(value, (ts, event_id))", 4)} AS open, {r("max(value)", 4)} AS high, {r("min(value)", 4)} AS low, {r("arg_max(value, (ts, event_id))", 4)} AS close,
  {r("sum(value)", 4)} AS volume FROM events GROUP BY 1, 2)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) <= 1826""",
    "heartbeats": f"""WITH c AS (SELECT conv_id, turn, {COIN.format("conv_id % 6")} AS symbol FROM conversations),
h AS (SELECT *, CASE WHEN turn % 5 >= 3 THEN NULL WHEN symbol IN ('ETH', 'BNB') THEN conv_id * 1000 + turn WHEN symbol IN ('SOL', 'BTC') THEN conv_id WHEN symbol = 'XRP' THEN nullif(conv_id * turn, 0) END AS height FROM c)
SELECT *, CASE symbol WHEN 'ETH' THEN 'Ethereum' WHEN 'BNB' THEN 'BNB Smart Chain' WHEN 'SOL' THEN 'Solana' WHEN 'XRP' THEN 'XRP Ledger' WHEN 'BTC' THEN 'Bitcoin' END AS chain,
  CASE symbol WHEN 'ETH' THEN 'block' WHEN 'BNB' THEN 'block' WHEN 'SOL' THEN 'epoch' WHEN 'XRP' THEN 'ledger' WHEN 'BTC' THEN 'height' END AS kind,
  CASE WHEN symbol = 'DOGE' THEN 'unsupported' WHEN height IS NULL THEN 'failed' ELSE 'ok' END AS status FROM h""",
    "social_posts": f"""WITH {SOCIAL} SELECT * REPLACE (array_to_string(positive, ',') AS positive, array_to_string(negative, ',') AS negative,
  {", ".join(f"coalesce({c}, -1) AS {c}" for c in shapes.COUNTERS)}) FROM posts""",
    "social_profile": f"""WITH {SOCIAL}, x AS (SELECT provider, count(*) AS posts, sum({" + ".join(f"coalesce({c}, 0)" for c in shapes.COUNTERS)})::BIGINT AS engagement,
  sum(len(positive))::BIGINT AS positive_terms, sum(len(negative))::BIGINT AS negative_terms FROM posts GROUP BY 1)
SELECT *, CASE WHEN positive_terms > negative_terms THEN 'positive' WHEN negative_terms > positive_terms THEN 'negative' ELSE 'mixed' END AS sentiment, posts >= 25 AS capped FROM x""",
    "live_evidence": "SELECT doc_id, doc_id % 10 NOT IN (0, 2, 5, 9) AS live FROM labels",
    "wallet_balances": f"""WITH s AS (SELECT sum(user_id) AS u, sum(event_id) AS e, count(*) AS n FROM events),
w(symbol, label, address) AS (VALUES {", ".join(str(x) for x in shapes.WALLETS)}),
b AS (SELECT *, CASE label WHEN 'Binance Cold Wallet 1' THEN {r("u * 12345678 / 1e8", 4)} WHEN 'Binance Cold Wallet 2' THEN {r("n * 12345678 / 1e8", 4)}
  WHEN 'Binance 7' THEN {r("u * 17592186044416 / 1e18", 4)} WHEN 'Binance Hot Wallet 20' THEN {r("e * 17592186044416 / 1e18", 4)} END AS balance FROM w, s)
SELECT symbol, label, address, balance, CASE symbol WHEN 'BTC' THEN 'https://www.blockchain.com/explorer/addresses/btc/' WHEN 'ETH' THEN 'https://etherscan.io/address/' ELSE 'https://bscscan.com/address/' END || address AS explorer_url,
  CASE WHEN symbol = 'BNB' THEN 'failed' ELSE 'ok' END AS status FROM b UNION ALL SELECT 'SOL', NULL, NULL, NULL, NULL, 'unsupported'""",
    "announcements": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS title, page_id % 6 AS k, ((page_id // 6) % 2 + 1)::INT AS priority FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY k, priority ORDER BY page_id) AS n FROM p), e AS (SELECT * FROM q WHERE n <= 5 AND NOT (k = 3 AND priority = 1 OR k = 4 OR k = 5 AND priority = 2)),
f AS (SELECT k, min(priority) AS priority FROM e GROUP BY 1), g AS (SELECT k, priority, string_agg(title, '|' ORDER BY n) AS items FROM e JOIN f USING (k, priority) GROUP BY 1, 2)
SELECT {COIN.format("t.k")} AS symbol, 'feed ' || priority AS source, priority = 1 AS first_party, CASE priority WHEN 1 THEN 0.85 WHEN 2 THEN 0.55 END::DOUBLE AS reliability, coalesce(items, '') AS items
FROM range(6) t(k) LEFT JOIN g USING (k)""",
    "ratio_history": f"""WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, event_id, (30 + event_id % 40) / 100.0::DOUBLE AS l FROM events),
p AS (SELECT *, {r("l * 100", 2)} AS lp, {r("(1 - l) * 100", 2)} AS sp, {r("l / (1 - l)", 4)} AS q FROM e),
x AS (SELECT event_type, day, count(*)::INT AS points, arg_max(lp, event_id) AS long_pct, arg_max(sp, event_id) AS short_pct, arg_max(q, event_id) AS ratio, count(*) FILTER (q > 1) AS longs FROM p GROUP BY 1, 2)
SELECT event_type, day, points, long_pct, short_pct, ratio, CASE WHEN ratio > 1.02 THEN 'long_dominant' WHEN ratio < 0.98 THEN 'short_dominant' ELSE 'balanced' END AS bias,
  {r("CASE WHEN ratio > 1 THEN longs ELSE points - longs END * 100.0 / points", 1)} AS consistency_pct FROM x""",
    "number_formats": """SELECT o_orderkey, format('{:,.2f}', o_totalprice::DOUBLE) AS price, format('{:,}', o_orderkey * 1000) AS key,
  coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 1000 >= 500 THEN '+' ELSE '' END || format('{:,.2f}', ((o_orderkey % 1000 - 500) / 4.0)::DOUBLE) || '%' END, 'N/A') AS change,
  CASE WHEN o_orderkey % 2 = 0 THEN '1,000 x|N/A|' || format('{:,}', o_orderkey) || ' x' WHEN o_totalprice = floor(o_totalprice) THEN format('{:,}', o_totalprice::BIGINT) || ' x|2 x'
    ELSE format('{:,.2f}', o_totalprice::DOUBLE) || ' x|2.00 x' END AS series FROM orders""",
    "market_payloads": f"""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, {r("avg(value)", 4)} AS p, {r("sum(value)", 4)} AS v FROM events GROUP BY 1, 2)
SELECT event_type, arg_min(p, day) AS start_price, arg_max(p, day) AS end_price, {r("(arg_max(p, day) - arg_min(p, day)) / arg_min(p, day) * 100")} AS return_pct,
  string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS dates, CASE WHEN event_type = 'click' THEN '-' ELSE string_agg(printf('%.4f', v), ',' ORDER BY day) END AS volumes FROM d GROUP BY 1""",
    "funding_payloads": f"""WITH f AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN {r("(event_id % 41 - 20) / 100000.0::DOUBLE * 100", 4)} END AS funding_rate_pct FROM events)
SELECT *, CASE WHEN funding_rate_pct > 0.01 THEN 'long_crowded' WHEN funding_rate_pct < -0.01 THEN 'short_crowded' WHEN funding_rate_pct IS NOT NULL THEN 'balanced' ELSE '-' END AS bias FROM f""",
    "kline_payloads": """SELECT user_id, event_id AS open_time_ms, 1.0::DOUBLE AS open, 2.5::DOUBLE AS high, 0.5::DOUBLE AS low, event_id / 4.0::DOUBLE AS close,
  CASE WHEN event_id % 5 = 0 THEN -1 ELSE 7 END::DOUBLE AS volume FROM events""",
}
