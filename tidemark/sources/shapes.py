"""Provider payloads of several shapes, landed as JSON text and read as VARIANT: what a payload lacks is null, not an error.

Broken JSON is a payload without anything in it. Every function keeps a payload's other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd
from tidemark.functions.text import words_of
from tidemark.sources.payloads import hex_wei, satoshi

#: Chains by symbol, and the shape of what their nodes answer.
CHAINS = {"ETH": ("Ethereum", "block"), "BNB": ("BNB Smart Chain", "block"), "SOL": ("Solana", "epoch"), "XRP": ("XRP Ledger", "ledger"), "BTC": ("Bitcoin", "height")}
#: Known wallets (symbol, label, address) and where they can be looked up.
WALLETS = [
    ("BTC", "Binance Cold Wallet 1", "34xp4vRoCGJym3xR7yCVPFHoCNxv4Twseo"),
    ("BTC", "Binance Cold Wallet 2", "3M219KR5vEneNb47ewrPfWyb5jQ2DjxRP6"),
    ("ETH", "Binance 7", "0xbe0eb53f46cd790cd13851d5eff43d12404d33e8"),
    ("ETH", "Binance Hot Wallet 20", "0xf977814e90da44bfa03b6295a0616a897441acec"),
    ("BNB", "Binance 7 (BSC)", "0xbe0eb53f46cd790cd13851d5eff43d12404d33e8"),
    ("BNB", "Binance Hot Wallet 20 (BSC)", "0xf977814e90da44bfa03b6295a0616a897441acec"),
]
EXPLORERS = {"BTC": "https://www.blockchain.com/explorer/addresses/btc/", "ETH": "https://etherscan.io/address/", "BNB": "https://bscscan.com/address/"}
#: Words that posts are looked through for, posts of a payload that count, and code points of a post that are kept.
POSITIVE = ["bull", "bullish", "gain", "gains", "surge", "breakout", "adoption", "upgrade"]
NEGATIVE = ["bear", "bearish", "loss", "losses", "drop", "crash", "hack", "exploit"]
POSTS, KEPT = 25, 500
#: Reliability of announcements from a project's own feed, and of syndicated ones.
FIRST_PARTY, SYNDICATED = 0.85, 0.55
#: Counters of a post, of which each provider has some.
COUNTERS = ("score", "points", "likes", "comments", "replies", "reposts")


def field(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def truthy(v: Column) -> Column:
    """Whether a variant is anything but missing, null, false, zero or empty."""
    text = F.coalesce(v.cast("string"), F.lit(""))
    number = F.coalesce(text.try_cast("double") == 0, F.lit(False)) & ~F.schema_of_variant(v).isin("STRING")
    return v.isNotNull() & ~F.is_variant_null(v) & ~text.isin("", "false", "[]", "{}") & ~number


def is_live(reference: str) -> Column:
    """Whether a record is there and its reference, JSON text, is not marked as a fallback."""
    mark = F.try_variant_get(F.try_parse_json(F.col(reference)), "$.fallback", "variant")
    return F.col(reference).isNotNull() & ~F.coalesce(truthy(mark), F.lit(False))


def heartbeats(df: DataFrame, symbol: str, body: str) -> DataFrame:
    """(other columns, chain, kind, height, status) of chain nodes' answers: a block in hexadecimal, a plain height, an epoch,
    a ledger's index. `failed` where the answer is an error, broken or has no number, `unsupported` for other symbols."""
    rest = [c for c in df.columns if c != body]
    v = df.withColumn("_v", F.try_parse_json(F.col(body)))
    chain, kind = (F.create_map(*[F.lit(x) for s, c in CHAINS.items() for x in (s, c[k])])[F.upper(symbol)] for k in (0, 1))
    block = field("_v", "$.result")
    no_error = F.try_variant_get("_v", "$.error", "variant").isNull()
    hexed = F.when(no_error & F.lower(block).rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(block, 3, 15), 16, 10).cast("bigint"))
    height = (
        F.when(kind == "block", hexed)
        .when(kind == "height", F.trim(body).try_cast("bigint"))
        .when(kind == "epoch", field("_v", "$.result.epoch", "bigint"))
        .when(kind == "ledger", F.nullif(field("_v", "$.result.ledger_current_index", "bigint"), F.lit(0).cast("bigint")))
    )
    status = F.when(kind.isNull(), "unsupported").when(height.isNull(), "failed").otherwise("ok")
    return v.select(*rest, chain.alias("chain"), kind.alias("kind"), height.alias("height"), status.alias("status"))


def social_posts(df: DataFrame, provider: str, body: str) -> DataFrame:
    """(other columns, n, text, url, at, counters, positive, negative) of the first POSTS posts of search answers.

    provider: `reddit` (data.children of titles), `bluesky` (posts of records), `hackernews` (hits of stories and comments).
    positive and negative are the lexicon words of the whole text, `text` is cut at KEPT; counters that a provider does not
    have are null. Answers of other providers, without posts or broken have no rows."""
    rest = [c for c in df.columns if c != body]
    v = df.withColumn("_v", F.try_parse_json(F.col(body)))
    paths = {"reddit": "$.data.children", "bluesky": "$.posts", "hackernews": "$.hits"}
    posts = F.lit(None).cast("array<variant>")
    for name, path in paths.items():
        posts = F.when(F.col(provider) == name, field("_v", path, "array<variant>")).otherwise(posts)
    p = v.withColumn("_posts", F.slice(posts, 1, POSTS)).select(*rest, F.posexplode("_posts").alias("n", "_p"))
    is_ = lambda name: F.col(provider) == name
    whole = F.when(is_("reddit"), field("_p", "$.data.title")).when(is_("bluesky"), field("_p", "$.record.text")).otherwise(
        F.coalesce(*[_filled(field("_p", f"$.{c}")) for c in ("title", "story_title", "comment_text")])
    )
    handle, key = field("_p", "$.author.handle"), F.substring_index(field("_p", "$.uri"), "/", -1)
    profile = F.when((handle != "") & (key != ""), F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), key)).otherwise("")
    story = F.coalesce(_filled(field("_p", "$.url")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.coalesce(field("_p", "$.objectID"), F.lit(""))))
    permalink = F.concat(F.lit("https://www.reddit.com"), F.coalesce(field("_p", "$.data.permalink"), F.lit("")))
    counts = {
        "score": ("reddit", "$.data.score"), "points": ("hackernews", "$.points"), "likes": ("bluesky", "$.likeCount"),
        "replies": ("bluesky", "$.replyCount"), "reposts": ("bluesky", "$.repostCount"),
    }
    counters = {name: F.when(is_(who), field("_p", path, "bigint")) for name, (who, path) in counts.items()}
    counters["comments"] = F.when(is_("reddit"), field("_p", "$.data.num_comments", "bigint")).when(is_("hackernews"), field("_p", "$.num_comments", "bigint"))
    hits = lambda words: F.array_sort(F.array_intersect(words_of("_text"), F.array(*map(F.lit, words))))
    return p.withColumn("_text", F.coalesce(whole, F.lit(""))).select(
        *rest,
        "n",
        F.when(is_("reddit"), F.col("_text")).otherwise(F.substring("_text", 1, KEPT)).alias("text"),
        F.when(is_("reddit"), permalink).when(is_("bluesky"), profile).otherwise(story).alias("url"),
        F.when(is_("reddit"), field("_p", "$.data.created_utc")).when(is_("bluesky"), field("_p", "$.indexedAt")).otherwise(field("_p", "$.created_at")).alias("at"),
        *[counters[c].alias(c) for c in COUNTERS],
        hits(POSITIVE).alias("positive"),
        hits(NEGATIVE).alias("negative"),
    )


def social_profile(posts: DataFrame, key: list[str]) -> DataFrame:
    """(key, posts, engagement, positive_terms, negative_terms, sentiment, capped) of `social_posts`: all six counters, null ones as 0."""
    engagement = sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNTERS[1:]), F.coalesce(F.col(COUNTERS[0]), F.lit(0)))
    x = posts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("posts"), F.sum(engagement).alias("engagement"),
        F.sum(F.size("positive")).alias("positive_terms"), F.sum(F.size("negative")).alias("negative_terms"),
    )
    mood = F.when(F.col("positive_terms") > F.col("negative_terms"), "positive").when(F.col("negative_terms") > F.col("positive_terms"), "negative")
    return x.withColumns({"sentiment": mood.otherwise("mixed"), "capped": F.col("posts") >= POSTS})


def wallets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WALLETS, "symbol string, label string, address string")


def balances(asked: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """(symbol, label, address, balance, explorer_url, status) of the known wallets of each symbol that is asked for.

    answers: (symbol, address, body). Bitcoin's body is one map of all addresses to final_balance in satoshi, under any
    address; the others' are JSON-RPC results in hexadecimal wei, one an address. `unsupported` (one row, without a wallet)
    where no wallet is known; `failed`, without balances, where any wallet of the symbol has none; else `ok`."""
    v = answers.select("symbol", "address", F.try_parse_json("body").alias("_v"))
    one = v.where("symbol != 'BTC'").select("symbol", "address", hex_wei_of(field("_v", "$.result")).alias("balance"))
    many = v.where("symbol = 'BTC'").select("symbol", F.explode(field("_v", "$", "map<string, variant>")).alias("address", "_b"))
    many = many.select("symbol", "address", satoshi(field("_b", "$.final_balance", "bigint")).alias("balance"))
    found = one.unionAll(many).groupBy("symbol", "address").agg(F.max("balance").alias("balance"))
    symbols = asked.select(F.upper("symbol").alias("symbol")).distinct()
    held = symbols.join(F.broadcast(known), "symbol", "left").join(found, ["symbol", "address"], "left")
    whole = held.groupBy("symbol").agg((F.count(F.lit(1)) == F.count("balance")).alias("_whole"))
    status = F.when(F.col("address").isNull(), "unsupported").when(F.col("_whole"), "ok").otherwise("failed")
    url = F.concat(F.create_map(*[F.lit(x) for pair in EXPLORERS.items() for x in pair])[F.col("symbol")], "address")
    return held.join(whole, "symbol").withColumn("status", status).select(
        "symbol", "label", "address", F.when(F.col("status") == "ok", F.col("balance")).alias("balance"), url.alias("explorer_url"), "status"
    )


def hex_wei_of(text: Column) -> Column:
    """Ether of a hexadecimal amount in wei; null for what is none."""
    return F.when(F.lower(text).rlike("^0x[0-9a-f]{1,30}$"), hex_wei(text))


def announcements(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(symbol, source, first_party, reliability, items) of each symbol's first feed that has entries; null source if none has.

    feeds: (symbol, priority, source, first_party); entries: (symbol, priority, n, title). items are the titles of the first five."""
    titles = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", "title"))), 1, 5), lambda e: e["title"])
    full = entries.where("n < 5").groupBy("symbol", "priority").agg(titles.alias("items"))
    best = feeds.join(full, ["symbol", "priority"]).groupBy("symbol").agg(F.min_by(F.struct("source", "first_party", "items"), "priority").alias("b"))
    x = feeds.select("symbol").distinct().join(best, "symbol", "left").select("symbol", "b.*")
    score = F.when(F.col("first_party"), FIRST_PARTY).when(~F.col("first_party"), SYNDICATED)
    return x.select("symbol", "source", "first_party", score.alias("reliability"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def ratio_history(df: DataFrame, body: str) -> DataFrame:
    """(other columns, points, long_pct, short_pct, ratio, bias, consistency_pct) of a history of long and short accounts.

    Each point is rounded first; the last is the current one; the bias is by 1.02 and 0.98, the consistency the share of
    points on the current one's side of 1, where exactly 1 is the short side. Payloads without points have no rows."""
    rest = [c for c in df.columns if c != body]
    rows = F.try_variant_get(F.try_parse_json(F.col(body)), "$", "array<struct<longAccount: string, shortAccount: string, longShortRatio: string>>")
    double = lambda r, c: r[c].try_cast("double")
    history = F.transform(rows, lambda r: F.struct(
        rnd(double(r, "longAccount") * 100, 2).alias("l"), rnd(double(r, "shortAccount") * 100, 2).alias("s"), rnd(double(r, "longShortRatio"), 4).alias("r")))
    x = df.select(*rest, history.alias("h")).where(F.size("h") > 0).withColumn("c", F.element_at("h", -1))
    same = F.size(F.filter("h", lambda p: (p["r"] > 1) == (F.col("c.r") > 1)))
    bias = F.when(F.col("c.r") > 1.02, "long_dominant").when(F.col("c.r") < 0.98, "short_dominant").otherwise("balanced")
    return x.select(
        *rest, F.size("h").alias("points"), F.col("c.l").alias("long_pct"), F.col("c.s").alias("short_pct"), F.col("c.r").alias("ratio"), bias.alias("bias"),
        rnd(same * 100.0 / F.size("h"), 1).alias("consistency_pct"),
    )
