"""Evidence records: schema, completeness, quality rules, deduplication and ledger snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd

SCHEMA = (
    "evidence_id string, source string, source_url string, fetched_at string, data_type string, coin string, "
    "time_range string, content string, reliability_score double, content_reference string, related_claim string"
)
#: Sources in canonical order with their agent, reliability and time range.
SOURCES = [
    (0, "market", "market_agent", 0.90, "14d"),
    (1, "news", "news_agent", 0.60, "14d"),
    (2, "macro", "macro_agent", 0.80, "14d"),
    (3, "announcement", "macro_agent", 0.85, "recent"),
    (4, "onchain", "onchain_agent", 0.70, "current"),
    (5, "social", "social_agent", 0.45, "7d"),
    (6, "derivatives", "technical_agent", 0.75, "current"),
    (7, "whale", "onchain_agent", 0.65, "current"),
    (8, "vegas_channel", "technical_agent", 0.70, "4h trend / 1h execution"),
    (9, "long_short_ratio", "technical_agent", 0.70, "last 24x1h"),
    (10, "tvl", "onchain_agent", 0.75, "last Nd"),
]
#: Reliability of what stands in for a failed source, and the symbols that can be asked for.
FALLBACK = 0.20
SYMBOLS = ("BTC", "ETH", "SOL", "BNB", "XRP")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "ordinal int, label string, agent string, reliability double, time_range string")


def with_defaults(evidence: DataFrame) -> DataFrame:
    """Empty references and claims filled from the record itself."""
    ref = F.to_json(F.struct(F.concat_ws(" ", "source", "data_type").alias("summary"), "time_range"))
    claim = F.concat_ws(" ", F.lit("supports the reading of"), "data_type", F.lit("for"), "coin")
    return evidence.withColumns(
        {
            "content_reference": F.coalesce(F.nullif("content_reference", F.lit("")), ref),
            "related_claim": F.coalesce(F.nullif("related_claim", F.lit("")), claim),
        }
    )


def request_error(coin: str, question: str, symbols=SYMBOLS) -> Column:
    """First rule a request breaks, null for a good one."""
    return F.coalesce(
        F.when(~F.upper(F.trim(F.coalesce(F.col(coin), F.lit("")))).isin(*symbols), "unsupported symbol"),
        F.when(F.trim(F.coalesce(F.col(question), F.lit(""))) == "", "question is empty"),
        F.when(F.length(F.trim(question)) > 500, "question is too long"),
    )


def complete(observed: DataFrame, keys: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected source of every key in canonical order: the observed row, or a fallback of fixed low reliability.

    observed: (symbol, label, evidence_id, reliability, status); keys: (symbol); expected: `sources`. A
    source that failed or is absent gets id suffix -FALLBACK and status `unsupported` or `unavailable`."""
    wanted = keys.select("symbol").distinct().withColumn("_one", F.lit(1)).join(
        F.broadcast(expected.select("ordinal", "label", "agent", "time_range").withColumn("_one", F.lit(1))), "_one"
    )
    x = wanted.drop("_one").join(observed, ["symbol", "label"], "left")
    live = F.coalesce(F.col("status") == "success", F.lit(False))
    return x.select(
        "symbol",
        "ordinal",
        "label",
        "agent",
        F.when(live, F.col("evidence_id")).otherwise(F.concat(F.lit("EV-"), F.upper("label"), F.lit("-"), "symbol", F.lit("-FALLBACK"))).alias("evidence_id"),
        F.when(live, F.col("reliability")).otherwise(FALLBACK).alias("reliability"),
        F.when(live, "success").when(F.col("status") == "unsupported", "unsupported").otherwise("unavailable").alias("status"),
        (~live).alias("is_fallback"),
    )


def first_available(rows: DataFrame, key: list[str], priority: str, usable: Column) -> DataFrame:
    """For each key the usable row of lowest priority number: providers tried in order, the first that answers wins."""
    best = Window.partitionBy(*key).orderBy(priority)
    return rows.where(usable).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


#: Fields that every record has.
REQUIRED = (
    "evidence_id", "source", "source_url", "fetched_at", "data_type", "coin", "time_range", "content", "content_reference", "related_claim",
    "reliability_score",
)


def quality_findings(evidence: DataFrame, key: str = "evidence_id") -> DataFrame:
    """(evidence_id, finding) for each rule that a record breaks; second and later records of an id are duplicates.

    Absent fields are one finding that names them in order; an absent score is also out of range. Records without
    an id are nobody's duplicates and are dealt out by their other fields."""
    own = F.when(F.col(key).isNull(), F.xxhash64("fetched_at", "source", "content_reference"))
    again = F.row_number().over(Window.partitionBy(key, own).orderBy("fetched_at", "source", F.xxhash64(*evidence.columns))) > 1
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in sorted(REQUIRED)]))
    rules = [
        (F.concat(F.lit("missing "), F.array_join(absent, ", ")), F.size(absent) > 0),
        (F.lit("duplicate id"), again & F.col(key).isNotNull()),
        (F.lit("empty source"), blank("source") | blank("source_url")),
        (F.lit("empty traceability"), blank("content_reference") | blank("related_claim")),
        (F.lit("score out of range"), ~F.coalesce(F.col("reliability_score"), F.lit(-1.0)).between(0, 1)),
        (F.lit("bad timestamp"), F.try_to_timestamp(F.replace(F.col("fetched_at"), F.lit("Z"), F.lit("+00:00"))).isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))
    return evidence.select(key, found.alias("found")).select(key, F.explode("found").alias("finding"))


def dangling(references: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """References whose id no record has."""
    return references.join(evidence.select(key).distinct(), key, "left_anti")


def dedupe_top(items: DataFrame, key: list[str], title: str, order: list[Column], most: int) -> DataFrame:
    """First item of each lower-cased title within a key, then the first `most` of each key, numbered from 1."""
    same = Window.partitionBy(*key, F.lower(title)).orderBy(*order)
    first = items.withColumn("_d", F.row_number().over(same)).where("_d = 1").drop("_d")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)


def news_union(publishers: DataFrame, search: DataFrame, key: str, title: str, order: str, limit: int = 5) -> DataFrame:
    """(key, order, title, from_publisher, rank): items of publishers first, each title once in any case, then of the search feed.

    Of the search feed only the first `limit` items of a key count, without those whose title a publisher has, cut or not.
    Publishers' items without a title are left out. At most `limit` items of a key stay; a null key is a key of its own."""
    low = F.lower(F.coalesce(F.col(title), F.lit("")))
    titled = publishers.where(low != "")
    seen = titled.select(F.col(key).alias("_key"), F.xxhash64(low).alias("_hash"), low.alias("_low")).distinct()
    ours = dedupe_top(titled.select(key, order, title), [key], title, [F.col(order)], limit).drop("rank")
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    theirs = search.select(key, order, title).withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")
    known = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(low) == F.col("_hash")) & (low == F.col("_low"))
    theirs = theirs.join(seen, known, "left_anti")
    both = ours.withColumn("from_publisher", F.lit(True)).unionByName(theirs.withColumn("from_publisher", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("from_publisher"), order))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit)


def policy_releases(releases: DataFrame, keys: DataFrame, limit: int = 5) -> DataFrame:
    """(symbol, policy_status, releases, latest_fomc): of each symbol's first `limit` releases (symbol, n, title) how many
    there are and the first whose title has FOMC in any case; `unavailable:empty` for symbols without a release."""
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("n"))
    top = releases.withColumn("_k", first).where(F.col("_k") <= limit)
    fomc = F.when(F.contains(F.upper("title"), F.lit("FOMC")), F.col("n"))
    one = top.groupBy("symbol").agg(F.count(F.lit(1)).alias("releases"), F.min_by("title", fomc).alias("latest_fomc"))
    x = keys.select("symbol").distinct().join(one, "symbol", "left")
    status = F.when(F.col("releases") > 0, "available").otherwise("unavailable:empty")
    return x.select("symbol", status.alias("policy_status"), F.coalesce("releases", F.lit(0)).alias("releases"), "latest_fomc")


def numeric_elements(series: str) -> Column:
    """Elements of a list that are numbers, as doubles, in their order."""
    return F.array_compact(F.transform(F.col(series), lambda x: x.try_cast("double")))


def keep_newest(ledger: DataFrame, most: int = 30) -> DataFrame:
    """The newest `most` snapshots of each coin; a snapshot is all rows of a (coin, fetched_at), repeats once."""
    one = ledger.dropDuplicates(["coin", "fetched_at", "label"])
    rank = F.dense_rank().over(Window.partitionBy("coin").orderBy(F.desc("fetched_at")))
    return one.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def snapshot_delta(ledger: DataFrame) -> DataFrame:
    """(coin, fetched_at, label, balance, previous_at, previous, delta): newest snapshot against the latest earlier one
    that shares a label with it. First sightings have null previous."""
    newest = ledger.groupBy("coin").agg(F.max("fetched_at").alias("_now"))
    rows = ledger.join(newest, "coin")
    now = rows.where("fetched_at = _now").drop("_now")
    labels = now.select("coin", "label")
    shared = rows.where("fetched_at < _now").join(labels, ["coin", "label"], "left_semi")
    at = shared.groupBy("coin").agg(F.max("fetched_at").alias("previous_at"))
    before = ledger.join(at, "coin").where("fetched_at = previous_at").select("coin", "label", F.col("balance").alias("previous"))
    joined = now.join(at, "coin", "left").join(before, ["coin", "label"], "left")
    return joined.withColumn("delta", rnd(F.col("balance") - F.col("previous"), 4))


def crawl_status(allowed: list[str], url: str, robots: str, body: str, late: str) -> Column:
    """Why an article has its full text or not: deadline, allow-list, robots, fetch failure, emptiness, in this order."""
    # fixed values: the statuses as reports name them
    host = F.regexp_replace(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")), r"^www\.", "")
    return (
        F.when(F.col(late), "skipped:deadline")
        .when(~host.isin(*allowed), "skipped:not_whitelisted")
        .when(~F.coalesce(F.col(robots), F.lit(False)), "skipped:robots")
        .when(F.col(body).isNull(), "failed")
        .when(F.trim(body) == "", "empty")
        .otherwise("ok")
    )


def elided(series: str, most: int = 12) -> Column:
    """A list as text, or only its length if it has more than `most` points."""
    c = F.col(series)
    return F.when(F.size(c) > most, F.concat(F.lit("<"), F.size(c).cast("string"), F.lit(" points>"))).otherwise(F.to_json(c))


def agent_rollup(steps: DataFrame) -> DataFrame:
    """(agent, sources, degraded, duration_ms) of (agent, label, status, duration_ms), slowest first."""
    out = steps.groupBy("agent").agg(
        F.array_sort(F.collect_set("label")).alias("sources"),
        F.count(F.when(F.col("status") != "success", 1)).alias("degraded"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    return out.orderBy(F.desc("duration_ms"), "agent")


def confidence_label(value: str) -> Column:
    return F.when(F.col(value) >= 0.7, "high").when(F.col(value) >= 0.45, "medium").otherwise("low")
