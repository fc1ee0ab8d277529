"""Profiles of symbols and their pairwise ranking. What is missing is null and never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed, rnd


def capped(x: Column) -> Column:
    """At most 100, one digit, null for null (`least` alone would pass over it)."""
    return F.when(x.isNotNull(), rnd(F.least(F.lit(100.0), x), 1))


def liquidity(bars: DataFrame, days: int = 14) -> DataFrame:
    """(symbol, avg_volume, latest_volume, volume_trend_pct) of the last `days` bars."""
    late = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("idx")))
    first, last = F.min_by("volume", "idx"), F.max_by("volume", "idx")
    x = bars.withColumn("_late", late).where(F.col("_late") <= days).groupBy("symbol")
    trend = F.when(F.count("volume") >= 2, F.try_divide(last, first) - 1)
    return x.agg(
        rnd(F.avg("volume"), 2).alias("avg_volume"), rnd(last, 2).alias("latest_volume"), rnd(trend * 100, 2).alias("volume_trend_pct")
    )


def realised_volatility(bars: DataFrame, days: int = 14) -> DataFrame:
    """(symbol, realised_volatility): population deviation of returns, 5 % a day is 100; needs three prices."""
    late = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("idx")))
    own = Window.partitionBy("symbol").orderBy("idx")
    x = bars.withColumn("_late", late).where(F.col("_late") <= days)
    x = x.withColumn("_r", F.try_divide("close", F.lag("close").over(own)) - 1).groupBy("symbol")
    dev = F.when((F.count("close") >= 3) & (F.count("_r") >= 2), F.stddev_pop("_r"))
    return x.agg(capped(dev / 0.05 * 100).alias("realised_volatility"))


COMPONENTS = ["funding_stress", "positioning_crowding", "rsi_extremity", "timeframe_conflict", "realised_volatility"]


def risk_composite(metrics: DataFrame, volatility: DataFrame) -> DataFrame:
    """(symbol, five components, components_available, composite_score): mean of those there are."""
    x = metrics.join(volatility, "symbol", "left").withColumns(
        {
            "funding_stress": capped(F.abs("funding_pct") / 0.05 * 100),
            "positioning_crowding": capped(F.abs(F.col("long_pct") - 50) * 2),
            "rsi_extremity": capped(F.abs(F.col("rsi") - 50) / 50 * 100),
            "timeframe_conflict": F.when(F.col("aligned"), 0.0).otherwise(F.when(F.col("aligned").isNotNull(), 100.0)),
        }
    )
    there = F.array_compact(F.array(*COMPONENTS))
    total = F.aggregate(there, F.lit(0.0), lambda a, v: a + v)
    return x.select(
        "symbol", *COMPONENTS, F.size(there).alias("components_available"), rnd(F.try_divide(total, F.size(there)), 1).alias("composite_score")
    )


def attention(posts: DataFrame, counters: list[str], news: DataFrame | None = None) -> DataFrame:
    """(symbol, posts, engagement, capped): null counters count as zero. 25 posts and, where news (symbol, ...) are given
    and counted in a column `news`, 5 articles are the fetch limits."""
    each = F.coalesce(F.col(counters[0]), F.lit(0))
    for c in counters[1:]:
        each = each + F.coalesce(F.col(c), F.lit(0))
    x = posts.groupBy("symbol").agg(F.count(F.lit(1)).alias("posts"), F.sum(each).alias("engagement"))
    if news is None:
        return x.withColumn("capped", F.col("posts") >= 25)
    x = x.join(news.groupBy("symbol").agg(F.count(F.lit(1)).alias("news")), "symbol", "full").fillna(0, ["posts", "engagement", "news"])
    return x.withColumn("capped", (F.col("posts") >= 25) | (F.col("news") >= 5))


def ranked(x: str, y: str) -> tuple[Column, Column, Column]:
    """leader, verdict and ratio of columns a and b by their values x and y.

    One missing: the other leads; both missing: nobody; equal: tie. A ratio is given from 1.1 on."""
    u, v = F.col(x), F.col(y)
    leader = (
        F.when(u.isNull() & v.isNull(), None)
        .when(u.isNull(), F.col("b"))
        .when(v.isNull(), F.col("a"))
        .when(u > v, F.col("a"))
        .when(v > u, F.col("b"))
    )
    verdict = F.when(u.isNull() & v.isNull(), "unknown").when(u.isNull() | v.isNull(), "only one known").when(u == v, "tie").otherwise("leads")
    ratio = F.try_divide(F.greatest(u, v), F.least(u, v))
    return leader, verdict, F.when(u.isNotNull() & v.isNotNull() & (ratio >= 1.1), rnd(ratio, 2))


def _asked(profiles: DataFrame, asked: DataFrame, measures: list[str]) -> DataFrame:
    """The comparisons (a, b), without those of a symbol with itself, with both sides' measures as x_ and y_ columns."""
    side = lambda s, p: profiles.select(F.col("symbol").alias(s), *[F.col(m).alias(f"{p}_{m}") for m in measures])
    return asked.select("a", "b").where("a != b").join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")


def pairwise(profiles: DataFrame, asked: DataFrame, measure: str) -> DataFrame:
    """(a, b, leader, verdict, ratio) of the comparisons (a, b) that are asked for; profiles has a row per symbol."""
    leader, verdict, ratio = ranked(f"x_{measure}", f"y_{measure}")
    return _asked(profiles, asked, [measure]).select("a", "b", leader.alias("leader"), verdict.alias("verdict"), ratio.alias("ratio"))


#: Parts of a comparison and the measure each is ranked by.
DIMENSIONS = {"liquidity": "avg_volume", "risk": "composite_score", "attention": "engagement"}


def comparison(profiles: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, then leader, verdict and ratio of liquidity, risk and attention, note, summary, report) per comparison asked for.

    profiles: a row per symbol with avg_volume, composite_score, engagement, news, posts and capped. note: set where a
    side's counts reached their fetch limits. The report is Markdown with both sides' figures."""
    x = _asked(profiles, asked, [*DIMENSIONS.values(), "news", "posts", "capped"])
    for name, measure in DIMENSIONS.items():
        parts = dict(zip(("leader", "verdict", "ratio"), ranked(f"x_{measure}", f"y_{measure}")))
        x = x.withColumns({f"{name}_{part}": c for part, c in parts.items()})
    capped = F.coalesce("x_capped", F.lit(False)) | F.coalesce("y_capped", F.lit(False))
    said = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("more liquid: "), "liquidity_leader"), F.concat(F.lit("more exposed: "), "risk_leader"), F.concat(F.lit("more attention: "), "attention_leader"))), "; ")
    both = F.col("liquidity_leader") == F.col("risk_leader")
    more = F.when(both, F.concat(F.lit("; "), "risk_leader", F.lit(" moves by active trade"))).when(
        ~both, F.concat(F.lit("; "), "risk_leader", F.lit(" is exposed at less liquidity"))
    )
    x = x.withColumn("note", F.when(capped, "counts are at their fetch limits"))
    x = x.withColumn("summary", F.when(said == "", "too little data to tell them apart").otherwise(F.concat(said, F.coalesce(more, F.lit("")))))
    row = lambda label, m, d, last: F.concat(F.lit(f"| {label} | "), fixed(f"x_{m}", d), F.lit(" | "), fixed(f"y_{m}", d), F.lit(" | "), last, F.lit(" |"))
    text = F.array_join(F.array(
        F.concat(F.lit("## "), "a", F.lit(" vs "), "b"), F.col("summary"), F.concat(F.lit("| | "), "a", F.lit(" | "), "b", F.lit(" | verdict |")), F.lit("|---|---|---|---|"),
        *[row(name, m, 2, F.concat_ws(" ", f"{name}_leader", f"{name}_verdict")) for name, m in DIMENSIONS.items()],
        row("news", "news", 0, F.coalesce("note", F.lit(""))), row("posts", "posts", 0, F.lit(""))), "\n")
    ranks = [f"{name}_{part}" for name in DIMENSIONS for part in ("leader", "verdict", "ratio")]
    return x.select("a", "b", *ranks, "note", "summary", text.alias("report"))
