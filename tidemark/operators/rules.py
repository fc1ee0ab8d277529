"""Signal rules as rows of a table, matched with metrics by a bucketed range join.

Metrics are turned into rows (symbol, metric, value or text). A rule is one row for each of its conditions: an interval of
a metric's value, or a text that the metric equals. Rows of a rule with the same `part` are alternatives, and a rule fires
if each of its parts has one that holds. So rules can be added as data: neither the plan nor the code grows with them.

An interval is put into the buckets of the size class (a power of two) of its width, of which it meets two at most; a value
is looked up in its one bucket of each size class that its metric's rules use. Intervals that are open to a side meet
every value of their metric, since they hold for about as many.

Of a rule with several parts, the part that meets the fewest values is matched first. Only the rows that it leaves are held
against the rule's other parts, so the work follows the rows of the most selective part and not those of the least.

Most rules are one closed interval, or that and one more condition. Where each key has one row of metrics, that row goes with its
value to the interval and answers for the other condition too: each pair that holds is met once and is a row of the result as it
is, so of those only metrics and rules are shuffled and not the pairs, of which there are about as many as both multiplied."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tidemark.sources.shared import staged

SCHEMA = (
    "ord int, rule string, data_type string, side string, weight decimal(6,2), part int, metric string, "
    "low double, low_in boolean, high double, high_in boolean, text string"
)
#: Fixed values: (order, rule, source, side, weight, conditions), a condition being (part, metric, low, with low, high, with high, text).
BUILT_IN = [
    (1, "1a", "market", "bull", 1.0, [(0, "return_pct", 2.0, False, None, False, None)]),
    (1, "1b", "market", "bear", 1.0, [(0, "return_pct", None, False, -2.0, False, None)]),
    (1, "1c", "market", "neutral", 0.5, [(0, "return_pct", -2.0, True, 2.0, True, None)]),
    (2, "2a", "vegas_channel", "bull", 1.2, [(0, "trend", None, False, None, False, "bullish_aligned")]),
    (2, "2b", "vegas_channel", "bear", 1.2, [(0, "trend", None, False, None, False, "bearish_aligned")]),
    (3, "3", "vegas_channel", "neutral", 1.0, [(0, "aligned", 0.0, True, 0.0, True, None)]),
    (4, "4a", "vegas_channel", "bear", 1.0, [(0, "rsi", 80.0, False, None, False, None)]),
    (4, "4b", "vegas_channel", "bull", 1.0, [(0, "rsi", None, False, 20.0, False, None)]),
    (5, "5", "vegas_channel", "neutral", 0.8, [(0, "volume_spike", 1.0, True, 1.0, True, None)]),
    (6, "6a", "derivatives", "bear", 1.1, [(0, "funding_bias", None, False, None, False, "long_crowded")]),
    (6, "6b", "derivatives", "bull", 1.1, [(0, "funding_bias", None, False, None, False, "short_crowded")]),
    (6, "6c", "derivatives", "neutral", 0.5, [(0, "funding_bias", None, False, None, False, "balanced")]),
    (7, "7a", "long_short_ratio", "bear", 0.9, [(0, "ratio_bias", None, False, None, False, "long_dominant")]),
    (7, "7b", "long_short_ratio", "bull", 0.9, [(0, "ratio_bias", None, False, None, False, "short_dominant")]),
    (8, "8a", "social", "bull", 0.4, [(0, "sentiment", None, False, None, False, "positive")]),
    (8, "8b", "social", "bear", 0.4, [(0, "sentiment", None, False, None, False, "negative")]),
    (9, "9a", "macro", "bull", 0.9, [(0, "fear_greed", None, False, 25.0, True, None)]),
    (9, "9b", "macro", "bear", 0.9, [(0, "fear_greed", 75.0, True, None, False, None)]),
    (9, "9c", "macro", "neutral", 0.5, [(0, "fear_greed", 25.0, False, 75.0, False, None)]),
    (10, "10a", "macro", "bear", 0.8, [(0, "risk_appetite", None, False, None, False, "deteriorating")]),
    (10, "10b", "macro", "bull", 0.8, [(0, "risk_appetite", None, False, None, False, "improving")]),
    (11, "11", "announcement", "neutral", 0.4, [(0, "announcements", 0.0, False, None, False, None)]),
    (12, "12a", "tvl", "bull", 0.7, [(0, "change_30d", None, False, None, False, None), (1, "tvl_direction", None, False, None, False, "expanding")]),
    (12, "12b", "tvl", "bear", 0.7, [(0, "change_30d", None, False, None, False, None), (1, "tvl_direction", None, False, None, False, "contracting")]),
    (12, "12c", "tvl", "neutral", 0.4, [(0, "change_30d", None, False, None, False, None), (1, "tvl_direction", None, False, None, False, "stable"), (1, "tvl_direction", None, False, None, False, "unknown")]),
]
#: Conditions that are sent to every task at most; beyond that the join shuffles.
FEW = 100_000
#: Parts of a rule at most: they are bits of a long.
PARTS = 63
#: Smallest and largest size class, the logarithm of a width.
FINEST, COARSEST = -40, 1000


def built_in(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    rows = [(o, r, d, s, Decimal(str(w)), *c) for o, r, d, s, w, conditions in BUILT_IN for c in conditions]
    return spark.createDataFrame(rows, SCHEMA)


def _known(metrics: DataFrame, key: str) -> list:
    """(name, column, is it a text) of each column that is a metric: numbers and booleans as doubles, NaN as null."""
    found = []
    for field in metrics.schema:
        c, is_text = F.col(f"`{field.name}`"), isinstance(field.dataType, StringType)
        if field.name != key and isinstance(field.dataType, (NumericType, BooleanType, StringType)):
            found.append((field.name, c if is_text else F.nanvl(c.cast("double"), F.lit(None).cast("double")), is_text))
    return found


def long_form(metrics: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, metric, value, text): a row for each known metric; numbers and booleans are values, texts texts; NaN is unknown."""
    rows = []
    for name, c, is_text in _known(metrics, key):
        value, text = (F.lit(None).cast("double"), c) if is_text else (c, F.lit(None).cast("string"))
        rows.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), text.alias("text")))
    each = metrics.select(key, F.inline(F.array(*rows)))
    return each.where("value IS NOT NULL OR text IS NOT NULL")


def _class_of(width: str) -> str:
    return f"CASE WHEN {width} > 0 THEN least(greatest(CAST(ceil(log2({width})) AS int), {FINEST}), {COARSEST}) ELSE {FINEST} END"


def _bucket(value: str, size: str) -> str:
    return f"floor({value} / power(2D, {size}))"


def _sized(ranges: DataFrame) -> DataFrame:
    """Closed intervals with the size class of their width."""
    return ranges.where("closed AND low <= high").withColumn("size", F.expr(_class_of("(high - low)")))


def _bucketed(sized: DataFrame) -> DataFrame:
    """Intervals with the one or two buckets of their class that they meet."""
    ends = F.array_distinct(F.array(F.expr(_bucket("low", "size")), F.expr(_bucket("high", "size"))))
    return sized.withColumn("bucket", F.explode(ends))


def _placed(ranges: DataFrame) -> DataFrame:
    return _bucketed(_sized(ranges))


def _looked(values: DataFrame, placed: DataFrame, send) -> DataFrame:
    """Values with their one bucket of each size class that their metric's intervals have."""
    sizes = placed.groupBy("metric").agg(F.collect_set("size").alias("sizes"))  # COARSEST - FINEST at most a metric
    looked = values.where("value IS NOT NULL").join(send(sizes), "metric").withColumn("size", F.explode("sizes"))
    return looked.withColumn("bucket", F.expr(_bucket("value", "size")))


def _sender(conditions: DataFrame):
    return F.broadcast if conditions.count() <= FEW else (lambda df: df)


_CLOSED = "low IS NOT NULL AND high IS NOT NULL"
_INSIDE = "(low IS NULL OR value > low OR low_in AND value = low) AND (high IS NULL OR value < high OR high_in AND value = high)"
_HOLDS = f"CASE WHEN text IS NOT NULL THEN text = _text WHEN low IS NULL AND high IS NULL THEN true ELSE value IS NOT NULL AND {_INSIDE} END"


def matched(values: DataFrame, conditions: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, rule, part): conditions that hold. values: `long_form`; conditions: (rule, part, metric, low, low_in, high, high_in, text), staged."""
    send = _sender(conditions)
    ranges = conditions.where("text IS NULL").withColumn("closed", F.expr(_CLOSED))
    placed = _placed(ranges)
    columns = ["metric", "rule", "part", "low", "low_in", "high", "high_in"]
    closed = _looked(values, placed, send).join(send(placed.select(*columns, "size", "bucket")), ["metric", "size", "bucket"]).where(_INSIDE)
    open_ = values.where("value IS NOT NULL").join(send(ranges.where("NOT closed AND (low IS NOT NULL OR high IS NOT NULL)").select(columns)), "metric").where(_INSIDE)
    known = values.join(send(ranges.where("low IS NULL AND high IS NULL").select("metric", "rule", "part")), "metric")
    texts = values.join(send(conditions.where("text IS NOT NULL").select("metric", "text", "rule", "part")), ["metric", "text"])
    out = [x.select(key, "rule", "part") for x in (closed, open_, known, texts)]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def _met(values: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule, part, n): how many values `matched` would bring to each part's conditions, at least those that hold."""
    send = _sender(conditions)
    ranges = conditions.where("text IS NULL").withColumn("closed", F.expr(_CLOSED))
    n = F.count(F.lit(1)).alias("n")
    placed, place = _placed(ranges), ["metric", "size", "bucket"]
    held = _looked(values, placed, send).groupBy(place).agg(n)  # summed before it shuffles
    closed = placed.join(held, place)
    named = conditions.where("text IS NOT NULL")
    texts = named.join(values.where("text IS NOT NULL").groupBy("metric", "text").agg(n), ["metric", "text"])
    rest = ranges.where("NOT closed").join(F.broadcast(values.groupBy("metric").agg(n)), "metric")  # a row for each column of the metrics
    each = [x.select("rule", "part", "n") for x in (closed, texts, rest)]
    met = each[0].unionAll(each[1]).unionAll(each[2]).groupBy("rule", "part").agg(F.sum("n").alias("n"))
    return conditions.select("rule", "part").distinct().join(met, ["rule", "part"], "left").fillna(0, "n")


def _all_parts(values: DataFrame, conditions: DataFrame, key: str) -> DataFrame:
    """(key, rule, part) of rules with several parts: the part that meets the fewest values is matched first, and the others
    are looked up for the rows that it leaves, so a part that holds for most rows is never joined with all of them."""
    lead = _met(values, conditions).groupBy("rule").agg(F.min_by("part", F.struct("n", "part")).alias("lead"))
    led = staged(conditions.join(lead, "rule").withColumn("first", F.expr("part = lead")), "led-conditions")
    found = staged(matched(values, led.where("first"), key).distinct(), "led-rules")
    rest = led.where("NOT first").select("rule", "part", "metric", "low", "low_in", "high", "high_in", "text")
    asked = found.select(F.col(key).alias("_key"), "rule").join(_sender(rest)(rest), "rule").withColumnRenamed("metric", "_metric")
    own = values.withColumnRenamed("text", "_text")
    also = asked.join(own, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_metric") == F.col("metric"))).where(_HOLDS)
    return found.unionAll(also.select(key, "rule", "part"))


def _merged(sized: DataFrame) -> DataFrame:
    """Closed intervals, of each metric in fewer size classes: a class goes into the next one of at least half as many intervals, so
    intervals that a value is held against are at most three times those of the larger class alone, and values have fewer copies."""
    counts: dict = {}
    for r in sized.groupBy("_at", "size").count().collect():  # COARSEST - FINEST at most a metric
        counts.setdefault(r["_at"], {})[r["size"]] = r["count"]
    rows = []
    for at, sizes in counts.items():
        open_, held = [], 0
        for size in sorted(sizes):
            if held > 2 * sizes[size]:
                open_, held = [], 0
            for x in open_:
                x[2] = size
            open_.append([at, size, size])
            rows.append(open_[-1])
            held += sizes[size]
    into = sized.sparkSession.createDataFrame([tuple(r) for r in rows], "_at int, size int, _into int")
    return sized.join(F.broadcast(into), ["_at", "size"]).drop("size").withColumnRenamed("_into", "size")


def _leading(values: DataFrame, conditions: DataFrame, heads: DataFrame) -> DataFrame:
    """Conditions of rules with one condition a part and two parts at most, whose most selective part is a closed interval: that
    interval is `first`."""
    plain = conditions.join(heads.where("_plain").select("rule", "_several"), "rule").distinct()
    two = plain.where("_several").drop("_several")
    lead = _met(values, two).groupBy("rule").agg(F.min_by("part", F.struct("n", "part")).alias("lead"))
    led = plain.join(lead, "rule", "left").withColumn("first", F.expr("lead IS NULL OR part = lead"))
    led = staged(led, "plain-conditions")
    return led.join(led.where(f"first AND text IS NULL AND {_CLOSED}").select("rule"), "rule", "left_semi")


def _chosen(on: str, fields: list[int], kind: str):
    """The metric of a row that the column `on` numbers, among some of its fields."""
    found = F.lit(None).cast(kind)
    for i in fields:
        found = F.when(F.col(on) == i, F.col(f"_m{i}")).otherwise(found)
    return found


_ALSO = f"_also IS NULL OR CASE WHEN _text IS NOT NULL THEN _said = _text WHEN _low IS NULL AND _high IS NULL THEN _value IS NOT NULL OR _said IS NOT NULL ELSE {re.sub(r'(low|high|value)', r'_\1', _INSIDE)} END"


def _direct(metrics: DataFrame, led: DataFrame, heads: DataFrame, key: str, few: bool) -> DataFrame:
    """(key, ord, rule, data_type, side, weight) that hold, of `_leading` rules and metrics of one row a key: pairs are not shuffled."""
    known = _known(metrics, key)
    numbers, texts = ([i for i, x in enumerate(known) if x[2] == kind] for kind in (False, True))
    number = F.lit(None).cast("int")
    for i, (name, _, _) in enumerate(known):
        number = F.when(F.col("metric") == name, i).otherwise(number)
    led, ends = led.withColumn("_at", number).where("_at IS NOT NULL"), ["low", "low_in", "high", "high_in"]  # others never hold
    other = led.where("NOT first").select("rule", F.col("_at").alias("_also"), *[F.col(c).alias(f"_{c}") for c in (*ends, "text")])
    first = led.where("first").select("rule", "_several", "_at", *ends, F.lit(True).alias("closed"))
    whole = first.join(other, "rule", "left").where("NOT _several OR _also IS NOT NULL").drop("_several", "closed")
    whole = whole.join(heads.select("rule", "ord", "data_type", "side", "weight"), "rule").withColumn("closed", F.lit(True))
    sized = staged(_merged(_sized(whole)).drop("closed"), "sized-rules")
    sizes = sized.groupBy("_at").agg(F.collect_set("size").alias("_sizes"))  # a row a metric
    row = metrics.select(key, *[c.alias(f"_m{i}") for i, (_, c, _) in enumerate(known)])
    asked = row.withColumn("_at", F.explode(F.array(*map(F.lit, numbers)).cast("array<int>"))).join(F.broadcast(sizes), "_at")
    asked = asked.withColumn("value", _chosen("_at", numbers, "double")).where("value IS NOT NULL").withColumn("size", F.explode("_sizes"))
    asked = asked.withColumn("bucket", F.expr(_bucket("value", "size"))).drop("value", "_sizes")
    placed = _bucketed(sized)  # merged where it is not broadcast, so that a bucket's pairs are made where its values went
    met = asked.join(F.broadcast(placed) if few else placed.hint("merge"), ["_at", "size", "bucket"])
    met = met.withColumns({"value": _chosen("_at", numbers, "double"), "_value": _chosen("_also", numbers, "double"), "_said": _chosen("_also", texts, "string")})
    return met.where(_INSIDE).where(_ALSO).select(key, "ord", "rule", "data_type", "side", "weight")


def fired(metrics: DataFrame, rules: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, ord, rule, data_type, side, weight) of rules that hold for each row of metrics (key and a column a metric).

    rules: rows of SCHEMA. An interval without ends holds for any known value or text of its metric; one whose low end is
    above its high end never holds. A null metric fires nothing; rows with a null rule, part or metric are left out.
    Rules named alike are one rule, of the smallest of their other columns; parts are 0 to 62, others never hold."""
    usable = rules.where("rule IS NOT NULL AND part IS NOT NULL AND metric IS NOT NULL")
    conditions = staged(usable, "rule-conditions")
    bit = "shiftleft(1L, part)"
    inside = f"part BETWEEN 0 AND {PARTS - 1}"
    plain = "count(DISTINCT struct(part, metric, low, low_in, high, high_in, text)) = count(DISTINCT part) AND count(DISTINCT part) <= 2"
    heads = conditions.groupBy("rule").agg(
        F.expr(f"CASE WHEN bool_and({inside}) THEN bit_or({bit}) END").alias("_all"), F.expr("min(part) < max(part)").alias("_several"),
        F.expr(plain).alias("_plain"), *[F.min(c).alias(c) for c in ("ord", "data_type", "side", "weight")],
    )
    heads = staged(heads.where("_all IS NOT NULL"), "rule-heads")
    few = conditions.count() <= FEW
    send = F.broadcast if few else (lambda df: df)
    of = conditions.select("rule", "part", "metric", "low", "low_in", "high", "high_in", "text")
    values, head = long_form(metrics, key), [key, "ord", "rule", "data_type", "side", "weight"]
    direct = None
    if metrics.groupBy(key).count().where("count > 1").isEmpty():
        led = staged(_leading(values, of, heads), "leading-conditions")
        if not led.isEmpty():
            direct = _direct(metrics, led, heads, key, few)
            heads = staged(heads.join(send(led.select("rule").distinct()), "rule", "left_anti"), "other-heads")
            if heads.isEmpty():
                return direct
    several = heads.where("_several").select("rule")
    met = matched(values, of.join(send(heads.where("NOT _several").select("rule")), "rule", "left_semi"), key)
    if not several.isEmpty():
        met = met.unionAll(_all_parts(values, of.join(send(several), "rule", "left_semi"), key))
    held = met.groupBy(key, "rule").agg(F.expr(f"bit_or({bit})").alias("_held"))
    grouped = held.join(send(heads), "rule").where("_held = _all").select(head)
    return grouped if direct is None else direct.unionAll(grouped)
