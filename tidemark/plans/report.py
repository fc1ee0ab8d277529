"""Markdown reports as columns, one text per symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed

#: A report's sections in their order.
SECTIONS = [
    "Question", "Stance", "Market Judgment", "Long-horizon Context", "Facts", "Inferences", "Conclusion", "Critic Review", "Confidence",
    "Indicators", "Counter Evidence", "Evidence Sources", "Next Observations", "Risks and Limitations",
]
#: Sections of a narrative under the titles they have in a report.
TITLES = {
    "judgment": ["Market Judgment", "Conclusion"], "facts": ["Facts"], "inferences": ["Inferences"],
    "counter_evidence": ["Counter Evidence"], "observations": ["Next Observations"],
}


def lines(rows: DataFrame, section: str, line: Column, ord: Column | None = None) -> DataFrame:
    """Rows as lines (symbol, title, ord, line) of a section."""
    place = F.lit(0) if ord is None else ord
    return rows.select("symbol", F.lit(section).alias("title"), place.cast("int").alias("ord"), line.alias("line"))


def of_narrative(rows: DataFrame) -> DataFrame:
    titles = reduce(lambda c, t: c.when(F.col("section") == t, F.array(*map(F.lit, TITLES[t]))), list(TITLES)[1:],
                    F.when(F.col("section") == "judgment", F.array(*map(F.lit, TITLES["judgment"]))))
    return rows.select("symbol", F.explode(titles).alias("title"), "ord", "line")


def stance_lines(stances: DataFrame) -> DataFrame:
    line = F.concat("stance", F.lit(" ("), fixed("net_margin_pct", 1), F.lit(" %), bull "), fixed("bull_weight", 2), F.lit(", bear "), fixed("bear_weight", 2))
    return lines(stances, "Stance", line)


def window_lines(windows: DataFrame) -> DataFrame:
    line = F.concat("label", F.lit(": "), fixed("return_pct", 2), F.lit(" %, drawdown "), fixed("max_drawdown_pct", 2), F.lit(" %"))
    return lines(windows, "Long-horizon Context", line)


def report_markdown(parts: list[DataFrame]) -> DataFrame:
    """(symbol, report) of lines (symbol, title, ord, line): the sections that have lines, in their fixed order.

    Lines come by ord, then by their text; a null line is left out. A symbol's lines are tens, whatever the input."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("title"))
    rows = reduce(DataFrame.unionByName, parts).where("line is not null")
    one = rows.groupBy("symbol", "title").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("t"))
    text = F.concat(F.lit("## "), "title", F.lit("\n"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    whole = one.select("symbol", F.struct(place.alias("no"), text.alias("text")).alias("s")).groupBy("symbol").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select("symbol", F.concat(F.lit("# "), "symbol", F.lit("\n"), F.array_join(F.col("s.text"), "\n")).alias("report"))
