"""Footnotes against one alternation of the ids, longest first; mentions against the substring definition."""

import random
import re

import pytest

from tidemark.operators import citing


def by_alternation(ids, numbers, text):
    """What the citing rule comes to for one small set, by a regular expression of all its ids."""
    text = text.strip()
    if not ids:
        return text
    either = "|".join(re.escape(i) for i in sorted(ids, key=len, reverse=True))
    lead = re.match(rf"\[?({either})\]?\s*[:：]\s*", text)
    body = re.sub(rf"\[?({either})\]?", lambda m: f"[^{numbers[m[1]]}]", text[lead.end() :] if lead else text)
    return body + (f"[^{numbers[lead[1]]}]" if lead else "")


IDS = ["EV-1", "EV-12", "EV-123", "EV", "A:", "A", "x]y", "é"]
TEXTS = [
    "EV-12: first", "[EV-123] ： first", "  [EV-1]:x EV-12 ", "EV-12", "[EV-12", "EV-12]", "[[EV-12]]", "EV-1234", "EV-1 : ", "A: b", "A:: b", "A:", "[A]:[A:]", "", " : ",
    "no id", "x]y]: z", "see EV-1,EV-12;EV-123.", "éé", "[é]\t:\n q", "EVEV-1EV-12", "[nothing]: EV-1", "\u3000EV\u3000:\u3000a",
]


@pytest.mark.parametrize("ids", [IDS, IDS[:1], [], ["["], ["[EV", "EV"]])
def test_one_text(ids):
    numbers, trie = {i: k for k, i in enumerate(ids, 1)}, citing.trie_of(ids)
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["EV", "-1", "2", "3", "[", "]", ":", " ", "A", "x]y", "é", "："]) for _ in range(12)) for _ in range(500)]
    for text in TEXTS + mixed:
        if ids in (IDS, IDS[:1], []):
            assert citing.linked(trie, numbers, text, "[^{}]") == by_alternation(ids, numbers, text), text
    assert citing.linked(trie, numbers, "[EV [", "<{}>")


@pytest.mark.parametrize("at_once", [20_000, 3])
def test_linkify_of_several_sets(spark, monkeypatch, at_once):
    monkeypatch.setattr(citing, "AT_ONCE", at_once)
    texts = [(k, "A" if k % 3 else None, t, 0, "deal") for k, t in enumerate([*TEXTS, None, "EV-12"] * 2)] + [(900, "C", " EV-1 ", 0, "x")]
    docs = spark.createDataFrame(texts, "n int, report string, line string, number int, _deal string")
    records = [("A", i, k) for k, i in enumerate(IDS, 1)] + [("A", "EV", 99), ("A", None, 1), ("A", "", 2), (None, "EV-12", 7), ("B", "EV", 1)]
    found = citing.linkify(docs, spark.createDataFrame(records, "report string, evidence_id string, number int"), "report", "line")
    assert found.columns == [*docs.columns, "linked"]
    own = {"A": {i: k for k, i in enumerate(IDS, 1)}, None: {"EV-12": 7}, "C": {}}
    want = sorted((n, by_alternation(list(own[r]), own[r], t or "")) for n, r, t, _, _ in texts)
    assert sorted((r.n, r.linked) for r in found.collect()) == want
    assert citing.linkify(docs.limit(0), found.limit(0).selectExpr("report", "line AS evidence_id", "n AS number"), "report", "line").count() == 0


def pairs(texts, aliases):
    low = {a.lower() for a in aliases if a}
    return {(k, a) for k, t in texts if t is not None for a in low if a in t.lower()}


@pytest.mark.parametrize("few", [200_000, 0])
def test_mentions_equal_the_definition(spark, monkeypatch, few):
    monkeypatch.setattr(citing, "FEW", few)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abAB éz") for _ in range(n))
    texts = [(k, word(rng.choice([0, 1, 2, 3, 60, 64, 65, 400]))) for k in range(60)] + [(100, None), (101, "x" * 300_000 + "needle in a stack" + "x" * 300_000), (7, "again ab"), (7, "again ab")]
    aliases = [word(rng.choice([1, 2, 3, 4, 6])) for _ in range(80)] + [None, "", "NEEDLE in a", "xneedle", "a" * 90, texts[10][1], texts[11][1][:70]]
    found = citing.alias_mentions(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(a,) for a in aliases], "alias string"), "k", "t")
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == pairs(texts, aliases)


def test_no_aliases_and_no_texts(spark):
    texts, aliases = spark.createDataFrame([(1, "a")], "k int, t string"), spark.createDataFrame([("a",)], "alias string")
    assert citing.alias_mentions(texts, aliases.where("alias = ''"), "k", "t").count() == 0
    assert citing.alias_mentions(texts.limit(0), aliases, "k", "t").count() == 0


def test_a_hundred_thousand_aliases(spark):
    rng = random.Random(8)
    aliases = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([5, 7, 9]))) for _ in range(100_000)})
    texts = [(k, " ".join(rng.choice(aliases) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40))) for k in range(300)]
    found = citing.alias_mentions(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(a,) for a in aliases], "alias string"), "k", "t")
    known, want = set(aliases), set()
    for k, t in texts:  # every substring of an alias's length
        want |= {(k, t[i : i + n]) for n in (5, 7, 9) for i in range(len(t)) if t[i : i + n] in known}
    assert {tuple(r) for r in found.collect()} == want


def test_texts_are_looked_through_and_not_exploded_into_grams(spark, monkeypatch):
    monkeypatch.setattr(citing, "AT_A_TIME", 50)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcé𝒳 ") for _ in range(n))
    texts = [(k, word(rng.choice([0, 5, 49, 50, 51, 300]))) for k in range(60)]
    aliases = [word(rng.choice([1, 2, 3, 4, 5, 8, 12, 30])) for _ in range(60)] + [texts[-1][1][3:40]]
    found = citing.alias_mentions(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(a,) for a in aliases], "alias string"), "k", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert {tuple(r) for r in found.collect()} == pairs(texts, aliases)
