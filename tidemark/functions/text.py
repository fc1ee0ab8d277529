"""Text expressions: tags, feeds, articles, mentions, lexicons and citations, all inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no part of an article.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form")


#: Names that are references without a semicolon too, the longest first.
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_REFERENCE = f"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{'|'.join(_BARE)}))"
#: Numbers 128 to 159 are read as that Windows code page, as browsers do.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
#: Names that most references have; only others are looked up in the whole table.
_USUAL = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "hellip", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "reg", "trade", "bull")


def _numbered(name: Column) -> Column:
    """The character of a numeric reference: U+FFFD for no character, nothing for a control character or non-character."""
    hexed = F.when(F.length(name) <= 18, F.conv(F.substr(name, F.lit(3)), 16, 10))
    number = F.coalesce(F.when(F.lower(name).startswith("#x"), hexed).otherwise(F.substr(name, F.lit(2))).try_cast("bigint"), F.lit(0x110000))
    windows = F.element_at(F.array(*map(F.lit, _WINDOWS.values())), F.greatest(F.least(number - 127, F.lit(32)), F.lit(1)).cast("int"))
    control = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(none, "\ufffd").when(number.between(128, 159), windows).when(control, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _named(whole: Column) -> Column:
    """The characters of a named reference (`name;` or a bare name); of an unknown one those of the longest bare name that it
    begins with, and the rest; else null."""
    usual = F.lit(None).cast("string")
    for known in _USUAL:
        usual = F.when(whole == f"{known};", html5[f"{known};"]).otherwise(usual)
    table = F.from_json(F.lit(json.dumps(dict(sorted(html5.items())))), "map<string, string>")
    start = F.regexp_extract(whole, f"^(?:{'|'.join(_BARE)})", 0)
    prefix = F.when(start != "", F.concat(F.try_element_at(table, start), F.substr(whole, F.length(start) + 1)))
    return F.coalesce(usual, F.try_element_at(table, whole), prefix)


def _decoded(whole: Column) -> Column:
    """Characters of a reference without its &, as it stands if it is not known."""
    named = F.coalesce(_named(whole), F.concat(F.lit("&"), whole))
    return F.when(whole.startswith("#"), _numbered(F.rtrim(whole, F.lit(";")))).otherwise(named)


def unescape(text: Column) -> Column:
    """Numeric and named references to characters, as the standard library's table has them, some without their semicolon; unknown
    ones stay. A text is cut at its references once and each is decoded once, so the work follows the text's length."""
    between = F.split(text, _REFERENCE, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), _decoded)
    whole = F.array_join(F.zip_with(between, F.array_append(chars, F.lit("")), lambda b, c: F.concat(b, c)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: References that the catalogue's queries of pages decode, in this order, as their SQL does.
LISTED = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&amp;": "&",
}


def _untagged(html: Column, listed: bool) -> Column:
    """Text without tags in single spaces, with all references decoded, or only the LISTED ones and ASCII white space alone."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    if not listed:
        return squash(unescape(text))
    for reference, char in LISTED.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def strip_html(raw: str | Column, most: int = 420, listed: bool = False) -> Column:
    """Text without tags and entities in single spaces; longer ones end at a sentence in their second half, and in an ellipsis.

    `listed` goes by the SQL of the catalogue: LISTED references alone, and every sentence ends before a space."""
    c = F.col(raw) if isinstance(raw, str) else raw
    text = _untagged(F.coalesce(c, F.lit("")), listed)
    cut = F.substring(text, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*[。.!?])(?= )" if listed else r"(?s)^(.*(?:。|[.!?](?= )))", 1)
    kept = F.when(F.length(whole) > most * 0.5 + 1, whole).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(kept), F.lit("…")))


def article_text(html: str, least: int = 80, share: float = 0.2, most: int = 4000, listed: bool = False) -> Column:
    """Paragraphs of a page's body: long enough, not mostly tickers and percentages; in lines, cut at `most`. `listed`: as in `strip_html`."""
    tags = "|".join(DROPPED)
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), rf"(?is)<({tags})[^>]*>.*?</\1>", " ")
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    plain = F.transform(blocks, lambda b: _untagged(b, listed))
    odd = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w.startswith("$") | w.endswith("%")))
    kept = F.filter(plain, lambda t: (F.length(t) >= least) & (odd(t) <= share * F.size(F.split(t, " "))))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def mentions(text: str, aliases: list[str]) -> Column:
    """Whether any alias is in the text, in any case and within longer words too."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = F.lit(False)
    for a in aliases:
        out = out | F.contains(low, F.lit(a.lower()))
    return out


def words_of(text: str) -> Column:
    """Distinct lower-case words of a text without marks at their ends."""
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+")
    return F.array_distinct(F.transform(split, lambda w: F.btrim(w, F.lit('.,!?():[]"'))))


def lexicon_sentiment(posts: DataFrame, key: list[str], text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """(key, posts, positive_terms, negative_terms, sentiment): hits of distinct lexicon words, summed over posts."""
    found = lambda words: F.size(F.array_intersect(words_of(text), F.array(*map(F.lit, words))))
    rows = posts.select(*key, found(positive).alias("p"), found(negative).alias("n"))
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("posts"), F.sum("p").alias("positive_terms"), F.sum("n").alias("negative_terms")
    )
    mood = F.when(F.col("positive_terms") > F.col("negative_terms"), "positive")
    return out.withColumn("sentiment", mood.when(F.col("negative_terms") > F.col("positive_terms"), "negative").otherwise("mixed"))


def matched_words(posts: DataFrame, key: list[str], text: str, words: list[str]) -> DataFrame:
    """(key, matched): sorted distinct lexicon words over all posts of a key."""
    hits = F.array_intersect(words_of(text), F.array(*map(F.lit, words)))
    one = posts.select(*key, F.explode_outer(hits).alias("w")).groupBy(*key)
    return one.agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("matched"))


_ITEM = "array<struct<title: string, link: string, pubDate: string, description: string>>"
_ENTRY = "array<struct<title: string, link: array<struct<_href: string>>, updated: string, published: string, summary: string, content: string>>"


def feed_entries(feeds: DataFrame, xml: str, limit: int = 25, most: int = 420) -> DataFrame:
    """Rows of (other columns, n, title, url, published, summary) of the first `limit` entries of RSS or Atom documents.

    Fields are read within each item; one that an item lacks is empty. RSS wins if there is an item. Null
    documents and such as are no XML have no rows."""
    rest = [c for c in feeds.columns if c != xml]
    schema = f"channel array<struct<item: {_ITEM}>>, item {_ITEM}, entry {_ENTRY}"
    parsed = feeds.select(*rest, F.from_xml(xml, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("f"))
    items = F.concat(F.coalesce("f.item", F.array()), F.coalesce(F.flatten("f.channel.item"), F.array()))
    value = lambda *c: F.trim(F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit("")))

    def entry(title: Column, url: Column, published: Column, summary: Column) -> Column:
        return F.struct(title.alias("title"), url.alias("url"), published.alias("published"), summary.alias("summary"))

    rss = F.transform(items, lambda i: entry(value(i["title"]), value(i["link"]), value(i["pubDate"]), value(i["description"])))
    atom = F.transform("f.entry", lambda e: entry(
        value(e["title"]), value(F.get(e["link"], F.lit(0))["_href"]), value(e["updated"], e["published"]), value(e["summary"], e["content"])))
    found = F.slice(F.when(F.size(rss) > 0, rss).otherwise(atom), 1, limit)
    rows = parsed.select(*rest, F.posexplode(found).alias("n", "e"))
    return rows.select(*rest, "n", "e.title", "e.url", "e.published", strip_html(F.col("e.summary"), most).alias("summary"))


def citations(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, ref, times): what matches the pattern in each text, and how often."""
    refs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
    return df.select(key, F.explode(refs).alias("ref")).groupBy(key, "ref").agg(F.count(F.lit(1)).alias("times"))


#: Marks that end a clause; 24 and 12 below are the shortest block and the longest orphan.
_ENDS = "。！？；!?;"


def sentence_blocks(text: str, least: int = 24, orphan: int = 12) -> Column:
    """Clauses of a text gathered into blocks of `least` characters or more; a last one below `orphan` joins the one before.

    A null or blank text is one block as it is."""
    whole = F.coalesce(F.col(text), F.lit(""))
    pieces = F.regexp_extract_all(whole, F.lit(f"[^{_ENDS}]+[{_ENDS}]*"), F.lit(0))
    clauses = F.filter(F.transform(pieces, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def take(held: Column, clause: Column) -> Column:
        now = F.concat(held["open"], clause)
        full = F.length(now) >= least
        done = F.when(full, F.array_append(held["done"], now)).otherwise(held["done"])
        return F.struct(done.alias("done"), F.when(full, F.lit("")).otherwise(now).alias("open"))

    def close(held: Column) -> Column:
        done, rest = held["done"], held["open"]
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), rest)))
        return F.when(rest == "", done).when((F.size(done) > 0) & (F.length(rest) < orphan), joined).otherwise(F.array_append(done, rest))

    blocks = F.aggregate(clauses, start, take, close)
    return F.when(F.size(clauses) == 0, F.array(whole)).otherwise(blocks)


def fuller(a: str, b: str) -> Column:
    """The longer of two texts if one holds the other but for white space (b if as long), null if they differ."""
    x, y = (F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", "") for c in (a, b))
    p, q = F.trim(F.coalesce(F.col(a), F.lit(""))), F.trim(F.coalesce(F.col(b), F.lit("")))
    return F.when(F.contains(x, y) | F.contains(y, x), F.when(F.length(p) > F.length(q), p).otherwise(q))


def to_minutes(stamp: str) -> Column:
    """An ISO timestamp up to its minutes, with a space for the T."""
    return F.replace(F.substring(F.col(stamp), 1, 16), F.lit("T"), F.lit(" "))
