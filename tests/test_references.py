"""Character references against the standard library, and the time that a text with very many of them takes."""

import html
import random
import time

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans import catalogue, oracle


def test_as_the_standard_library_has_them(spark):
    rng = random.Random(11)
    parts = ["&", "amp", "lt", ";", "#", "x", "X", "41", "0", "128", "8217", "x80", "xD800", "99999999999999999999", "xFFFFFFFFFFFFFFFFFFFFFF", "copy", "nbsp", "notin", "not", "hearts", " ", "a", "Z9", "&amp;", "&#39;", "é", "&#11;", "&#xfdd0;", "&#1;", "&#65534;", "&NotEqualTilde;", "&acE;", "&ampfoo;", "&copy2024", "&#129;", "&#x1F600;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + [None, "", "&", "&;", "&#;", "&#x;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape(F.col("t")).alias("u")).collect()
    wrong = [(r.t, r.u, html.unescape(r.t)) for r in rows if r.t is not None and r.u != html.unescape(r.t)]
    assert not wrong, wrong[:5]


def test_twenty_thousand_references_in_one_text(spark):
    def seconds(n):
        df = spark.createDataFrame([("&amp; &#8217; &hearts; &ampno " * (n // 4),)], "t string")
        began = time.perf_counter()
        assert df.select(F.length(text.unescape(F.col("t")))).first()[0] == len(html.unescape("&amp; &#8217; &hearts; &ampno " * (n // 4)))
        return time.perf_counter() - began

    seconds(100)  # compiles
    assert seconds(20_000) < 4 and seconds(80_000) < 12


def test_queries_of_pages_decode_what_their_sql_does(spark, tmp_path):
    sentence, tail = "Some words of prose that go on and on here. ", "and &amp; so &amp, &quot &eacute; &#233; &am\u00a0&nbsp;\u3000x&amp;lt; y&#39;s 。z\x0b\u2028 "
    pages = [f"<p>{tail}</p>", f"<p>{sentence * 9}{tail}</p>", f"<p>{'words 。' * 50}{tail}</p>", f"<div><p>{sentence * 2}{tail}<b> </p>{tail}", f"<p>{'&amp ' * 200}</p>", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("strip_truncate", "article_text"):
        got = {tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(con.sql(oracle.ORACLE_SQL[name]).fetchall()), name
