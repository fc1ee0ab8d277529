"""The walk over landed pages of candles: gaps, repeats, short and broken pages, too few candles."""

import json
from pathlib import Path

import pytest

from tidemark.sources import klines

DAY = 86_400_000


def page(*opens, close=1.0):
    return [[str(o), "1.0", "2.0", "0.5", str(close), "9"] for o in opens]


def walked(pages, limit=3, last=100, repeats="first"):
    read = []

    def get(end):
        read.append(end)
        return pages[end]

    rows = klines.walk(list(pages), get, limit, last, repeats)
    return [r[0] for r in rows], read, {r[0]: r[4] for r in rows}


def test_goes_back_page_by_page_to_a_short_one():
    pages = {9: page(7, 8, 9), 6: page(4, 5, 6), 3: page(2, 3), 1: page(0, 1)}
    assert walked(pages)[:2] == ([2, 3, 4, 5, 6, 7, 8, 9], [9, 6, 3])


def test_stops_at_an_empty_page_and_once_there_are_enough():
    pages = {9: page(7, 8, 9), 6: [], 3: page(1, 2, 3)}
    assert walked(pages)[0] == [7, 8, 9]
    pages = {9: page(7, 8, 9), 6: page(4, 5, 6), 3: page(1, 2, 3)}
    assert walked(pages, last=4)[:2] == ([6, 7, 8, 9], [9, 6])


def test_a_gap_is_passed_over_and_pages_within_one_that_was_read_are_not_read():
    pages = {20: page(17, 18, 19), 18: page(1, 2, 3), 10: page(8, 9, 10), 5: page(5)}
    assert walked(pages)[:2] == ([5, 8, 9, 10, 17, 18, 19], [20, 10, 5])


def test_repeats():
    pages = {9: page(7, 7, 8, close=1), 6: page(5, 6, 7, close=2)}
    assert walked(pages)[2][7] == 1 and walked(pages, repeats="last")[2][7] == 2
    assert walked(pages)[0] == [5, 6, 7, 8]


def test_what_is_no_candle_is_left_out():
    assert [r[0] for r in klines.candles([["x"], [], None, {"a": 1}, ["5", "bad"], [6, 1, 2, 3, 4, 5]])] == [5, 6]
    assert klines.candles([["5", "bad"]])[0][1:] == (None,) * 5


def lay(root: Path, symbol: str, end: int, rows):
    folder = root / f"symbol={symbol}" / f"end={end}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text(rows if isinstance(rows, str) else json.dumps(rows))


def test_read_by_spark(spark, tmp_path):
    for symbol in ("A", "B%2FC"):
        lay(tmp_path, symbol, 9 * DAY, page(*[k * DAY for k in range(5, 10)]))
        lay(tmp_path, symbol, 5 * DAY - 1, page(*[k * DAY for k in range(5)]))
    rows = klines.bulk_klines(spark, str(tmp_path), limit=5, last=7, least=7).collect()
    assert sorted((r.symbol, r.open_time_ms // DAY) for r in rows) == [(s, k) for s in ("A", "B/C") for k in range(3, 10)]
    lay(tmp_path, "D", 3, "not json")
    with pytest.raises(Exception, match="D: 0 candles, 7 are needed"):
        klines.bulk_klines(spark, str(tmp_path), limit=5, last=7, least=7).collect()


def test_pages_that_were_landed_give_their_bars_back(spark, tmp_path):
    bars = spark.range(2500).selectExpr("'A' AS symbol", f"id * {DAY} AS open_time_ms", "id + 0.5D AS open", "1D AS high", "2D AS low", "id + 0.25D AS close", "3D AS volume")
    klines.land_pages(bars, str(tmp_path / "pages"))
    rows = klines.bulk_klines(spark, str(tmp_path / "pages")).orderBy("open_time_ms").collect()
    assert [r.open_time_ms // DAY for r in rows] == list(range(2500 - 1826, 2500)) and rows[0].close == 674.25
