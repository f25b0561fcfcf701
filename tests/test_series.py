"""Hand-made series: warm-up, flat prices, gaps, repeated keys, books."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chart
from tidemark.operators import indicators as ind
from tidemark.operators import relational as R
from tidemark.operators import strategy as T
from tidemark.operators.recursive import affine_indicators, supertrend
from tidemark.operators.strategy import exits
from tidemark.streaming.ingest import apply_delta

SCHEMA = "instrument string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, gap=1):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("x", "1d", t + dt.timedelta(days=i * gap), c, c, c, c, 1.0) for i, c in enumerate(closes)], SCHEMA)


@pytest.mark.parametrize(("closes", "want"), [([5.0] * 16, None), ([float(i) for i in range(1, 17)], 100.0), ([float(30 - i) for i in range(16)], 0.0)])
def test_rsi_of_flat_rising_and_falling(spark, closes, want):
    last = ind.rolling_indicators(bars(spark, closes)).orderBy(F.desc("ts")).first()
    assert last["rsi14"] == want
    if want is None:
        assert last["k14"] is None and last["williams14"] is None


@pytest.mark.parametrize("n", [0, 1, 8, 9, 10])
def test_warm_up_of_the_mean(spark, n):
    got = ind.rolling_indicators(bars(spark, [1.0] * n)).filter("sma9 is not null").count()
    assert got == max(0, n - 8)


def test_displacement_uses_the_first_gap(spark):
    rows = bars(spark, [1.0, 2.0, 3.0, 4.0], gap=2)
    got = {r["ts"]: r["value"] for r in ind.displaced_averages(rows).filter("metric = 'DMA_3x3'").collect()}
    assert got == {dt.datetime(2024, 1, 11): 2.0, dt.datetime(2024, 1, 13): 3.0}
    assert ind.displaced_averages(bars(spark, [1.0])).isEmpty()


def test_recurrences_match_their_definition(spark):
    closes = [float(10 + (i * 7) % 5) for i in range(40)]
    got = affine_indicators(bars(spark, closes)).orderBy("ts").toPandas()
    y = [closes[0]]
    for x in closes[1:]:
        y.append(y[-1] + 0.2 * (x - y[-1]))
    assert got["ema9"].tolist() == pytest.approx(y)
    assert got["kama10"].isna().sum() == 10 and (got["macd_hist"] - (got["macd"] - got["macd_signal"])).abs().max() == 0
    assert affine_indicators(bars(spark, [])).isEmpty() and supertrend(bars(spark, [])).isEmpty()


@pytest.mark.parametrize("chunk", [1, 7, 30])
def test_recurrences_do_not_depend_on_chunks(spark, chunk):
    """Series of several timeframes, cut into chunks, give what each gives in one piece."""
    rng = np.random.default_rng(chunk)
    rows, t = [], dt.datetime(2024, 1, 1)
    for name, timeframe, n in (("x", "1d", 90), ("x", "1w", 40), ("y", "1d", 11), ("z", "1d", 1)):
        close = 100 + np.cumsum(rng.normal(0, 3, n))
        rows += [(name, timeframe, t + dt.timedelta(days=int(i * (7 if timeframe == "1w" else 1) + (i > 50) * 200)), c, c + 2, c - 1.5, c, 1.0) for i, c in enumerate(close.tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    for f in (affine_indicators, supertrend):
        one, cut = (f(df, chunk=k).orderBy("instrument", "timeframe", "ts").toPandas() for k in (10_000, chunk))
        assert len(one) == len(rows)
        pd.testing.assert_frame_equal(one, cut, rtol=1e-9)
    alone = affine_indicators(df.filter("instrument = 'x' and timeframe = '1w'")).orderBy("ts").toPandas()
    both = affine_indicators(df).filter("instrument = 'x' and timeframe = '1w'").orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(alone, both)
    plain = pd.Series([r[6] for r in rows if r[:2] == ("x", "1w")])
    assert both["ema9"].tolist() == pytest.approx(plain.ewm(span=9, adjust=False).mean().tolist())
    macd = plain.ewm(span=12, adjust=False).mean() - plain.ewm(span=26, adjust=False).mean()
    assert both["macd_signal"].tolist() == pytest.approx(macd.ewm(span=9, adjust=False).mean().tolist())


def test_timeframes_are_not_mixed(spark):
    """Windows over a table of two timeframes are those of each alone."""
    t = dt.datetime(2024, 1, 1)
    rows = [("x", f, t + dt.timedelta(days=i * k), *[float(i * k)] * 4, 1.0) for f, k in (("1d", 1), ("1w", 7)) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for f, k in (("1d", 1), ("1w", 7)):
        got = ind.rolling_indicators(df).filter(F.col("timeframe") == f).orderBy("ts").toPandas()
        assert got["sma9"].dropna().tolist() == [float(k * (i + 4)) for i in range(22)]
        shown = {(r.metric, r.ts): r.value for r in ind.displaced_averages(df).filter(F.col("timeframe") == f).collect()}
        assert shown["DMA_3x3", t + dt.timedelta(days=5 * k)] == float(k) and len(shown) == 28 + 24 + 6
    assert {(r.timeframe, r["count"]) for r in ind.last_rows(df, 5).groupBy("timeframe").count().collect()} == {("1d", 5), ("1w", 5)}


def test_exits_inside_a_trade(spark):
    t = dt.datetime(2024, 1, 1)
    bar = lambda i, low, high, c: ("x", "1d", t + dt.timedelta(days=i), c, float(high), float(low), c, 1.0)
    df = spark.createDataFrame([bar(0, 100, 100, 100.0), bar(1, 99.5, 103, 100.0), bar(2, 90, 101, 95.0), bar(3, 95, 95, 95.0), bar(4, 90, 99, 95.0), bar(5, 95, 95.5, 95.0), bar(6, 95, 95, 95.0)], SCHEMA)
    crosses = spark.createDataFrame([("x", "1d", t + dt.timedelta(days=d), p, s) for d, p, s in ((0, 100.0, 1), (3, 95.0, -1), (5, 95.0, 1), (6, 95.0, -1))], "instrument string, timeframe string, ts timestamp_ntz, close double, side int")
    got = {(r.ts - t).days: ((r.exit_ts - t).days, r.exit_kind) for r in exits(df, crosses).collect()}
    assert got == {0: (1, "target"), 3: (4, "stop"), 5: (6, "signal")}
    assert {(r.ts - t).days: r.exit_kind for r in exits(df, crosses, stop=None).collect()} == {0: "target", 3: "target", 5: "signal"}


def test_insert_is_idempotent_and_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([("a", 1.0)], "k string, v double")
    new = spark.createDataFrame([("a", 2.0, 1), ("b", 3.0, 1), ("b", 4.0, 2), (None, 5.0, 1)], "k string, v double, n int")
    once = R.insert_absent(new, old, ["k"], [F.col("n")])
    assert {(r.k, r.v) for r in once.collect()} == {("a", 1.0), ("b", 3.0), (None, 5.0)}
    again = R.upsert_latest(new, R.upsert_latest(new, old, ["k"], F.col("n")), ["k"], F.col("n"))
    assert {(r.k, r.v) for r in again.collect()} == {("a", 2.0), ("b", 4.0), (None, 5.0)}


def test_levels_round_half_to_even(spark):
    rows = spark.createDataFrame([(25.0, 1.0), (35.0, 2.0)], "p double, q double")
    assert {r.level: r.amount for r in R.book_levels(rows, "p", "q", 10.0).collect()} == {20.0: 1.0, 40.0: 2.0}


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 9.0), ("a", 5, 7.0)], "k string, t int, v double")
    assert {(r.k, r.t): r.v for r in R.as_of(left, right, ["k"], "t", "v").collect()} == {("a", 1): None, ("a", 5): 7.0, ("b", 5): None}


def test_book_gap_and_removal():
    class State:
        exists, get = False, None

        def update(self, value):
            self.value = value

    rows = pd.DataFrame({"seq": [1, 2, 4], "prev": [0, 1, 3], "prices": [[1.0, 2.0], [1.0], [3.0]], "amounts": [[1.0, 1.0], [0.0], [1.0]]})
    out = next(apply_delta(("s",), iter([rows]), State()))
    assert out["n_levels"].tolist() == [2, 1, 1] and out["gap"].tolist() == [False, False, True]


@pytest.mark.parametrize("span", [2, 40])
def test_windows_do_not_depend_on_spans(spark, span):
    """Series with gaps of many spans, of several timeframes, cut into spans, give what each gives whole."""
    rng = np.random.default_rng(span)
    rows, t = [], dt.datetime(2024, 1, 1)
    for name, timeframe, n in (("x", "1d", 190), ("x", "1w", 90), ("y", "1d", 30), ("z", "?", 1), (None, "1d", 60)):
        close = 100 + np.cumsum(rng.normal(0, 3, n))
        step = 7 if timeframe == "1w" else 1
        rows += [(name, timeframe, t + dt.timedelta(days=i * step + (i > 50) * 200 + (i > 60) * 77), c, c + 2 + i % 3, c - 1.5, c, 1.0 + i % 7) for i, c in enumerate(close.tolist())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keys = ["instrument", "timeframe", "ts"]
    for f in (ind.rolling_indicators, ind.running_indicators, ind.hull, ind.ichimoku, ind.displaced_averages, T.average_crosses, T.breakouts, T.threshold_signals, T.line_breaks, T.rising_odds, T.drawdown, chart.decimated):
        one, cut = (f(df, span=k).drop("tps") for k in (100_000, span))
        order = [c for c in (*keys, "metric") if c in one.columns]
        one, cut = (x.orderBy(*order).toPandas() for x in (one, cut))
        assert len(one) > 0
        pd.testing.assert_frame_equal(one, cut, rtol=1e-9)
    whole = ind.with_rolling(df).drop("tps").orderBy(*keys).toPandas()
    pd.testing.assert_frame_equal(whole, ind.rolling_indicators(df, span=span).drop("tps").orderBy(*keys).toPandas(), rtol=1e-9)
    newest = ind.last_bar(ind.rolling_indicators(df)).drop("tps").orderBy(*keys).toPandas()
    latest = ind.latest_indicators(df).drop("tps").orderBy(*keys).toPandas()
    pd.testing.assert_frame_equal(newest, latest[newest.columns], rtol=1e-9)
    sums = ind.last_bar(ind.running_indicators(df)).orderBy(*keys).toPandas()
    pd.testing.assert_frame_equal(sums, latest[sums.columns], rtol=1e-9)
    crosses = T.average_crosses(df, 3, 7)
    held = [T.trades(crosses, k) for k in (100_000, span)]
    one, cut = (x.orderBy(*keys).toPandas() for x in held)
    pd.testing.assert_frame_equal(one, cut)
    plain = crosses.toPandas().sort_values(keys, na_position="first")
    plain["exit"] = plain.groupby(keys[:2], dropna=False)["close"].shift(-1)
    assert one["exit"].tolist() == plain["exit"].dropna().tolist()
    figures = [T.backtest(x, k).orderBy(*keys[:2]).toPandas() for x, k in zip(held, (100_000, span), strict=True)]
    pd.testing.assert_frame_equal(*figures, rtol=1e-9)
    equity = one.assign(equity=one.groupby(keys[:2], dropna=False)["profit"].cumsum())
    falls = equity.assign(fall=equity.groupby(keys[:2], dropna=False)["equity"].cummax().clip(lower=0) - equity["equity"]).groupby(keys[:2], dropna=False)["fall"].max()
    assert sorted(figures[1]["max_drawdown"]) == pytest.approx(sorted(falls))
