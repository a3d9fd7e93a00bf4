"""Recurrences against plain loops, whole and in batches."""

import numpy as np
import pandas as pd
import pytest

from quotemill.functions.smoothing import Smoother, Smoothing, with_smoothings
from tests.conftest import make_bars

SPECS = [
    Smoothing("ema8", "ema", "close", (8,)),
    Smoothing("rsi5", "rsi", "close", (5,)),
    Smoothing("atr20", "atr", "close", (20,)),
    Smoothing("macd", "macd_hist", "close", (12, 26, 9)),
]


def series(n=120, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    return pd.DataFrame({"high": close + 1, "low": close - 1, "close": close})


def loop_ema(x, n):
    out, y = [], None
    for v in x:
        y = v if y is None else v * 2 / (n + 1) + y * (1 - 2 / (n + 1))
        out.append(y)
    return np.array(out)


def test_against_loops():
    pdf = series()
    got = Smoother(SPECS).push(pdf)
    close = pdf.close.to_numpy()
    ema = loop_ema(close, 8)
    assert np.isnan(got["ema8"][:7]).all()
    np.testing.assert_allclose(got["ema8"][7:], ema[7:])
    up = dn = 0.0
    for i in range(1, len(close)):
        change = close[i] - close[i - 1]
        up, dn = (up * 4 + max(change, 0)) / 5, (dn * 4 + max(-change, 0)) / 5
    assert got["rsi5"][-1] == pytest.approx(100 - 100 / (1 + up / dn))
    span = [2.0] + [max(2.0, abs(h - c), abs(l - c)) for h, l, c in zip(pdf.high[1:], pdf.low[1:], close)]
    atr = np.mean(span[:20])
    assert got["atr20"][19] == pytest.approx(atr) and np.isnan(got["atr20"][18])
    for v in span[20:]:
        atr = (atr * 19 + v) / 20
    assert got["atr20"][-1] == pytest.approx(atr)
    line = loop_ema(close, 12) - loop_ema(close, 26)
    signal = loop_ema(line[25:], 9)
    assert np.isnan(got["macd"][:33]).all() and not np.isnan(got["macd"][33])
    np.testing.assert_allclose(got["macd"][33:], (line[25:] - signal)[8:], atol=1e-12)


def gaps(pdf):
    """The series with single, repeated and leading missing values in every column."""
    pdf = pdf.copy()
    for k, column in enumerate(pdf.columns):
        for at in (0, 1, 30 + k, 31 + k, 32 + k, 60, 61, 100 + k):
            pdf.loc[at, column] = np.nan
    return pdf


def test_ema_ages_over_gaps():
    got = Smoother([Smoothing("e", "ema", "x", (3,))]).push(pd.DataFrame({"x": [1.0, 2, 3, np.nan, np.nan, 9, 4, 5]}))["e"]
    # After two missing values the old mean weighs 1/8 against 1/2.
    y = 2.25
    assert got[2] == got[3] == got[4] == pytest.approx(y)
    y = (y / 8 + 9 / 2) / (1 / 8 + 1 / 2)
    assert got[5] == pytest.approx(y) and got[6] == pytest.approx((y + 4) / 2)


@pytest.mark.parametrize("make", [series, lambda: gaps(series())])
@pytest.mark.parametrize("cut", [1, 3, 19, 40])
def test_batches_do_not_matter(cut, make):
    pdf, whole, parts = make(), Smoother(SPECS).push(make()), Smoother(SPECS)
    got = [parts.push(pdf.iloc[i : i + cut]) for i in range(0, len(pdf), cut)]
    for name in whole:
        np.testing.assert_allclose(np.concatenate([g[name] for g in got]), whole[name], rtol=1e-12, atol=1e-12)


def test_rsi_of_constant_and_late_series():
    constant = Smoother([Smoothing("r", "rsi", "x", (2,))]).push(pd.DataFrame({"x": [1.0] * 5}))["r"]
    assert np.isnan(constant[0]) and (constant[1:] == 100).all()
    late = Smoother([Smoothing("r", "rsi", "x", (2,))]).push(pd.DataFrame({"x": [np.nan, np.nan, 1.0, 2.0, np.nan, 1.0]}))["r"]
    assert np.isnan(late[:3]).all() and late[3] == 100 and late[4] == 100
    assert late[5] == 100  # the move over the gap is not counted


def test_grouped_pass_streams_in_batches(spark):
    closes = (100 + np.cumsum(np.random.default_rng(5).normal(0, 1, 300))).tolist()
    bars = make_bars(spark, closes, "AAA").unionByName(make_bars(spark, closes[::-1], "BBB"))
    whole = with_smoothings(bars, SPECS).orderBy("symbol", "date").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        cut = with_smoothings(bars, SPECS).orderBy("symbol", "date").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 600
    pd.testing.assert_frame_equal(whole, cut)
    alone = Smoother(SPECS).push(make_bars(spark, closes).toPandas())
    np.testing.assert_allclose(whole[whole.symbol == "AAA"].ema8.to_numpy(float), alone["ema8"], rtol=1e-12)
