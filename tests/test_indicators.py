"""Indicators and rules on small series, and the shape of their plans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import windows as W
from quotemill.operators import rules as RU
from quotemill.operators.indicators import ALL_INDICATORS, RECURRENCES, closure, with_indicators
from quotemill.params import DEFAULT
from quotemill.schema import BAR_COLUMNS
from tests.conftest import make_bars

CLOSES = [10.0, 11.0, 12.0, 11.0, 10.0, 10.0, 13.0, 14.0, 15.0, 16.0, 15.0, 14.0]


def values(spark, name, closes=CLOSES, **kwargs):
    frame = with_indicators(make_bars(spark, closes, **kwargs), [name], keep=()).orderBy("date")
    return [r[name] for r in frame.collect()]


def test_hand_worked(spark):
    assert values(spark, "pct_change")[:3] == [None, pytest.approx(0.3), pytest.approx(3 / 11)]
    assert values(spark, "ibr")[0] == 0.5
    assert values(spark, "ibr", spread=0.0)[0] == 1.0
    assert values(spark, "sma10")[8:10] == [None, pytest.approx(12.2)]
    assert values(spark, "lower_closes2") == [-1, -1, -1, -1, 1, -1, -1, -1, -1, -1, -1, 1]
    assert values(spark, "higher_closes3") == [-1, -1, -1, -1, -1, -1, -1, -1, 1, 1, -1, -1]
    assert values(spark, "lowest_close3") == [-1, -1, -1, 1, 1, 1, -1, -1, -1, -1, 1, 1]
    assert values(spark, "er")[10] == pytest.approx(5 / 11)
    assert values(spark, "value_charts")[4] == pytest.approx((10 - 10.8) * 5 / 2)


def test_short_and_flat_series_give_null_not_errors(spark):
    frame = with_indicators(make_bars(spark, [10.0] * 5, spread=0.0, volume=[0.0] * 5), list(ALL_INDICATORS), keep=())
    last = frame.orderBy(F.desc("date")).first()
    assert last.sma200 is None and last.stoch is None and last.volume_ema_diff is None and last.vfi10 is None
    assert last.ibr == 1.0 and last.rsi2 == 100.0 and last.lowest_close2 == 1


def test_long_sums_equal_direct_windows(spark):
    closes = (100 + np.cumsum(np.random.default_rng(2).normal(0, 1, 260))).tolist()
    bars = make_bars(spark, closes)
    built = with_indicators(bars, ["sma20", "sma50", "sma100", "sma200"], keep=())
    direct = bars.withColumns({f"sma{n}": W.rolling(F.col("close"), n, F.avg) for n in (20, 50, 100, 200)})
    for n in (20, 50, 100, 200):
        a = [r[0] for r in built.orderBy("date").select(f"sma{n}").collect()]
        b = [r[0] for r in direct.orderBy("date").select(f"sma{n}").collect()]
        assert [x is None for x in a] == [x is None for x in b] == [True] * (n - 1) + [False] * (261 - n)
        assert [x for x in a if x] == pytest.approx([x for x in b if x], rel=1e-12)


@pytest.mark.parametrize("n", [2, 16, 17, 64, 65, 101, 200])
def test_long_windows_equal_pandas(spark, n):
    """With missing values, flat stretches and large numbers."""
    rng = np.random.default_rng(n)
    closes = 1e4 + np.cumsum(rng.normal(0, 1, 420)).round(2)
    closes[230:] = closes[230]
    gaps = [None if k in (3, 60, 75) else float(x) for k, x in enumerate(closes)]
    bars = make_bars(spark, closes.tolist()).orderBy("date")
    days_of = [r.date for r in bars.select("date").collect()]
    frame = spark.createDataFrame([("AAA", d, x) for d, x in zip(days_of, gaps)], "symbol string, date date, x double")
    kinds = {"min": "min", "max": "max", "std": "std"}
    got = W.with_rolling(frame.withColumns({"sum": W.rolling_sum(F.col("x"), n), "mean": W.rolling_mean(F.col("x"), n)}), {k: W.Rolled(k, "x", n) for k in kinds})
    rows = got.orderBy("date").collect()
    want = pd.Series(gaps, dtype=float).rolling(n)
    for kind in ("sum", "mean", "min", "max"):
        expected = getattr(want, kind)().tolist()
        assert [r[kind] is None for r in rows] == [math.isnan(x) for x in expected]
        assert [r[kind] for r in rows if r[kind] is not None] == pytest.approx([x for x in expected if not math.isnan(x)], rel=1e-13)
    # A slow, two-pass deviation: pandas' own rolls on.
    for k, r in enumerate(rows):
        part = gaps[max(0, k - n + 1) : k + 1]
        if len(part) < n or None in part:
            assert r["std"] is None
        else:
            assert r["std"] == pytest.approx(np.std(part, ddof=1), rel=1e-9, abs=1e-11)


def test_reach_covers_what_decides_a_flag(spark):
    """Flags of the last bar are the same from the last `rule_reach` bars before it as from all of them."""
    closes = (100 + np.cumsum(np.random.default_rng(9).normal(0, 1, 300))).tolist()
    bars = make_bars(spark, closes)
    for name in ("rule02", "rule13", "rule14"):
        rule = RU.RULES[name]
        whole = with_indicators(bars, sorted(set(rule.needs) | {"pct_change", "volume", "high", "low", "open"} | set(rule.needs)), keep=BAR_COLUMNS)
        smoothed = [c for c in whole.columns if c in RECURRENCES]
        tail = whole.orderBy(F.desc("date")).limit(RU.rule_reach([rule]) + 1).select(*BAR_COLUMNS, *smoothed)
        last = [RU.with_rules(x, [rule]).orderBy(F.desc("date")).first() for x in (bars, tail)]
        assert last[0] == last[1]


def test_weighted_mean_against_a_loop(spark):
    closes = (100 + np.cumsum(np.random.default_rng(4).normal(0, 1, 150))).tolist()
    for span in (3, 19):
        frame = W.with_ewm(make_bars(spark, closes), {"y": "close"}, span).orderBy("date")
        q = 1 - 2 / (span + 1)
        num = den = 0.0
        for x, row in zip(closes, frame.collect()):
            num, den = x + q * num, 1 + q * den
            assert row.y == pytest.approx(num / den, rel=1e-12)


def test_rescaled_range_slope(spark):
    closes = (100 + np.cumsum(np.random.default_rng(6).normal(0, 1, 103))).tolist()
    got = values(spark, "hurst", closes)
    assert got[:99] == [None] * 99
    x = np.array(closes[-100:])
    lengths, means = [10, 17, 31, 56, 100], []
    for n in lengths:
        chunks = [x[s : s + n] for s in range(0, 100 - n + 1, n)]
        means.append(np.mean([np.ptp(c) / np.std(np.diff(c), ddof=1) for c in chunks]))
    want = np.polyfit([math.log10(n) for n in lengths], np.log10(means), 1)[0]
    assert got[-1] == pytest.approx(want)


def test_only_what_is_needed_is_computed(spark):
    assert set(closure(["close_ema8"])) == {"close_ema8", "close", "ema8"}
    plan = with_indicators(make_bars(spark, CLOSES), ["sma200", "er", "stoch"], keep=())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1 and "FlatMapGroups" not in text
    recurrent = with_indicators(make_bars(spark, CLOSES), ["change_velocity"], keep=())
    text = recurrent._jdf.queryExecution().executedPlan().toString()
    assert text.count("FlatMapGroupsInPandas") == 1 and "volume" not in text.split("FlatMapGroupsInPandas")[1].split("\n")[0]
    with pytest.raises(ValueError, match="unknown"):
        with_indicators(make_bars(spark, CLOSES), ["no_such_thing"])
    with pytest.raises(ValueError, match="context"):
        with_indicators(make_bars(spark, CLOSES), ["vix"])


def test_whole_frame_needs_few_passes(spark):
    frame = with_indicators(make_bars(spark, CLOSES), list(ALL_INDICATORS), keep=())
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert text.count("+- Window [") <= 8 and text.count("Exchange") == 2


def test_missing_inputs_never_fire(spark):
    rules = [r for r in RU.RULES.values() if not r.days or "breadth" not in " ".join(r.needs)]
    rules = [r for r in rules if "vix" not in r.needs and r.name not in ("rule05", "rule12")]
    wide = RU.with_rules(make_bars(spark, [10.0]), rules)
    row = wide.first()
    assert not any(row[f"{side}_{r.name}"] for r in rules for side in ("buy", "sell"))
    assert all(row[f"buy_{r.name}"] is not None for r in rules)


def test_one_day_buy_on_a_falling_monday(spark):
    closes = [10.0, 11.0, 12.0, 13.0, 14.0, 13.5, 13.6, 13.7, 13.8, 13.9, 14.5]
    frame = with_indicators(make_bars(spark, closes), list(RU.ONE_DAY_BUY_NEEDS), keep=())
    fired = frame.withColumn("x", RU.one_day_buy(DEFAULT)).orderBy("date").collect()
    assert [i for i, r in enumerate(fired) if r.x] == [5]


def test_user_rules_compose(spark):
    rule = RU.Rule("mine", 3, 1, ("AAA",), ("close", "ibr"), lambda p: F.col("close") > 12, lambda p: F.col("ibr") < 0)
    RU.register_rule(rule)
    try:
        wide = RU.with_rules(make_bars(spark, CLOSES), [rule]).withColumns({"buy": F.col("buy_mine"), "sell": F.col("sell_mine")})
        assert wide.filter("buy").count() == 6
        assert wide.filter(RU.and_buy(F.col("close") > 14)).count() == 3
        assert wide.filter(RU.or_sell(F.col("close") > 14)).count() == 3
        assert RU.rule_universe(spark).filter("signal = 'mine'").count() == 1
    finally:
        del RU.RULES["mine"]
