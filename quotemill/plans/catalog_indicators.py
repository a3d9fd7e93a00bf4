"""Registered queries: indicators and rules over the session bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators import rules as RU
from quotemill.operators.context import CONTEXT_COLUMNS, CONTEXT_RSIS, context_rsis, levels_and_ratios
from quotemill.operators.indicators import ALL_INDICATORS, HURST_LENGTHS, add_all_indicators, with_indicators
from quotemill.params import CONTEXT_RSI_PERIODS
from quotemill.plans import inputs as I
from quotemill.plans.oracle_parts import ONE_DAY, RULE_SQL, r6, roll, rule_rows, rule_source, six, sql
from quotemill.plans.registry import add
from quotemill.schema import PRICE_COLUMNS

c = F.col
FLAGS = frozenset(n for n in ALL_INDICATORS if n.startswith(("rsi_", "lowest", "highest", "higher", "lower"))) | {
    "ema8_cross_up",
    "ema8_cross_down",
    "spy_bull",
}


def _pick(names) -> str:
    return ", ".join(n if n in FLAGS else r6(n, n) for n in names)


def _indicator(name: str, columns: str, source: str = "ind") -> None:
    names = columns.split()
    add(
        name,
        lambda s, d: with_indicators(I.bars(s, d), names, keep=()),
        sql(source, f"SELECT symbol, date, {_pick(names)} FROM {source}"),
    )


_indicator("ind1_leveraged_change", "pct_change")
_indicator("ind2_internal_bar_ratio", "ibr")
_indicator("ind3_bar_ratio_means", "ibr2 ibr3")
_indicator("ind4_commodity_channel", "cci")
_indicator("ind5_simple_means", "sma10 sma20 sma50 sma100 sma200")
_indicator("ind6_rsi", "rsi2 rsi5 rsi14")
add(
    "ind7_context_rsi",
    lambda s, d: context_rsis(levels_and_ratios(I.panel(s, d))),
    sql("context_rsi", "SELECT date, " + _pick(CONTEXT_RSIS) + " FROM context0 LEFT JOIN context_rsi USING (date)"),
)
_indicator("ind8_rsi_flags", "rsi_buy rsi_sell")
_indicator("ind9_bollinger", "bb_upper bb_middle bb_lower")
_indicator("ind10_ema", "ema8 ema20 ema100")
_indicator("ind11_ema_cross", "ema8_cross_up ema8_cross_down")
_indicator("ind12_volume_ema_diff", "volume_ema_diff")
_indicator("ind13_volatility", "adjusted_change volatility")
_indicator("ind14_efficiency_ratio", "er")
_indicator("ind15_stochastic", "stoch")
_indicator("ind16_stochastic_oscillator", "stoch_oscillator")
_indicator("ind17_value_charts", "value_charts")
_indicator("ind18_macd_histogram", "macd_hist")
_indicator("ind19_volume_flow", "vfi10 vfi20 vfi40 vfi80")
_indicator(
    "ind20_gaps", "close_ema8 ema20_ema100 sma50_sma200 sma20_sma50 close_sma200 close_sma50 close_sma20"
)
_indicator("ind21_extremes_2", "lowest_close2 highest_close2")
_indicator("ind22_extremes_3", "lowest_close3 highest_close3")
_indicator("ind23_true_range", "atr20 atr50 atr20_atr50")
_indicator("ind24_change_velocity", "change_velocity")
_indicator("ind25_close_runs", "higher_closes2 higher_closes3 lower_closes2 lower_closes3")

# Rescaled range from the window's own values: chunk by chunk, then the regression slope.
_chunks = {
    n: ", ".join(f"l[{s + 1}:{s + n}]" for s in range(0, 100 - n + 1, n)) for n in HURST_LENGTHS
}
_ratio = (
    "(list_max(x) - list_min(x)) / nullif(list_aggregate(list_transform(generate_series(2, len(x)), "
    "lambda k: x[k] - x[k - 1]), 'stddev_samp'), 0)"
)
_means = ", ".join(
    f"log10(list_aggregate(list_filter(list_transform([{_chunks[n]}], lambda x: {_ratio}), lambda q: q <> 0), 'avg')) AS y{n}"
    for n in HURST_LENGTHS
)
_pairs = ", ".join(f"(log10({n}), y{n})" for n in HURST_LENGTHS)
_EXPONENTS = f"""SELECT symbol, date, (SELECT regr_slope(y, x) FROM (VALUES {_pairs}) AS p(x, y)) AS hurst
  FROM (SELECT symbol, date, {_means} FROM (SELECT *, {roll("close", 100, "list")} AS l FROM bars))"""
add(
    "ind26_hurst",
    lambda s, d: with_indicators(I.bars(s, d), ["hurst"], keep=()),
    sql("bars", f"SELECT symbol, date, {six('hurst')} AS hurst FROM exponents", extra={"exponents": _EXPONENTS}),
)
_indicator("ind27_stochastic_d", "stoch_d")
_indicator("ind28_stochastic_rsi", "stoch_rsi")
add(
    "ind29_regime_passed_through",
    lambda s, d: with_indicators(I.bars(s, d), ["close", "spy_bull"], context=I.context(s, d), keep=()),
    sql("frame_all", f"SELECT symbol, date, {r6('close', 'close')}, spy_bull FROM frame_all"),
)
add(
    "ind30_all_indicators",
    lambda s, d: add_all_indicators(I.bars(s, d), I.context(s, d)),
    sql(
        "frame_all",
        "SELECT symbol, date, "
        + _pick([*PRICE_COLUMNS, *ALL_INDICATORS, *CONTEXT_COLUMNS])
        + ", false AS sell FROM frame_all JOIN exponents USING (symbol, date)",
        extra={"exponents": _EXPONENTS},
    ),
)


# Rules: both flags on every bar.
def _rule_query(name: str):
    def query(spark, sf):
        rule = RU.RULES[name]
        wide = RU.with_rules(I.bars(spark, sf), [rule], context=I.context(spark, sf))
        return wide.select("symbol", "date", c(f"buy_{name}").alias("buy"), c(f"sell_{name}").alias("sell"))

    return query


def _limits(*names: str) -> dict[str, tuple[int, int]]:
    return {n: (RU.RULES[n].days, RU.RULES[n].profit) for n in names}


for _i, _name in enumerate(RU.RULES, start=1):
    add(
        f"sig{_i}_{_name}",
        _rule_query(_name),
        sql(
            rule_source(_name),
            "SELECT symbol, date, buy, sell FROM rows_in",
            extra={"rows_in": rule_rows(_limits(_name))},
        ),
    )

for _sell, _name in (("sell1_strength_cross_volume", "open_rule"), ("sell2_strength_trend_volume", "open_rule_filtered")):

    def _sell_query(spark, sf, name=_name):
        rule = RU.RULES[name]
        frame = with_indicators(I.bars(spark, sf), sorted({"close", *rule.needs}), keep=())
        from quotemill.params import DEFAULT

        return frame.withColumn("sell", rule.sell(DEFAULT)).select("symbol", "date", "sell")

    add(_sell, _sell_query, sql("ind", f"SELECT symbol, date, {RULE_SQL[_name][1]} AS sell FROM ind"))

add(
    "siga_eligible_pairs",
    lambda s, d: I.raw_panel(s, d)
    .groupBy("symbol")
    .agg(F.count(F.lit(1)).alias("bars"))
    .join(RU.rule_universe(s), "symbol"),
    sql(
        "raw_panel",
        "SELECT symbol, bars, signal FROM (SELECT symbol, count(*) AS bars FROM raw_panel GROUP BY 1) JOIN (VALUES "
        + ", ".join(f"('{r.name}', '{x}')" for r in RU.RULES.values() for x in r.symbols)
        + ") AS u(signal, symbol) USING (symbol)",
    ),
)


def _composed(spark, sf):
    rule = RU.RULES["rule09"]
    wide = RU.with_rules(I.bars(spark, sf), [rule], context=I.context(spark, sf), extra=["rsi2", "er"])
    pair = wide.withColumns({"buy": c("buy_rule09"), "sell": c("sell_rule09")})
    return pair.select("symbol", "date", RU.and_buy(c("rsi2") <= 20).alias("buy"), RU.or_sell(c("er") >= 0.5).alias("sell"))


add(
    "sigb_extra_conditions",
    _composed,
    sql(
        "frame_all",
        "SELECT symbol, date, buy AND coalesce(rsi2 <= 20, false) AS buy, sell OR coalesce(er >= 5e-1, false) AS sell "
        "FROM rows_in JOIN ind USING (symbol, date)",
        extra={"rows_in": rule_rows(_limits("rule09"))},
    ),
)


def _one_day(spark, sf):
    from quotemill.params import DEFAULT

    frame = with_indicators(I.bars(spark, sf), list(RU.ONE_DAY_BUY_NEEDS), keep=())
    return frame.withColumn("one_day_buy", RU.one_day_buy(DEFAULT)).select("symbol", "date", "one_day_buy")


add("sigc_one_day_buy", _one_day, sql("ind", f"SELECT symbol, date, {ONE_DAY} AS one_day_buy FROM ind"))


def _all_rules(spark, sf):
    rules = list(RU.RULES.values())
    return RU.long_rules(RU.with_rules(I.bars(spark, sf), rules, context=I.context(spark, sf)), rules)


add(
    "sigd_all_rules_long",
    _all_rules,
    sql(
        "frame_all",
        "SELECT symbol, date, signal, buy, sell, days, profit FROM rows_in",
        extra={"rows_in": rule_rows(_limits(*RU.RULES))},
    ),
)

