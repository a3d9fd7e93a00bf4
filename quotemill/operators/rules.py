"""Entry and exit rules: a registry of boolean expressions over indicator columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import windows as W
from quotemill.functions.scalars import div, truth
from quotemill.operators.indicators import reach, with_indicators
from quotemill.params import DEFAULT, Params

_c = F.col
Condition = Callable[[Params], Column]


def never(p: Params) -> Column:
    return F.lit(False)


def always(p: Params) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Rule:
    """A named rule. Days 0 means the open-ended machine, otherwise the timed one."""

    name: str
    days: int
    profit: int
    symbols: tuple[str, ...]
    needs: tuple[str, ...]
    buy: Condition
    sell: Condition = never
    is_long: bool = True
    description: str = ""
    verdict: str = ""


RULES: dict[str, Rule] = {}


def register_rule(rule: Rule) -> Rule:
    RULES[rule.name] = rule
    return rule


def _rule(name, days, profit, symbols, needs, buy, sell=never, description="") -> None:
    register_rule(
        Rule(name, days, profit, tuple(symbols.split()), tuple(needs.split()), buy, sell, description=description)
    )


def sell_on_strength_cross_or_volume(p: Params) -> Column:
    """Exit of the first open-ended rule."""
    crossed = (W.lag("close") > W.lag("ema8")) & (_c("close") < _c("ema8"))
    loud = F.lit(p.exit_on_volatility) & (_c("volume_ema_diff") >= p.volume_ema_threshold)
    wild = (_c("volume_ema_diff") > p.volume_ema_threshold) & (_c("volatility") > p.volatility_threshold)
    return _overbought(p) | truth(crossed) | truth(loud) | truth(wild)


def sell_on_strength_trend_or_volume(p: Params) -> Column:
    """Exit of the second open-ended rule."""
    wild = (
        F.lit(p.exit_on_volatility)
        & (_c("volume_ema_diff") > p.volume_ema_threshold)
        & (_c("volatility") > p.volatility_threshold)
    )
    return _overbought(p) | truth(wild) | truth(_c("sma50_sma200") < 0) | (_c("ema8_cross_down") > 0)


def _overbought(p: Params) -> Column:
    return truth((_c("rsi2") > p.rsi2_sell) & (_c("rsi5") > p.rsi5_sell))


def _calm(p: Params) -> Column:
    # Both sides compare with the volume threshold; the volatility one does not enter here.
    quiet = truth(_c("volume_ema_diff") < p.volume_ema_threshold)
    return quiet | truth(_c("volatility") < p.volume_ema_threshold)


def _no_crash(p: Params) -> Column:
    return div(W.diff(_c("close")), W.lag("close")) > -p.max_decline


def one_day_buy(p: Params) -> Column:
    """Low volume at a fresh closing low, or a falling Monday. Needs close, volume_ema_diff, date."""
    quiet_low = (
        (_c("close") <= W.rolling_min(_c("close"), p.down_days))
        & (_c("volume_ema_diff") < -p.volume_ema_threshold_buy)
        & F.lit(p.low_volume_buy)
    )
    monday = (_c("close") < W.lag("close")) & (F.weekday("date") == 0) & F.lit(p.monday_buy)
    return truth(quiet_low) | truth(monday)


ONE_DAY_BUY_NEEDS = ("close", "volume_ema_diff")

# Holding limits, eligible symbols and thresholds of the rules.
_rule("rule01", 2, 1, "XBI", "close_ema8 ibr change_velocity rsi5_industrials_breadth",
      lambda p: (_c("close_ema8") < 0) & (_c("ibr") < 0.4) & (_c("change_velocity") > -1)
      & (_c("rsi5_industrials_breadth") > 20),
      description="Below EMA8, weak close, no sharp fall, industrials not washed out")
_rule("rule02", 2, 1, "SPY QQQ", "close ibr",
      lambda p: (W.lag("close", 1) < W.lag("close", 2))
      & (div(W.lag("close", 1), W.lag("close", 11)) - 1 < 0) & (_c("ibr") <= 0.5),
      description="Yesterday fell and stood below ten sessions earlier, weak close")
_rule("rule03", 2, 1, "TLT", "rsi5_energy_breadth ibr3 vix vfi10",
      lambda p: (_c("rsi5_energy_breadth") < 60) & (_c("ibr3") < 0.7) & (_c("vix") < 25) & (_c("vfi10") > 0),
      description="Calm market, energy not strong, positive volume flow")
_rule("rule04", 3, 1, "FXI", "rsi2_gold_breadth rsi14_semis_breadth stoch",
      lambda p: (_c("rsi2_gold_breadth") > 50) & (_c("rsi14_semis_breadth") > 40) & (_c("stoch") < 90),
      description="Gold and semis firm, stochastic below 90")
_rule("rule05", 10, 100, "", "close", always, description="Always in, ten sessions at a time")
_rule("rule06", 2, 1, "NVDA", "rsi5_risk_breadth value_charts",
      lambda p: (_c("rsi5_risk_breadth") > 60) & (_c("value_charts") > 0),
      description="Risk appetite rising, price above its value band")
_rule("rule07", 2, 1, "NQ SMH ES QQQ FXI AAPL SOXX MSFT", "close ibr",
      lambda p: (W.lag("close", 1) <= W.lag("close", 3)) & (_c("ibr") <= 0.4),
      description="Yesterday not above three sessions ago, weak close")
_rule("rule08", 3, 1, "QQQ SPY", "er value_charts rsi2 ibr",
      lambda p: (_c("er") > 0.5) & (_c("value_charts") > -12) & (_c("rsi2") <= 90) & (_c("ibr") <= 0.8),
      description="Efficient move, neither oversold in value nor overbought")
_rule("rule09", 100, 100, "SPY QQQ", "stoch macd_hist ibr rsi14_industrials_breadth",
      lambda p: (_c("stoch") < 30) & (_c("macd_hist") < 0) & (_c("ibr") <= 0.2),
      lambda p: truth(_c("rsi14_industrials_breadth") < 40) | truth(_c("stoch") > 20),
      description="Low stochastic, falling momentum, weak close")
_rule("rule10", 3, 1, "SMH SPY", "low _low_min2 ibr",
      lambda p: (W.lag("low") <= W.lag("_low_min2")) & (_c("ibr") <= 0.5),
      description="Yesterday made the two-session low, weak close")
_rule("rule11", 2, 1, "NVDA", "vfi80 ema8_cross_down ibr3 rsi5_industrials_breadth rsi5_semis_breadth",
      lambda p: (_c("vfi80") > 0) & (_c("ema8_cross_down") < 0) & (_c("ibr3") < 0.8)
      & (_c("rsi5_industrials_breadth") < 80) & (_c("rsi5_semis_breadth") > 20),
      description="Positive long volume flow, no fresh EMA8 break, sectors neutral")
_rule("rule12", 2, 1, "", "close", always, description="Always in, two sessions or one rise")
_rule("rule13", 2, 1, "CL", "close sma100 rsi2 value_charts ibr",
      lambda p: (_c("close") > _c("sma100")) & (_c("rsi2") <= 60) & (_c("value_charts") > -4) & (_c("ibr") <= 0.2),
      description="Above SMA100, RSI2 at most 60, weak close")
_rule("rule14", 1, 1, "SMH", "low _low_min4 ibr er",
      lambda p: (_c("low") == _c("_low_min4")) & (_c("ibr") <= 0.3) & (_c("er") > 0.3),
      description="Four-session low in an efficient move, weak close")
_rule("rule15", 2, 1, "CL", "er rsi14 ibr",
      lambda p: (_c("er") > 0.2) & (_c("rsi14") >= 40) & (_c("ibr") <= 0.2),
      description="RSI14 at least 40, weak close")
_rule("rule16", 4, 1, "SMH QQQ ORCL SOXX MSFT TECL", "high close ibr",
      lambda p: (_c("high") > W.lag("close")) & (_c("ibr") <= 0.5),
      description="Traded above the last close, then weak close")
_rule("rule17", 2, 1, "SMH NQ", "rsi2 ibr er",
      lambda p: (_c("rsi2") <= 20) & (_c("ibr") <= 0.3) & (_c("er") >= 0.3),
      description="RSI2 at most 20 in an efficient move, weak close")
_rule("rule18", 2, 1, "GDX INDA", "ibr er stoch rsi14_energy_breadth",
      lambda p: (_c("ibr") <= 0.2) & (_c("er") <= 0.6) & (_c("stoch") >= 10)
      & (_c("rsi14_energy_breadth") < 60) & (_c("rsi14_energy_breadth") > 30),
      description="Weak close with neutral energy breadth")
_rule("rule19", 100, 100, "", "vix", lambda p: _c("vix") <= 10, lambda p: _c("vix") > 11,
      description="Volatility level at most 10, out above 11")
_rule("rule20", 50, 50, "SPY QQQ IWM AAPL SOXX CSCO MSFT FNGU",
      "rsi2 ibr rsi5_breadth rsi2_semis_breadth vix change_velocity",
      lambda p: (_c("rsi2") < 40) & (_c("ibr") < 0.2) & (_c("rsi5_breadth") < 60),
      lambda p: truth((W.lag("rsi2_semis_breadth") > 50) & (_c("rsi2_semis_breadth") < 50))
      | truth(_c("vix") > 40) | truth(_c("change_velocity") > 1) | truth(_c("rsi2_semis_breadth") < 10),
      description="RSI2 below 40, weak close, breadth not strong")
_rule("rule21", 1, 1, "SPY", "sma50_sma200 rsi2 rsi2_semis_breadth",
      lambda p: (_c("sma50_sma200") < 0) & (_c("rsi2") < 40) & (_c("rsi2_semis_breadth") > 30),
      description="Bear trend, RSI2 below 40, semis holding")
_rule("rule22", 5, 5, "SPY QQQ ES NQ", "rsi2_risk_breadth rsi5_risk_breadth",
      lambda p: (_c("rsi2_risk_breadth") > 95) & (_c("rsi5_risk_breadth") > 85),
      description="Risk appetite extreme")
_rule("rule23", 2, 1, "FXI", "lower_closes2 rsi5_semis_breadth",
      lambda p: (_c("lower_closes2") > 0) & (_c("rsi5_semis_breadth") > 40),
      description="Two falling closes while semis hold")
_rule("rule24", 2, 1, "GDX", "rsi5_gold_breadth rsi14_utilities_breadth",
      lambda p: (_c("rsi5_gold_breadth") > 60) & (_c("rsi14_utilities_breadth") < 50),
      description="Gold strong, utilities weak")
_rule("open_rule", 0, 0, "SPY", "close ema8 rsi2 rsi5 volume_ema_diff volatility",
      lambda p: (_c("rsi2") < p.rsi2_buy) & (_c("rsi5") < p.rsi5_buy) & _calm(p) & _no_crash(p),
      sell_on_strength_cross_or_volume,
      description="Oversold on RSI2 and RSI5, calm volume, no crash")
_rule("open_rule_filtered", 0, 0, "SPY IWM QQQ",
      "close rsi2 rsi5 volume_ema_diff volatility stoch sma50_sma200 er ema8_cross_down",
      lambda p: (_c("rsi2") < p.rsi2_buy) & _calm(p) & _no_crash(p)
      & (_c("stoch") < 30) & (_c("sma50_sma200") > 0) & (_c("er") < 0.7),
      sell_on_strength_trend_or_volume,
      description="Oversold on RSI2 in a bull trend, calm volume, no crash")

# Which rules each board runs.
SCAN_RULES = tuple(f"rule{i:02d}" for i in (*range(1, 22), 24)) + ("open_rule", "open_rule_filtered")
SCOREBOARD_RULES = tuple(f"rule{i:02d}" for i in (*range(1, 22), 23, 24)) + ("open_rule", "open_rule_filtered")
SYMBOL_BOARD_RULE = "rule11"


def rule_columns(rules: Sequence[Rule], params: Params = DEFAULT) -> set[str]:
    """Columns that the rules, the one-day buy of open-ended ones and the tracked change read."""
    names = {n for r in rules for n in r.needs} | {"close", "pct_change"}
    names |= set(ONE_DAY_BUY_NEEDS) if any(r.days == 0 for r in rules) else set()
    return names | ({params.proxy_column} if params.use_proxy else set())


def rule_reach(rules: Sequence[Rule], params: Params = DEFAULT) -> int:
    """Rows before a bar that decide its flags and tracked change, given its recurrences and context."""
    with W.reaches() as found:
        for r in rules:
            r.buy(params), r.sell(params)
        one_day_buy(params)
        W.pct_change(F.col(params.proxy_column))
    return max(found) + reach(rule_columns(rules, params), params)


def with_rules(
    bars: DataFrame,
    rules: Sequence[Rule],
    params: Params = DEFAULT,
    context: DataFrame | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Bars with one pair of boolean columns per rule, `buy_<name>` and `sell_<name>`.

    Also carries close, the leveraged change, the one-day-buy flag where an open-ended rule is
    present, and any extra indicator columns asked for.
    """
    names = rule_columns(rules, params) | set(extra)
    open_ended = any(r.days == 0 for r in rules)
    df = with_indicators(bars, sorted(names), params, context, keep=())
    conditions = {f"buy_{r.name}": truth(r.buy(params)) for r in rules}
    conditions |= {f"sell_{r.name}": truth(r.sell(params)) for r in rules}
    conditions["one_day_buy"] = one_day_buy(params) if open_ended else F.lit(False)
    kept = ["symbol", "date", "close", "pct_change", *([params.proxy_column] if params.use_proxy else []), *extra]
    return df.withColumns(conditions).select(*dict.fromkeys(kept), *conditions)


def long_rules(wide: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per bar and rule, from the wide frame of `with_rules`."""
    each = [
        F.struct(
            F.lit(r.name).alias("signal"),
            F.col(f"buy_{r.name}").alias("buy"),
            F.col(f"sell_{r.name}").alias("sell"),
            F.lit(r.days).alias("days"),
            F.lit(r.profit).alias("profit"),
        )
        for r in rules
    ]
    return wide.select("symbol", "date", F.explode(F.array(*each)).alias("_rule")).select("symbol", "date", "_rule.*")


def rule_universe(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Eligible (signal, symbol) pairs."""
    pairs = [(r.name, s) for r in (rules or RULES.values()) for s in r.symbols]
    return spark.createDataFrame(pairs, "signal string, symbol string")


def and_buy(condition: Column) -> Column:
    """The buy rule narrowed by one more condition."""
    return F.col("buy") & truth(condition)


def or_sell(condition: Column) -> Column:
    """The sell rule widened by one more condition."""
    return F.col("sell") | truth(condition)
