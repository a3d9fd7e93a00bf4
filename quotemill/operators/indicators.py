"""Technical indicators as a registry of columns, computed on demand with their dependencies.

Three kinds: projections and window expressions (one shuffle and sort by symbol for all of them),
recurrences (one batched pass per symbol), and context columns (joined by date).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import windows as W
from quotemill.functions.scalars import clip_above, div, flag, gap_pct
from quotemill.functions.smoothing import Smoothing, with_smoothings
from quotemill.operators.context import CONTEXT_COLUMNS, attach_context
from quotemill.params import DEFAULT, Params
from quotemill.schema import BAR_COLUMNS
from quotemill.session import spread

_c = F.col


@dataclass(frozen=True)
class Indicator:
    name: str
    needs: tuple[str, ...]
    build: Callable[[Params], Column]


REGISTRY: dict[str, Indicator] = {}
RECURRENCES: dict[str, Smoothing] = {}
# Outputs that are a span-weighted mean of another column: name -> (input, span).
WEIGHTED: dict[str, tuple[str, int]] = {}


def _add(name: str, needs: str, build: Callable[[Params], Column]) -> None:
    REGISTRY[name] = Indicator(name, tuple(needs.split()), build)


def _recur(name: str, kind: str, source: str, *periods: int) -> None:
    RECURRENCES[name] = Smoothing(name, kind, source, periods)


def _sum(source: str, n: int) -> str:
    """Register the rolling sum of a column over n rows; returns its name."""
    name = f"_sum{n}_{source}"
    _add(name, source, lambda p: W.rolling_sum(_c(source), n))
    return name


def _mean(name: str, source: str, n: int) -> None:
    total = _sum(source, n)
    _add(name, total, lambda p: _c(total) / n)


def _rolled(kind: str, source: str, n: int) -> str:
    """Register a rolling extreme or deviation with the short frames that it is put together from; returns its name."""
    rolled = W.Rolled(kind, source, n)
    for part, (needs, build) in rolled.stretches().items():
        _add(part, needs, lambda p, build=build: build())
    name = f"_{kind}_{n}_{source}"
    _add(name, " ".join(rolled.stretches()), lambda p: rolled.column())
    return name


# Bar shape and change.
_add("pct_change", "close", lambda p: W.pct_change(_c("close")) * p.leverage)
_add("adjusted_change", "close", lambda p: W.pct_change(_c("close")))
_add(
    "volatility",
    "adjusted_change",
    lambda p: W.rolling_std(_c("adjusted_change"), p.volatility_period) * math.sqrt(p.periods_per_year),
)
_add(
    "ibr",
    "high low close",
    lambda p: F.when(_c("high") == _c("low"), F.lit(1.0)).otherwise(
        div(_c("close") - _c("low"), _c("high") - _c("low"))
    ),
)
_add("ibr2", "ibr", lambda p: W.rolling_mean(_c("ibr"), 2))
_add("ibr3", "ibr", lambda p: W.rolling_mean(_c("ibr"), 3))

# Typical price and the commodity channel index.
_add("_typical", "high low close", lambda p: (_c("high") + _c("low") + _c("close")) / 3)
_mean("_typical_mean", "_typical", 20)
_add("_typical_values", "_typical", lambda p: W.rolling_values(_c("_typical"), 20))
_add(
    "cci",
    "_typical _typical_mean _typical_values",
    lambda p: div(
        _c("_typical") - _c("_typical_mean"), W.mean_abs_deviation(_c("_typical_values"), 20) * 0.015
    ),
)

# Moving averages, bands and their gaps.
for _n in (10, 20, 50, 100, 200):
    _mean(f"sma{_n}", "close", _n)
_spread20 = _rolled("std_pop", "close", 20)
_mean("bb_middle", "close", 20)
_add("bb_upper", f"bb_middle {_spread20}", lambda p: _c("bb_middle") + _c(_spread20) * 2)
_add("bb_lower", f"bb_middle {_spread20}", lambda p: _c("bb_middle") - _c(_spread20) * 2)
for _n in (8, 20, 100):
    _recur(f"ema{_n}", "ema", "close", _n)
for _a, _b in (
    ("close", "ema8"),
    ("ema20", "ema100"),
    ("sma50", "sma200"),
    ("sma20", "sma50"),
    ("close", "sma200"),
    ("close", "sma50"),
    ("close", "sma20"),
):
    _add(f"{_a}_{_b}", f"{_a} {_b}", lambda p, a=_a, b=_b: gap_pct(a, b))
_add(
    "ema8_cross_up",
    "close ema8",
    lambda p: flag((_c("close") > _c("ema8")) & (W.lag("close") < W.lag("ema8"))),
)
_add(
    "ema8_cross_down",
    "close ema8",
    lambda p: flag((_c("close") < _c("ema8")) & (W.lag("close") > W.lag("ema8"))),
)
_recur("macd_hist", "macd_hist", "close", 12, 26, 9)

# Relative strength.
for _n in (2, 5, 14):
    _recur(f"rsi{_n}", "rsi", "close", _n)
_add("rsi_buy", "rsi2 rsi5", lambda p: flag((_c("rsi2") <= p.rsi2_buy) & (_c("rsi5") <= p.rsi5_buy)))
_add("rsi_sell", "rsi2 rsi5", lambda p: flag((_c("rsi2") >= p.rsi2_sell) & (_c("rsi5") >= p.rsi5_sell)))
_add("_rsi14_low", "rsi14", lambda p: W.rolling_min(_c("rsi14"), 14))
_add("_rsi14_high", "rsi14", lambda p: W.rolling_max(_c("rsi14"), 14))
_add(
    "stoch_rsi",
    "rsi14 _rsi14_low _rsi14_high",
    lambda p: div(_c("rsi14") - _c("_rsi14_low"), _c("_rsi14_high") - _c("_rsi14_low")),
)

# Stochastics and value charts.
_add("_low14", "low", lambda p: W.rolling_min(_c("low"), 14))
_add("_high14", "high", lambda p: W.rolling_max(_c("high"), 14))
_add("stoch", "close _low14 _high14", lambda p: div(_c("close") - _c("_low14"), _c("_high14") - _c("_low14")) * 100)
_add("stoch_d", "stoch", lambda p: W.rolling_mean(_c("stoch"), 3))
_add("stoch_oscillator", "stoch stoch_d", lambda p: _c("stoch") - _c("stoch_d"))
_add("_mid_mean", "high low", lambda p: W.rolling_mean((_c("high") + _c("low")) / 2, 5))
_add("_range_mean", "high low", lambda p: W.rolling_mean(_c("high") - _c("low"), 5))
_add(
    "value_charts",
    "close _mid_mean _range_mean",
    lambda p: div((_c("close") - _c("_mid_mean")) * 5, _c("_range_mean")),
)

# Efficiency ratio.
_add("_move", "close", lambda p: F.abs(W.diff(_c("close"))))
_add("_move10", "close", lambda p: F.abs(W.diff(_c("close"), 10)))
_add("_path10", "_move", lambda p: W.rolling_sum(_c("_move"), 10))
_add("er", "_move10 _path10", lambda p: div(_c("_move10"), _c("_path10")))

# Volume.
_recur("volume_ema8", "ema", "volume", 8)
_add("volume_ema_diff", "volume volume_ema8", lambda p: div(_c("volume") - _c("volume_ema8"), _c("volume_ema8")))
_add("_typical_before", "_typical", lambda p: W.lag("_typical"))
_add(
    "_log_move",
    "_typical _typical_before",
    lambda p: F.coalesce(F.ln("_typical") - F.ln("_typical_before"), F.lit(0.0)),
)
_log_spread = _rolled("std", "_log_move", 30)
for _n in (10, 20, 40, 80):
    _mean(f"_volume_mean{_n}", "volume", _n)

    def _signed(p: Params, n: int = _n) -> Column:
        cutoff = _c(_log_spread) * 0.2 * _c("close")
        move = _c("_typical") - _c("_typical_before")
        capped = clip_above(_c("volume"), _c(f"_volume_mean{n}") * 2.5)
        return F.when(move > cutoff, capped).when(move < -cutoff, -capped).otherwise(F.lit(0.0))

    _add(f"_signed{_n}", f"_typical _typical_before {_log_spread} close volume _volume_mean{_n}", _signed)
    _flow = _sum(f"_signed{_n}", _n)
    _add(
        f"_flow{_n}",
        f"{_flow} _volume_mean{_n}",
        lambda p, n=_n, total=_flow: div(_c(total), _c(f"_volume_mean{n}")),
    )
    WEIGHTED[f"vfi{_n}"] = (f"_flow{_n}", 3)

# Runs of closes and recent extremes.
_add("lowest_close2", "close", lambda p: flag(_c("close") <= W.lag("close")))
_add("highest_close2", "close", lambda p: flag(_c("close") >= W.lag("close")))
_add("lowest_close3", "close", lambda p: flag(_c("close") <= W.rolling_min(_c("close"), 3)))
_add("highest_close3", "close", lambda p: flag(_c("close") >= W.rolling_max(_c("close"), 3)))


def _run_of(n: int, rising: bool) -> Column:
    steps = [(_c("close") if k == 0 else W.lag("close", k), W.lag("close", k + 1)) for k in range(n)]
    held = F.lit(True)
    for newer, older in steps:
        held = held & ((newer > older) if rising else (newer < older))
    return flag(held)


for _n in (2, 3):
    _add(f"higher_closes{_n}", "close", lambda p, n=_n: _run_of(n, True))
    _add(f"lower_closes{_n}", "close", lambda p, n=_n: _run_of(n, False))

for _n in (2, 4):
    _add(f"_low_min{_n}", "low", lambda p, n=_n: W.rolling_min(_c("low"), n))

# True range.
for _n in (20, 50):
    _recur(f"atr{_n}", "atr", "close", _n)
_add("atr20_atr50", "atr20 atr50", lambda p: _c("atr20") - _c("atr50"))
_add("change_velocity", "close atr20", lambda p: div(W.diff(_c("close")), W.lag("atr20")))

# Rescaled-range exponent over 100 bars. Chunk lengths of the regression.
HURST_WINDOW = 100
HURST_LENGTHS = (10, 17, 31, 56, 100)
_add("_step", "close", lambda p: W.diff(_c("close")))
for _n in HURST_LENGTHS:
    _parts = [_rolled("max", "close", _n), _rolled("min", "close", _n), _rolled("std", "_step", _n - 1)]

    def _rescaled(p: Params, parts: list[str] = _parts) -> Column:
        # Trailing range over trailing step deviation; flat chunks count as missing.
        high, low, spread = parts
        ratio = div(_c(high) - _c(low), _c(spread))
        return F.when(ratio != 0, ratio)

    _add(f"_rescaled{_n}", " ".join(_parts), _rescaled)

    def _chunk_mean(p: Params, n: int = _n) -> Column:
        # Chunks start at the oldest bar of the window; each is a trailing ratio some rows back.
        back = [HURST_WINDOW - start - n for start in range(0, HURST_WINDOW - n + 1, n)]
        terms = [W.lag(f"_rescaled{n}", k) if k else _c(f"_rescaled{n}") for k in back]
        total, count = F.lit(0.0), F.lit(0)
        for t in terms:
            total = total + F.coalesce(t, F.lit(0.0))
            count = count + t.isNotNull().cast("int")
        return F.when(W.lag("close", HURST_WINDOW - 1).isNotNull(), div(total, count))

    _add(f"_chunks{_n}", f"close _rescaled{_n}", _chunk_mean)


def _slope(p: Params) -> Column:
    x = [math.log10(n) for n in HURST_LENGTHS]
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    slope = F.lit(0.0)
    for v, n in zip(x, HURST_LENGTHS):
        slope = slope + F.log10(_c(f"_chunks{n}")) * ((v - mean) / spread)
    return slope


_add("hurst", " ".join(f"_chunks{n}" for n in HURST_LENGTHS), _slope)

# Everything the full frame holds.
OPTIONAL = ("stoch_d", "stoch_rsi", "volume_ema8")
ALL_INDICATORS = tuple(
    n for n in (*REGISTRY, *RECURRENCES, *WEIGHTED) if not n.startswith("_") and n not in OPTIONAL
)


def _needs(name: str) -> tuple[str, ...]:
    if name in REGISTRY:
        return REGISTRY[name].needs
    if name in RECURRENCES:
        return RECURRENCES[name].inputs
    if name in WEIGHTED:
        return (WEIGHTED[name][0],)
    return ()


def closure(names: Iterable[str]) -> dict[str, int]:
    """Every column the names rest on, with its depth; a column is built after all it needs."""
    depth: dict[str, int] = {}

    def visit(name: str) -> int:
        if name not in depth:
            derived = [visit(n) for n in _needs(name)]
            windowed = name in REGISTRY or name in WEIGHTED
            depth[name] = max(derived, default=0) + 1 if windowed else 0
        return depth[name]

    for name in names:
        visit(name)
    return depth


def reach(names: Iterable[str], params: Params = DEFAULT) -> int:
    """Rows back that any of the columns looks, through all it rests on; recurrences and context count as given."""
    rows: dict[str, int] = {}
    for name in sorted(depth := closure(names), key=depth.get):
        with W.reaches() as found:
            if name in REGISTRY:
                REGISTRY[name].build(params)
            elif name in WEIGHTED:
                found.append(W.ewm_reach(WEIGHTED[name][1]))
        rows[name] = max(found, default=0) + max((rows[n] for n in _needs(name) if name not in RECURRENCES), default=0)
    return max(rows.values(), default=0)


def recurrences(names: Iterable[str]) -> list[Smoothing]:
    """The recurrences that the columns rest on."""
    depth = closure(names)
    return [s for n, s in RECURRENCES.items() if n in depth]


def with_indicators(
    bars: DataFrame,
    names: Sequence[str],
    params: Params = DEFAULT,
    context: DataFrame | None = None,
    keep: Sequence[str] = BAR_COLUMNS,
) -> DataFrame:
    """Bars plus the named indicators and context columns, and nothing else that is not needed.

    Recurrences run first on the few bar columns they read, unless the bars bring them along; window columns follow level by level on
    one sorted exchange by symbol; context columns are joined by date at the end.
    """
    names = list(dict.fromkeys(names))
    depth = closure(names)
    unknown = [n for n in depth if not _needs(n) and n not in CONTEXT_COLUMNS and n not in bars.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    base = [c for c in bars.columns if c in ("symbol", "date") or c in keep or c in depth]
    df = with_smoothings(bars.select(*base), [s for s in recurrences(names) if s.name not in bars.columns])
    if any(depth.values()):
        df = spread(df, "symbol")

    for level in range(1, max(depth.values(), default=0) + 1):
        due = [n for n, d in depth.items() if d == level]
        plain = {n: REGISTRY[n].build(params) for n in due if n in REGISTRY}
        df = df.withColumns(plain) if plain else df
    # No registered column reads a weighted mean, so all of one span share their passes at the end.
    for span in sorted({WEIGHTED[n][1] for n in depth if n in WEIGHTED}):
        df = W.with_ewm(df, {n: WEIGHTED[n][0] for n in depth if n in WEIGHTED and WEIGHTED[n][1] == span}, span)

    joined = [n for n in depth if n in CONTEXT_COLUMNS and n not in bars.columns]
    if joined:
        if context is None:
            raise ValueError(f"a context frame is needed for {joined}")
        df = attach_context(df, context, joined, params)
    kept = [c for c in base if c in ("symbol", "date") or c in keep]
    return df.select(*kept, *[n for n in names if n not in kept])


def add_all_indicators(
    bars: DataFrame, context: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    """The full indicator frame, with a Sell column that no rule has set yet."""
    frame = with_indicators(bars, [*ALL_INDICATORS, *CONTEXT_COLUMNS], params, context)
    return frame.withColumn("sell", F.lit(False))
