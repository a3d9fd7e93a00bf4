"""SQL building blocks of the check queries, written for DuckDB over the given tables.

They restate the definitions with SQL windows and recursive queries and share no code with the Spark
side. A check query is `WITH RECURSIVE` over the blocks it names, then a final SELECT.
"""

from __future__ import annotations

from quotemill.operators.context import CONTEXT_RSIS
from quotemill.params import CONTEXT_RSI_PERIODS, LEVEL_TICKERS, RATIO_TICKERS
from quotemill.plans.inputs import BRAND_TICKERS
from quotemill.plans.registry import ROUNDING_SHIFT

def over(n: int | None = None, by: str = "symbol", order: str = "i") -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY {by} ORDER BY {order}{frame})"


def roll(x: str, n: int, agg: str, by: str = "symbol", order: str = "i") -> str:
    w = over(n, by, order)
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def lag(x: str, k: int = 1, by: str = "symbol", order: str = "i") -> str:
    return f"lag({x}, {k}) {over(None, by, order)}"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE -1 END"


def r6(x: str, name: str) -> str:
    return f"{six(x)} AS {name}"


def six(x: str) -> str:
    """Six places, halves shifted off the edge, no negative zero; as the registered queries round."""
    return f"round(({x}) + {ROUNDING_SHIFT}, 6) + 0e0"


def _bars(symbol: str) -> str:
    return f"""
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min(px, row(l_orderkey, l_linenumber, px)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, row(l_orderkey, l_linenumber, px)) AS close, sum(l_quantity) AS volume
  FROM (SELECT {symbol}, l_shipdate, l_quantity, l_orderkey, l_linenumber,
               p_retailprice * (1 - l_discount) * (1 + l_tax) AS px
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY 1, 2"""


_brand_rows = ", ".join(f"('Brand#{k}', '{v}')" for k, v in BRAND_TICKERS.items())
_scaled = ", ".join(
    f"CASE WHEN ticker = '^VIX' THEN ({c} - 750.0) / 10.0 ELSE {c} END AS {c}" for c in ("open", "high", "low", "close")
)
_levels = ", ".join(f"max(close) FILTER (symbol = '{t}') AS {c}" for c, t in LEVEL_TICKERS.items())
_parts = ", ".join(f"max(close) FILTER (symbol = '{t}') AS x_{c}" for c, t in RATIO_TICKERS.items())
_tickers = ", ".join(f"'{t}'" for t in dict.fromkeys([*LEVEL_TICKERS.values(), *RATIO_TICKERS.values()]))
_ratios = ", ".join(f"x_{c} / nullif(spy, 0) AS {c}" for c in RATIO_TICKERS)
_series = " UNION ALL ".join(f"SELECT date, '{s}' AS series, {s} AS value FROM context0" for s in CONTEXT_RSI_PERIODS)
_context_rsis = ", ".join(
    f"max(rsi{n}) FILTER (series = '{s}') AS rsi{n}_{s}" for s, ns in CONTEXT_RSI_PERIODS.items() for n in ns
)


def _wilder(alias: str, row: str, n: int) -> str:
    return (
        f"{row}.up * (1e0 / {n}) + {alias}.u{n} * (1 - 1e0 / {n}) AS u{n}, "
        f"{row}.dn * (1e0 / {n}) + {alias}.d{n} * (1 - 1e0 / {n}) AS d{n}"
    )


def _rsi(n: int, count: str = "i") -> str:
    return f"CASE WHEN {count} >= {n} THEN CASE WHEN d{n} = 0 THEN 100e0 ELSE 100 - 100 / (1 + u{n} / d{n}) END END"


def _ema(c: str, x: str, n: int) -> str:
    return f"{x} * (2e0 / {n + 1}) + r.{c} * (1 - 2e0 / {n + 1})"


_line = f"({_ema('m12', 'b.close', 12)}) - ({_ema('m26', 'b.close', 26)})"


def _atr(n: int) -> str:
    return f"CASE WHEN b.i = {n} THEN b.tr{n} WHEN b.i > {n} THEN (r.atr{n} * {n - 1} + b.tr) / {n} END"


def _gap(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a}, 0) * 100 AS {a}_{b}"


PARTS: dict[str, str] = {
    "raw_bars": _bars("p_type"),
    "raw_panel": f"""
  SELECT ticker AS symbol, date, {_scaled}, volume
  FROM ({_bars("p_brand")}) JOIN (VALUES {_brand_rows}) AS m(brand, ticker) ON symbol = brand""",
    "calendar": """
  SELECT CAST(d AS DATE) AS date
  FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM raw_bars)
  WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '07-04', '12-25')""",
    "bars": """
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i
  FROM raw_bars WHERE date IN (SELECT date FROM calendar)""",
    "panel": """
  SELECT * REPLACE (CASE symbol WHEN 'CL=F' THEN 'CL' WHEN 'NQ=F' THEN 'NQ' ELSE symbol END AS symbol),
         row_number() OVER (PARTITION BY symbol ORDER BY date) AS i
  FROM raw_panel WHERE date IN (SELECT date FROM calendar)""",
    "trading_panel": "SELECT * FROM panel WHERE symbol <> '^VIX'",
    "closes": f"SELECT date, {_levels}, {_parts} FROM panel WHERE symbol IN ({_tickers}) GROUP BY date",
    "context0": f"""
  SELECT date, {", ".join(LEVEL_TICKERS)}, {_ratios},
         {flag(roll("spy", 50, "avg", "1", "date") + " > " + roll("spy", 200, "avg", "1", "date"))} AS spy_bull
  FROM closes""",
    "series": f"""
  SELECT series, date, value, row_number() OVER (PARTITION BY series ORDER BY date) AS j,
         coalesce(greatest(value - before, 0), 0) AS up, coalesce(greatest(before - value, 0), 0) AS dn
  FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY date) AS before,
               count(value) OVER (PARTITION BY series ORDER BY date) AS seen
        FROM ({_series}))
  WHERE seen > 0""",
    "series_rec": f"""
  SELECT series, date, j, 0e0 AS u2, 0e0 AS d2, 0e0 AS u5, 0e0 AS d5, 0e0 AS u14, 0e0 AS d14 FROM series WHERE j = 1
  UNION ALL
  SELECT s.series, s.date, s.j, {_wilder("r", "s", 2)}, {_wilder("r", "s", 5)}, {_wilder("r", "s", 14)}
  FROM series_rec r JOIN series s ON s.series = r.series AND s.j = r.j + 1""",
    "series_rsi": f"""
  SELECT series, date, {_rsi(2, "j")} AS rsi2, {_rsi(5, "j")} AS rsi5, {_rsi(14, "j")} AS rsi14 FROM series_rec""",
    "context_rsi": f"SELECT date, {_context_rsis} FROM series_rsi GROUP BY date",
    "context": f"""
  SELECT context0.*, {", ".join(CONTEXT_RSIS)} FROM context0 LEFT JOIN context_rsi USING (date)""",
    "base": f"""
  SELECT *, coalesce(greatest(close - c1, 0), 0) AS up, coalesce(greatest(c1 - close, 0), 0) AS dn,
         {roll("tr", 20, "avg")} AS tr20, {roll("tr", 50, "avg")} AS tr50
  FROM (SELECT *, CASE WHEN c1 IS NULL THEN high - low
                  ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr
        FROM (SELECT *, {lag("close")} AS c1, {lag("close", 2)} AS c2, {lag("close", 3)} AS c3,
                     {lag("close", 10)} AS c10, {lag("close", 11)} AS c11, {lag("low")} AS l1, {lag("low", 2)} AS l2
              FROM @src))""",
    "rec": f"""
  SELECT symbol, i, close AS e8, close AS e20, close AS e100, volume AS v8, close AS m12, close AS m26,
         CAST(NULL AS DOUBLE) AS sig, 0e0 AS u2, 0e0 AS d2, 0e0 AS u5, 0e0 AS d5, 0e0 AS u14, 0e0 AS d14,
         CAST(NULL AS DOUBLE) AS atr20, CAST(NULL AS DOUBLE) AS atr50
  FROM base WHERE i = 1
  UNION ALL
  SELECT b.symbol, b.i, {_ema("e8", "b.close", 8)}, {_ema("e20", "b.close", 20)}, {_ema("e100", "b.close", 100)},
         {_ema("v8", "b.volume", 8)}, {_ema("m12", "b.close", 12)}, {_ema("m26", "b.close", 26)},
         CASE WHEN b.i = 26 THEN {_line} WHEN b.i > 26 THEN ({_line}) * 2e-1 + r.sig * 8e-1 END,
         {_wilder("r", "b", 2)}, {_wilder("r", "b", 5)}, {_wilder("r", "b", 14)}, {_atr(20)}, {_atr(50)}
  FROM rec r JOIN base b ON b.symbol = r.symbol AND b.i = r.i + 1""",
    "ind1": f"""
  SELECT b.*, CASE WHEN i >= 8 THEN e8 END AS ema8, CASE WHEN i >= 20 THEN e20 END AS ema20,
         CASE WHEN i >= 100 THEN e100 END AS ema100, CASE WHEN i >= 8 THEN v8 END AS volume_ema8,
         CASE WHEN i >= 34 THEN m12 - m26 - sig END AS macd_hist,
         {_rsi(2)} AS rsi2, {_rsi(5)} AS rsi5, {_rsi(14)} AS rsi14, rec.atr20, rec.atr50,
         (close / nullif(c1, 0) - 1) * 3 AS pct_change, close / nullif(c1, 0) - 1 AS adjusted_change,
         CASE WHEN high = low THEN 1e0 ELSE (close - low) / (high - low) END AS ibr,
         (high + low + close) / 3 AS tp,
         {", ".join(f"{roll('close', n, 'avg')} AS sma{n}" for n in (10, 20, 50, 100, 200))},
         {roll("close", 20, "stddev_pop")} AS spread20,
         {roll("low", 14, "min")} AS low14, {roll("high", 14, "max")} AS high14,
         {roll("(high + low) / 2", 5, "avg")} AS mid5, {roll("high - low", 5, "avg")} AS range5,
         abs(close - c1) AS move, abs(close - c10) AS move10,
         {", ".join(f"{roll('volume', n, 'avg')} AS vol{n}" for n in (10, 20, 40, 80))},
         {roll("close", 3, "min")} AS cmin3, {roll("close", 3, "max")} AS cmax3, {roll("low", 4, "min")} AS lmin4
  FROM base b JOIN rec USING (symbol, i)""",
    "ind2": f"""
  SELECT *, {lag("tp")} AS tp1, {roll("tp", 20, "avg")} AS tp_mean, {roll("tp", 20, "list")} AS tp_list,
         {roll("ibr", 2, "avg")} AS ibr2, {roll("ibr", 3, "avg")} AS ibr3,
         {roll("adjusted_change", 5, "stddev_samp")} * sqrt(252) AS volatility,
         move10 / nullif({roll("move", 10, "sum")}, 0) AS er,
         (close - low14) / nullif(high14 - low14, 0) * 100 AS stoch,
         (close - mid5) * 5 / nullif(range5, 0) AS value_charts,
         {lag("ema8")} AS ema8_1, {lag("atr20")} AS atr20_1,
         {roll("rsi14", 14, "min")} AS rsi_low, {roll("rsi14", 14, "max")} AS rsi_high
  FROM ind1""",
    "ind3": f"""
  SELECT *, (tp - tp_mean) / nullif(15e-3 * list_aggregate(
             list_transform(tp_list, lambda x: abs(x - list_aggregate(tp_list, 'avg'))), 'avg'), 0) AS cci,
         {roll("stoch", 3, "avg")} AS stoch_d, coalesce(ln(tp) - ln(tp1), 0) AS log_move
  FROM ind2""",
    "ind4": f"""
  SELECT *, {roll("log_move", 30, "stddev_samp")} * 2e-1 * close AS cutoff, tp - tp1 AS tp_move FROM ind3""",
    "ind5": f"""
  SELECT *, {", ".join(
      f"CASE WHEN tp_move > cutoff THEN CASE WHEN volume < vol{n} * 25e-1 THEN volume ELSE vol{n} * 25e-1 END "
      f"WHEN tp_move < -cutoff THEN -CASE WHEN volume < vol{n} * 25e-1 THEN volume ELSE vol{n} * 25e-1 END "
      f"ELSE 0e0 END AS signed{n}" for n in (10, 20, 40, 80))}
  FROM ind4""",
    "ind6": f"""
  SELECT *, {", ".join(f"{roll(f'signed{n}', n, 'sum')} / nullif(vol{n}, 0) AS flow{n}" for n in (10, 20, 40, 80))}
  FROM ind5""",
    "flow_rec": f"""
  SELECT symbol, i, {", ".join(
      f"coalesce(flow{n}, 0) AS num{n}, CASE WHEN flow{n} IS NULL THEN 0e0 ELSE 1e0 END AS den{n}"
      for n in (10, 20, 40, 80))}
  FROM ind6 WHERE i = 1
  UNION ALL
  SELECT b.symbol, b.i, {", ".join(
      f"coalesce(b.flow{n}, 0) + r.num{n} * 5e-1, CASE WHEN b.flow{n} IS NULL THEN 0e0 ELSE 1e0 END + r.den{n} * 5e-1"
      for n in (10, 20, 40, 80))}
  FROM flow_rec r JOIN ind6 b ON b.symbol = r.symbol AND b.i = r.i + 1""",
    "ind": f"""
  SELECT ind6.*, {", ".join(f"num{n} / nullif(den{n}, 0) AS vfi{n}" for n in (10, 20, 40, 80))},
         sma20 AS bb_middle, sma20 + spread20 * 2 AS bb_upper, sma20 - spread20 * 2 AS bb_lower,
         {flag("rsi2 <= 15 AND rsi5 <= 35")} AS rsi_buy, {flag("rsi2 >= 95 AND rsi5 >= 70")} AS rsi_sell,
         {flag("close > ema8 AND c1 < ema8_1")} AS ema8_cross_up,
         {flag("close < ema8 AND c1 > ema8_1")} AS ema8_cross_down,
         (volume - volume_ema8) / nullif(volume_ema8, 0) AS volume_ema_diff,
         stoch - stoch_d AS stoch_oscillator,
         (rsi14 - rsi_low) / nullif(rsi_high - rsi_low, 0) AS stoch_rsi,
         {_gap("close", "ema8")}, {_gap("ema20", "ema100")}, {_gap("sma50", "sma200")}, {_gap("sma20", "sma50")},
         {_gap("close", "sma200")}, {_gap("close", "sma50")}, {_gap("close", "sma20")},
         {flag("close <= c1")} AS lowest_close2, {flag("close >= c1")} AS highest_close2,
         {flag("close <= cmin3")} AS lowest_close3, {flag("close >= cmax3")} AS highest_close3,
         {flag("close > c1 AND c1 > c2")} AS higher_closes2,
         {flag("close > c1 AND c1 > c2 AND c2 > c3")} AS higher_closes3,
         {flag("close < c1 AND c1 < c2")} AS lower_closes2,
         {flag("close < c1 AND c1 < c2 AND c2 < c3")} AS lower_closes3,
         atr20 - atr50 AS atr20_atr50, (close - c1) / nullif(atr20_1, 0) AS change_velocity
  FROM ind6 JOIN flow_rec USING (symbol, i)""",
    "frame_all": f"""
  SELECT ind.*, {", ".join(f"context.{c}" for c in (*LEVEL_TICKERS, *RATIO_TICKERS, "spy_bull", *CONTEXT_RSIS))}
  FROM ind LEFT JOIN context ON ind.date = context.date""",
}

# What each block reads, so that a query lists only the block it wants.
_READS: dict[str, tuple[str, ...]] = {
    "calendar": ("raw_bars",),
    "bars": ("raw_bars", "calendar"),
    "panel": ("raw_panel", "calendar"),
    "trading_panel": ("panel",),
    "closes": ("panel",),
    "context0": ("closes",),
    "series": ("context0",),
    "series_rec": ("series",),
    "series_rsi": ("series_rec",),
    "context_rsi": ("series_rsi",),
    "context": ("context0", "context_rsi"),
    "base": ("@src",),
    "rec": ("base",),
    "ind1": ("base", "rec"),
    "ind2": ("ind1",),
    "ind3": ("ind2",),
    "ind4": ("ind3",),
    "ind5": ("ind4",),
    "ind6": ("ind5",),
    "flow_rec": ("ind6",),
    "ind": ("ind6", "flow_rec"),
    "frame_all": ("ind", "context"),
}


def sql(wanted: str, final: str, source: str = "bars", extra: dict[str, str] | None = None) -> str:
    """A whole check query: the wanted blocks with all they read, the extra blocks, the final SELECT."""
    done: list[str] = []

    def need(name: str) -> None:
        name = source if name == "@src" else name
        for n in _READS.get(name, ()):
            need(n)
        if name not in done:
            done.append(name)

    for name in wanted.split():
        need(name)
    texts = {n: PARTS[n].replace("@src", source) for n in done} | (extra or {})
    blocks = [f"{n} AS {'' if n.endswith('rec') else 'MATERIALIZED '}({text})" for n, text in texts.items()]
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n" + final


# Rule conditions over the blocks `ind` and `frame_all`; a rule without a sell never sells.
_STRONG = "(rsi2 > 95 AND rsi5 > 70)"
_CALM = "(coalesce(volume_ema_diff < 6e-1, false) OR coalesce(volatility < 6e-1, false))"
_NO_CRASH = "((close - c1) / nullif(c1, 0) > -4e-2)"
RULE_SQL: dict[str, tuple[str, str]] = {
    "rule01": (
        "close_ema8 < 0 AND ibr < 4e-1 AND change_velocity > -1 AND rsi5_industrials_breadth > 20", "false"),
    "rule02": ("c1 < c2 AND c1 / nullif(c11, 0) - 1 < 0 AND ibr <= 5e-1", "false"),
    "rule03": ("rsi5_energy_breadth < 60 AND ibr3 < 7e-1 AND vix < 25 AND vfi10 > 0", "false"),
    "rule04": ("rsi2_gold_breadth > 50 AND rsi14_semis_breadth > 40 AND stoch < 90", "false"),
    "rule05": ("true", "false"),
    "rule06": ("rsi5_risk_breadth > 60 AND value_charts > 0", "false"),
    "rule07": ("c1 <= c3 AND ibr <= 4e-1", "false"),
    "rule08": ("er > 5e-1 AND value_charts > -12 AND rsi2 <= 90 AND ibr <= 8e-1", "false"),
    "rule09": (
        "stoch < 30 AND macd_hist < 0 AND ibr <= 2e-1",
        "coalesce(rsi14_industrials_breadth < 40, false) OR coalesce(stoch > 20, false)"),
    "rule10": ("l1 <= l2 AND ibr <= 5e-1", "false"),
    "rule11": (
        "vfi80 > 0 AND ema8_cross_down < 0 AND ibr3 < 8e-1 AND rsi5_industrials_breadth < 80 "
        "AND rsi5_semis_breadth > 20", "false"),
    "rule12": ("true", "false"),
    "rule13": ("close > sma100 AND rsi2 <= 60 AND value_charts > -4 AND ibr <= 2e-1", "false"),
    "rule14": ("low = lmin4 AND ibr <= 3e-1 AND er > 3e-1", "false"),
    "rule15": ("er > 2e-1 AND rsi14 >= 40 AND ibr <= 2e-1", "false"),
    "rule16": ("high > c1 AND ibr <= 5e-1", "false"),
    "rule17": ("rsi2 <= 20 AND ibr <= 3e-1 AND er >= 3e-1", "false"),
    "rule18": (
        "ibr <= 2e-1 AND er <= 6e-1 AND stoch >= 10 AND rsi14_energy_breadth < 60 AND rsi14_energy_breadth > 30",
        "false"),
    "rule19": ("vix <= 10", "vix > 11"),
    "rule20": (
        "rsi2 < 40 AND ibr < 2e-1 AND rsi5_breadth < 60",
        "coalesce(semis_before > 50 AND rsi2_semis_breadth < 50, false) OR coalesce(vix > 40, false) "
        "OR coalesce(change_velocity > 1, false) OR coalesce(rsi2_semis_breadth < 10, false)"),
    "rule21": ("sma50_sma200 < 0 AND rsi2 < 40 AND rsi2_semis_breadth > 30", "false"),
    "rule22": ("rsi2_risk_breadth > 95 AND rsi5_risk_breadth > 85", "false"),
    "rule23": ("lower_closes2 > 0 AND rsi5_semis_breadth > 40", "false"),
    "rule24": ("rsi5_gold_breadth > 60 AND rsi14_utilities_breadth < 50", "false"),
    "open_rule": (
        f"rsi2 < 15 AND rsi5 < 35 AND {_CALM} AND {_NO_CRASH}",
        f"coalesce({_STRONG}, false) OR coalesce(c1 > ema8_1 AND close < ema8, false) "
        "OR coalesce(volume_ema_diff >= 6e-1, false) OR coalesce(volume_ema_diff > 6e-1 AND volatility > 1e-1, false)"),
    "open_rule_filtered": (
        f"rsi2 < 15 AND {_CALM} AND {_NO_CRASH} AND stoch < 30 AND sma50_sma200 > 0 AND er < 7e-1",
        f"coalesce({_STRONG}, false) OR coalesce(volume_ema_diff > 6e-1 AND volatility > 1e-1, false) "
        "OR coalesce(sma50_sma200 < 0, false) OR ema8_cross_down > 0"),
}
_CONTEXT_WORDS = ("breadth", "vix")
ONE_DAY = (
    "coalesce(close <= cmin3 AND volume_ema_diff < -15e-2, false) "
    "OR coalesce(close < c1 AND isodow(date) = 1, false)"
)


def needs_context(*names: str) -> bool:
    return any(w in text for n in names for text in RULE_SQL[n] for w in _CONTEXT_WORDS)


def rule_source(*names: str) -> str:
    return "frame_all" if needs_context(*names) else "ind"


def rule_rows(limits: dict[str, tuple[int, int]], track: str = "pct_change", source: str | None = None) -> str:
    """Block text: one row per bar and rule with its flags and limits."""
    source = source or rule_source(*limits)
    before = ", " + lag("rsi2_semis_breadth") + " AS semis_before" if source == "frame_all" else ""
    rows = [
        f"SELECT symbol, '{n}' AS signal, i, date, close, {track} AS track, coalesce({RULE_SQL[n][0]}, false) AS buy, "
        f"coalesce({RULE_SQL[n][1]}, false) AS sell, {ONE_DAY} AS odb, {d} AS days, {p} AS profit "
        f"FROM (SELECT *{before} FROM {source})"
        for n, (d, p) in limits.items()
    ]
    return " UNION ALL ".join(rows)


def play_timed(rows: str = "rows_in", long: bool = True, keys: tuple[str, ...] = ("symbol", "signal")) -> str:
    """Recursive block text: the timed machine over the block of rule rows."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = r.{c}" for c in keys)
    sign, won = ("", ">") if long else ("-", "<")
    return f"""
  SELECT {k}, i, date, close, track, buy, sell, days, profit, false AS hold, buy AS tin,
         (0 >= days OR 0 >= profit) AS tout, 0 AS held, 0 AS ups,
         CASE WHEN buy THEN close ELSE 0e0 END AS entry, CASE WHEN buy THEN date END AS entry_date, 15000e0 AS equity
  FROM {rows} WHERE i = 1
  UNION ALL
  SELECT {k}, i, date, close, track, buy, sell, days, profit, h, buy AND NOT h,
         (sell AND h) OR held >= days OR ups >= profit, held, ups,
         CASE WHEN buy AND NOT h THEN close WHEN h THEN entry ELSE 0e0 END,
         CASE WHEN buy AND NOT h THEN date WHEN h THEN entry_date END,
         CASE WHEN h THEN equity * (1 + {sign}track) ELSE equity END
  FROM (SELECT *, CASE WHEN h THEN held_before + 1 ELSE 0 END AS held,
               CASE WHEN h THEN ups_before + CASE WHEN close {won} close_before THEN 1 ELSE 0 END ELSE 0 END AS ups
        FROM (SELECT {", ".join(f"s.{c}" for c in keys)}, s.i, s.date, s.close, s.track, s.buy, s.sell, s.days,
                     s.profit, (r.hold AND NOT r.tout) OR r.tin AS h, r.held AS held_before, r.ups AS ups_before,
                     r.close AS close_before, r.entry, r.entry_date, r.equity
              FROM play_rec r JOIN {rows} s ON {on} AND s.i = r.i + 1))"""


def play_open(rows: str = "rows_in", keys: tuple[str, ...] = ("symbol", "signal")) -> str:
    """Recursive block text: the open-ended machine over the block of rule rows."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = r.{c}" for c in keys)
    return f"""
  SELECT {k}, i, date, close, track, buy, sell, odb, days, profit, false AS hold, false AS tin, false AS tout,
         0 AS held, 0 AS ups, 0e0 AS entry, CAST(NULL AS DATE) AS entry_date, 0e0 AS tpnl, 15000e0 AS equity
  FROM {rows} WHERE i = 1
  UNION ALL
  SELECT {k}, i, date, close, track, buy, sell, odb, days, profit, h, t,
         (sell AND h) OR (odb_before AND NOT hold_before AND NOT buy_before) OR coalesce(tpnl < -15e-2, false)
           OR (days > 0 AND (held >= days OR ups >= profit)), held, ups,
         CASE WHEN (t OR odb) AND entry_before = 0 THEN close WHEN h THEN entry_before ELSE 0e0 END,
         CASE WHEN (t OR odb) AND entry_before = 0 THEN date WHEN h THEN date_before END, tpnl,
         CASE WHEN h THEN equity * (1 + track) ELSE equity END
  FROM (SELECT *, (buy OR odb) AND NOT h AS t, CASE WHEN h THEN held_before + 1 ELSE 0 END AS held,
               CASE WHEN h THEN ups_before + CASE WHEN close > close_before THEN 1 ELSE 0 END ELSE 0 END AS ups,
               CASE WHEN h THEN tpnl_before + track ELSE 0e0 END AS tpnl
        FROM (SELECT {", ".join(f"s.{c}" for c in keys)}, s.i, s.date, s.close, s.track, s.buy, s.sell, s.odb, s.days,
                     s.profit, (r.hold AND NOT r.tout) OR r.tin OR r.odb AS h, r.odb AS odb_before,
                     r.buy AS buy_before, r.hold AS hold_before, r.held AS held_before, r.ups AS ups_before,
                     r.close AS close_before, r.entry AS entry_before, r.entry_date AS date_before,
                     r.tpnl AS tpnl_before, r.equity
              FROM play_rec r JOIN {rows} s ON {on} AND s.i = r.i + 1))"""


def played(open_ended: bool = False, long: bool = True, keys: tuple[str, ...] = ("symbol", "signal")) -> str:
    """Block text: the machine's rows with trade result, peak, drawdown and return."""
    by = ", ".join(keys)
    leverage = "3" if long else "-3"
    pnl = "tpnl" if open_ended else f"CASE WHEN hold THEN (close - entry) / entry ELSE 0e0 END * {leverage}"
    w = f"OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
  SELECT *, {pnl} AS trade_pnl, max(equity) {w} AS peak, (max(equity) {w} - equity) / max(equity) {w} AS drawdown,
         equity / nullif(lag(equity) OVER (PARTITION BY {by} ORDER BY i), 0) - 1 AS ret
  FROM play_rec"""


# Aggregates over the block of played rows.
_R = "CASE WHEN equity <> 0 THEN ret END"
MEASURES = {
    "trades": "count(*) FILTER (tout)",
    "positive_trades": "count(*) FILTER (tout AND trade_pnl > 0)",
    "pct_positive": "100e0 * count(*) FILTER (tout AND trade_pnl > 0) / nullif(count(*) FILTER (tout), 0)",
    "avg_win": "avg(trade_pnl) FILTER (tout AND trade_pnl > 0)",
    "avg_loss": "avg(trade_pnl) FILTER (tout AND trade_pnl < 0)",
    "last_equity": "arg_max(equity, i)",
    "max_dd": "max(drawdown)",
    "cagr": "CASE WHEN arg_max(equity, i) / arg_min(equity, i) > 0 "
    "THEN pow(arg_max(equity, i) / arg_min(equity, i), 252e0 / count(*)) - 1 END",
    "sharpe": f"CASE WHEN arg_max(equity, i) < 0 THEN -100e0 WHEN stddev_samp({_R}) = 0 THEN 0e0 "
    f"ELSE sqrt(252) * avg({_R}) / stddev_samp({_R}) END",
    "sortino": f"CASE WHEN sqrt(avg(pow(least({_R}, 0e0), 2)) FILTER ({_R} IS NOT NULL)) = 0 THEN 0e0 "
    f"ELSE sqrt(252) * avg({_R}) / sqrt(avg(pow(least({_R}, 0e0), 2)) FILTER ({_R} IS NOT NULL)) END",
    "kelly": f"avg({_R}) / nullif(var_samp({_R}), 0)",
    "kelly_pct": "(count(*) FILTER (tout AND trade_pnl > 0) * 1e0 / nullif(count(*) FILTER (tout), 0) "
    "- (1 - count(*) FILTER (tout AND trade_pnl > 0) * 1e0 / nullif(count(*) FILTER (tout), 0)) "
    "/ nullif(avg(trade_pnl) FILTER (tout AND trade_pnl > 0) / nullif(-avg(trade_pnl) FILTER (tout AND trade_pnl < 0), 0), 0)) * 100",
}


def log_growth(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x} / 15000) END"
