"""Registered queries: positions, measures, sweeps and boards."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import boards as BO
from quotemill.operators import metrics as M
from quotemill.operators import positions as P
from quotemill.operators import rules as RU
from quotemill.operators import sweeps as SW
from quotemill.operators.indicators import with_indicators
from quotemill.params import DEFAULT, NO_VOLUME_SYMBOLS, Params
from quotemill.plans import inputs as I
from quotemill.plans.oracle_parts import (
    MEASURES,
    lag,
    log_growth as log_sql,
    needs_context,
    play_open,
    play_timed,
    played,
    r6,
    rule_rows,
    rule_source,
    six,
    sql,
)
from quotemill.plans.registry import add, log_growth
from quotemill.session import bucketed, work_folder
from quotemill.sources.sinks import read_positions, save_bucketed_bars, write_positions

c = F.col
TIMED, OPEN = "rule07", "open_rule"
PROXY = Params(use_proxy=True)
SPLIT = Params(use_proxy=True, split_long=True)


def _limits(*names: str) -> dict[str, tuple[int, int]]:
    return {n: (RU.RULES[n].days, RU.RULES[n].profit) for n in names}


def _wide(spark, sf, rules, params=DEFAULT, extra=(), bars=None) -> DataFrame:
    names = [r.name for r in rules]
    context = I.context(spark, sf) if params.use_proxy or needs_context(*names) or extra else None
    return RU.with_rules(I.bars(spark, sf) if bars is None else bars, rules, params, context, extra)


def _frame(spark, sf, *names: str, params: Params = DEFAULT) -> DataFrame:
    rules = [RU.RULES[n] for n in names]
    return P.positions(_wide(spark, sf, rules, params), rules, params)


def _blocks(names, track="pct_change", source=None, open_ended=False, long=True, limits=None) -> dict[str, str]:
    rows = rule_rows(limits or _limits(*names), track, source)
    play = play_open() if open_ended else play_timed(long=long)
    return {"rows_in": rows, "play_rec": play, "played": played(open_ended, long)}


# Position frames.
_FRAME_SQL = f"""SELECT symbol, signal, date, buy, sell, hold, tin AS trade_in, tout AS trade_out,
  held AS days_in_trade, ups AS profitable_closes, {r6("entry", "trade_entry")}, entry_date,
  {r6("trade_pnl", "trade_pnl")}, {r6("track", "track_change")}, {six(log_sql("equity"))} AS log_equity,
  {r6("drawdown", "drawdown")}, {r6("ret", "daily_return")} FROM played"""


def _shown(frame: DataFrame) -> DataFrame:
    return frame.select(
        "symbol", "signal", "date", "buy", "sell", "hold", "trade_in", "trade_out", "days_in_trade",
        "profitable_closes", "trade_entry", "entry_date", "trade_pnl", "track_change",
        log_growth("equity").alias("log_equity"), "drawdown", "daily_return",
    )


add(
    "pos1_timed_positions",
    lambda s, d: _shown(_frame(s, d, TIMED)),
    sql("ind", _FRAME_SQL, extra=_blocks([TIMED])),
)


def _short(spark, sf):
    rule = replace(RU.RULES[TIMED], is_long=False)
    return _shown(P.positions(_wide(spark, sf, [rule]), [rule]))


add("pos1_timed_positions_short", _short, sql("ind", _FRAME_SQL, extra=_blocks([TIMED], long=False)))
add(
    "pos2_open_positions",
    lambda s, d: _shown(_frame(s, d, OPEN)),
    sql("ind", _FRAME_SQL, extra=_blocks([OPEN], open_ended=True)),
)


def _open_limited(spark, sf):
    """The open-ended machine with limits, as its optional arguments allow."""
    rule = RU.RULES[OPEN]
    wide = _wide(spark, sf, [rule])
    return _shown(P.play(wide, [replace(rule, days=5, profit=2)], True))


add(
    "pos2_open_positions_limited",
    _open_limited,
    sql("ind", _FRAME_SQL, extra=_blocks([OPEN], open_ended=True, limits={OPEN: (5, 2)})),
)
_PROXY_CHANGE = f"(soxx / nullif({lag('soxx')}, 0) - 1) * 3"
_TRACKED = {
    "tracked": f"SELECT *, {_PROXY_CHANGE} AS proxy_change, ({_PROXY_CHANGE} + pct_change) / 2 AS split_change FROM frame_all"
}
add(
    "pos3_open_positions_proxy",
    lambda s, d: _shown(_frame(s, d, OPEN, params=PROXY)),
    sql("frame_all", _FRAME_SQL, extra=_TRACKED | _blocks([OPEN], "proxy_change", "tracked", open_ended=True)),
)


def _tracks(spark, sf):
    frame = with_indicators(I.bars(spark, sf), ["pct_change", "soxx"], context=I.context(spark, sf), keep=())
    tracks = {"own": P.track_change(DEFAULT), "proxy": P.track_change(PROXY), "split": P.track_change(SPLIT)}
    return frame.withColumns(tracks).select("symbol", "date", *tracks)


add(
    "pos4_tracked_change",
    _tracks,
    sql(
        "frame_all",
        f"SELECT symbol, date, {r6('pct_change', 'own')}, {r6('proxy_change', 'proxy')}, {r6('split_change', 'split')} FROM tracked",
        extra=_TRACKED,
    ),
)


def _dispatched(spark, sf):
    frame = _frame(spark, sf, TIMED, OPEN)
    return frame.groupBy("symbol", "signal").agg(
        F.count_if("trade_in").alias("entries"), F.count_if("trade_out").alias("exits"), log_last().alias("log_equity")
    )


def log_last():
    return F.when(F.max_by("equity", "date") > 0, F.ln(F.max_by("equity", "date") / 15000))


_DISPATCH = (
    f"SELECT symbol, signal, count(*) FILTER (tin) AS entries, count(*) FILTER (tout) AS exits, "
    f"{six(log_sql('arg_max(equity, i)'))} AS log_equity FROM @p GROUP BY 1, 2"
)
add(
    "pos5_dispatch",
    _dispatched,
    sql(
        "ind",
        "SELECT * FROM (" + _DISPATCH.replace("@p", "play_rec") + ") UNION ALL " + _DISPATCH.replace("@p", "open_rec"),
        extra={
            "rows_in": rule_rows(_limits(TIMED)),
            "rows_open": rule_rows(_limits(OPEN)),
            "play_rec": play_timed(),
            "open_rec": play_open("rows_open").replace("play_rec", "open_rec"),
        },
    ),
)


def _curve(spark, sf):
    curve = _frame(spark, sf, TIMED).select("symbol", "signal", "date", "equity")
    return P.with_drawdown(curve).select(
        "symbol", "signal", "date", log_growth("running_max").alias("log_peak"), "drawdown"
    )


add(
    "pos6_peak_and_drawdown",
    _curve,
    sql(
        "ind",
        f"SELECT symbol, signal, date, {six(log_sql('peak'))} AS log_peak, {r6('drawdown', 'drawdown')} FROM played",
        extra=_blocks([TIMED]),
    ),
)
_LEDGER = f"""SELECT symbol, signal, entry_date, date AS exit_date, {r6("entry", "trade_entry")},
  {r6("close", "trade_exit")}, held AS days_in_trade, {r6("trade_pnl", "trade_pnl")} FROM played WHERE tout"""
add(
    "pos7_trade_ledger",
    lambda s, d: P.trade_ledger(_frame(s, d, TIMED)),
    sql("ind", _LEDGER, extra=_blocks([TIMED])),
)
add(
    "pos7_trade_ledger_open",
    lambda s, d: P.trade_ledger(_frame(s, d, OPEN)),
    sql("ind", _LEDGER, extra=_blocks([OPEN], open_ended=True)),
)


def _stored(spark, sf):
    """Two rules and two sets of symbols, each in a call of its own, one of them twice."""
    path = f"{work_folder(spark)}/positions-{uuid.uuid4().hex}"
    early = c("symbol") < "M"
    for rule in (TIMED, "rule16"):
        frame = _frame(spark, sf, rule)
        for part in (early, ~early, early):
            write_positions(frame.filter(part), path)
    return _shown(read_positions(spark, path))


add("snk1_position_files", _stored, sql("ind", _FRAME_SQL, extra=_blocks([TIMED, "rule16"])))



def _bucketed(spark, sf):
    """Bars of a table bucketed by symbol, from the indicators to the positions without an exchange."""
    name = f"bucketed_{uuid.uuid4().hex}"
    save_bucketed_bars(I.bars(spark, sf), name, 8, f"{work_folder(spark)}/{name}")
    rule = RU.RULES[TIMED]
    with bucketed(spark):
        return _shown(P.positions(RU.with_rules(spark.table(name), [rule]), [rule]))


add("src1_bucketed_positions", _bucketed, sql("ind", _FRAME_SQL, extra=_blocks([TIMED])))

# Measures over position frames.
RULES_MEASURED = (TIMED, "rule11", "rule16")


def _measured(**columns):
    def query(spark, sf):
        built = {n: b() for n, b in columns.items()}
        return M.measure(_frame(spark, sf, *RULES_MEASURED), **built)

    return query


_WHOLE = ("trades", "positive_trades")
_measure_blocks = _blocks(RULES_MEASURED)
_measure_source = rule_source(*RULES_MEASURED)


def _measure(name: str, check: dict[str, str], **columns) -> None:
    shown = ", ".join(f"{x} AS {n}" if n in _WHOLE else r6(x, n) for n, x in check.items())
    text = f"SELECT symbol, signal, {shown} FROM played GROUP BY 1, 2"
    add(name, _measured(**columns), sql(_measure_source, text, extra=_measure_blocks))


_measure("met1_sharpe", {"sharpe": MEASURES["sharpe"]}, sharpe=M.sharpe)
_measure("met2_sortino", {"sortino": MEASURES["sortino"]}, sortino=M.sortino)


def _treynor(spark, sf):
    benchmark = I.context(spark, sf).select("date", _benchmark_return().alias("benchmark_return"))
    return M.treynor(_frame(spark, sf, *RULES_MEASURED), benchmark)


def _benchmark_return():
    return F.try_divide("qqq", "soxx") - 1


_R = "CASE WHEN equity <> 0 THEN ret END"
add(
    "met3_treynor",
    _treynor,
    sql(
        "frame_all",
        f"""SELECT symbol, signal, {r6("beta", "beta")},
          {six("CASE WHEN beta = 0 THEN 0e0 ELSE mean / nullif(beta, 0) END")} AS treynor
        FROM (SELECT symbol, signal, avg({_R}) AS mean,
                coalesce(covar_samp(ret, bench) / nullif((SELECT var_samp(bench) FROM bench), 0), 0) AS beta
              FROM played LEFT JOIN bench USING (date) GROUP BY 1, 2)""",
        extra=_blocks(RULES_MEASURED, source="frame_all")
        | {"bench": "SELECT date, qqq / nullif(soxx, 0) - 1 AS bench FROM context"},
    ),
)
_measure(
    "met4_cagr",
    {"cagr": MEASURES["cagr"], "cagr_pct": f"round(({MEASURES['cagr']}) * 100, 2)"},
    cagr=M.cagr,
    cagr_pct=lambda: F.round(M.cagr() * 100, 2),
)
_measure("met5_kelly", {"kelly": MEASURES["kelly"]}, kelly=M.kelly)
_measure("met6_trade_kelly", {"kelly_pct": MEASURES["kelly_pct"]}, kelly_pct=M.trade_kelly)
_measure(
    "met7_trade_counts",
    {n: MEASURES[n] for n in ("trades", "positive_trades", "pct_positive")}
    | {"pct_or_zero": f"coalesce({MEASURES['pct_positive']}, 0)"},
    trades=M.trades,
    positive_trades=M.positive_trades,
    pct_positive=M.pct_positive,
    pct_or_zero=lambda: M.pct_positive(0.0),
)
_measure(
    "met8_average_trades",
    {"avg_win_pct": MEASURES["avg_win"] + " * 100", "avg_loss_pct": MEASURES["avg_loss"] + " * 100"},
    avg_win_pct=lambda: M.average_win() * 100,
    avg_loss_pct=lambda: M.average_loss() * 100,
)
_measure(
    "met9_drawdown_and_equity",
    {"max_dd": MEASURES["max_dd"], "log_equity": log_sql(MEASURES["last_equity"])},
    max_dd=lambda: F.max("drawdown"),
    log_equity=log_last,
)
add(
    "met10_yearly",
    lambda s, d: M.yearly(_frame(s, d, *RULES_MEASURED)),
    sql(
        _measure_source,
        f"""SELECT symbol, signal, CAST(year(date) AS INTEGER) AS year,
          {r6("(arg_max(equity, i) - arg_min(equity, i)) / nullif(arg_min(equity, i), 0) * 100", "pnl_pct")},
          {r6("max(drawdown) * 100", "drawdown_pct")}, {MEASURES["trades"]} AS num_trades,
          {MEASURES["positive_trades"]} AS positive_trades FROM played GROUP BY 1, 2, 3""",
        extra=_measure_blocks,
    ),
)


def _summary(spark, sf):
    shown = M.summary(_frame(spark, sf, TIMED))
    return shown.withColumn("last_equity", log_growth("last_equity")).withColumnRenamed("last_equity", "log_equity")


add(
    "met11_run_summary",
    _summary,
    sql(
        "ind",
        f"""SELECT symbol, signal, {MEASURES["trades"]} AS trades, {MEASURES["positive_trades"]} AS positive_trades,
          {r6(MEASURES["pct_positive"], "pct_positive")}, {r6(MEASURES["avg_win"] + " * 100", "avg_win_pct")},
          {r6(MEASURES["avg_loss"] + " * 100", "avg_loss_pct")}, {six(log_sql(MEASURES["last_equity"]))} AS log_equity,
          {r6(MEASURES["max_dd"], "max_dd")}, {r6(MEASURES["cagr"], "cagr")}, {r6(MEASURES["sharpe"], "sharpe")},
          {r6(MEASURES["sortino"], "sortino")}, {r6(MEASURES["kelly_pct"], "kelly_pct")}
        FROM played GROUP BY 1, 2""",
        extra=_blocks([TIMED]),
    ),
)

# Sweeps. A trial's rows carry its own flags and limits; the machine is keyed by symbol and trial.
_TRIAL_KEYS = ("symbol", "run")
_RESULT = f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe_raw, 9) DESC NULLS LAST, run) AS place
  FROM (SELECT symbol, run, {log_sql(MEASURES["last_equity"])} AS log_pnl, {MEASURES["max_dd"]} AS max_dd,
          {MEASURES["trades"]} AS trades, coalesce({MEASURES["pct_positive"]}, @none) AS pct_positive,
          {MEASURES["cagr"]} AS cagr, {MEASURES["sharpe"]} AS sharpe_raw, {MEASURES["sortino"]} AS sortino
        FROM played GROUP BY 1, 2)"""
_RESULT_COLUMNS = (
    r6("log_pnl", "log_pnl")
    + f", {r6('max_dd', 'max_dd')}, trades, {r6('pct_positive', 'pct_positive')}, {r6('cagr', 'cagr')}, "
    + f"{r6('sharpe_raw', 'sharpe')}, {r6('sortino', 'sortino')}"
)


def _trial_blocks(open_ended: bool = False, none: str = "0") -> dict[str, str]:
    play = play_open("trial_rows", _TRIAL_KEYS) if open_ended else play_timed("trial_rows", keys=_TRIAL_KEYS)
    return {"play_rec": play, "played": played(open_ended, keys=_TRIAL_KEYS), "results": _RESULT.replace("@none", none)}


def _sweep_shown(results: DataFrame, *keys: str) -> DataFrame:
    table = SW.report(results).withColumn("pnl", log_growth("pnl")).withColumnRenamed("pnl", "log_pnl")
    return table.select("symbol", *keys, "log_pnl", "max_dd", "trades", "pct_positive", "cagr", "sharpe", "sortino")


_DAY_TRIALS = {
    "rows_in": rule_rows(_limits(TIMED)),
    "trials": "SELECT d AS days, p AS profit, d * 100 + p AS run FROM range(1, 11) AS a(d), range(1, 11) AS b(p) WHERE p <= d",
    "trial_rows": """SELECT symbol, run, i, date, close, track, buy, sell, odb, CAST(trials.days AS INTEGER) AS days,
      CAST(trials.profit AS INTEGER) AS profit FROM rows_in CROSS JOIN trials""",
}


def _day_sweep(spark, sf):
    rule = RU.RULES[TIMED]
    return SW.run_trials(_wide(spark, sf, [rule]), SW.day_grid(rule))


add(
    "swp1_holding_sweep",
    lambda s, d: _sweep_shown(_day_sweep(s, d), "days", "profit"),
    sql(
        "ind",
        f"SELECT symbol, days, profit, {_RESULT_COLUMNS} FROM results JOIN trials USING (run)",
        extra=_DAY_TRIALS | _trial_blocks(none="NULL"),
    ),
)


def _axis_trials(rule: str, axes, side: str, source: str) -> dict[str, str]:
    """Blocks giving one row per bar and threshold trial, every axis value in both directions, where the axis' gates are open."""
    columns = sorted({a.column for a in axes})
    gate = lambda a: f"{'NULL' if a.first_year is None else a.first_year}, {a.needs_volume}"
    grid = ", ".join(f"('{a.column}', {v!r}e0, {gate(a)})" for a in axes for v in a.values())
    long = " UNION ALL ".join(
        f"SELECT symbol, i, '{col}' AS indicator, CAST({col} AS DOUBLE) AS x FROM {source}" for col in columns
    )
    met = "coalesce(CASE WHEN condition = 'more' THEN x >= value ELSE x <= value END, false)"
    buy, sell = (f"buy AND {met}", "sell") if side == "buy" else ("buy", f"sell OR {met}")
    silent = ", ".join(f"'{s}'" for s in NO_VOLUME_SYMBOLS)
    return {
        "rows_in": rule_rows(_limits(rule), source=source),
        "trials": f"""SELECT *, row_number() OVER (ORDER BY indicator, condition, value) AS run FROM
          (VALUES {grid}) AS g(indicator, value, first_year, needs_volume), (VALUES ('less'), ('more')) AS d(condition)""",
        "values_in": long,
        "starts": f"SELECT symbol, year(min(date)) AS start_year FROM {source} GROUP BY 1",
        "trial_rows": f"""SELECT symbol, run, i, date, close, track, {buy} AS buy, {sell} AS sell, odb, days, profit
          FROM rows_in JOIN values_in USING (symbol, i) JOIN trials USING (indicator) JOIN starts USING (symbol)
          WHERE (first_year IS NULL OR start_year >= first_year) AND NOT (needs_volume AND symbol IN ({silent}))""",
    }


def _threshold(spark, sf, rule: str, axes, side: str):
    chosen = RU.RULES[rule]
    wide = _wide(spark, sf, [chosen], extra=sorted({a.column for a in axes}))
    return SW.run_trials(wide, SW.threshold_grid(chosen, axes, side), DEFAULT, axes)


_BUY_AXES = [SW.Axis("rsi2", 10, 50, 5), SW.Axis("rsi5_gold_breadth", 10, 90, 10)]
_SELL_AXES = [SW.Axis("rsi2", 50, 100, 5), SW.Axis("ibr", 0.1, 0.9, 0.1)]
_TRIAL_COLUMNS = ("side", "indicator", "condition", "value")
for _name, _rule, _side, _axes in (
    ("swp2_buy_threshold_sweep", TIMED, "buy", _BUY_AXES),
    ("swp3_sell_threshold_sweep", "rule20", "sell", _SELL_AXES),
    ("swp2_buy_threshold_sweep_open", OPEN, "buy", _BUY_AXES),
):
    add(
        _name,
        lambda s, d, rule=_rule, side=_side, axes=_axes: _sweep_shown(_threshold(s, d, rule, axes, side), *_TRIAL_COLUMNS),
        sql(
            "frame_all",
            f"SELECT symbol, '{_side}' AS side, indicator, condition, {r6('value', 'value')}, {_RESULT_COLUMNS} FROM results JOIN trials USING (run)",
            extra=_axis_trials(_rule, _axes, _side, "frame_all") | _trial_blocks(_rule == OPEN),
        ),
    )


def _search(spark, sf, side: str):
    rule = RU.RULES["rule20" if side == "sell" else TIMED]
    wide = _wide(spark, sf, [rule], extra=SW.search_columns(side))
    return SW.search(wide, rule, side=side)


for _name, _rule, _side in (("swp4_wide_buy_search", TIMED, "buy"), ("swp4_wide_sell_search", "rule20", "sell")):
    _axes = SW.search_axes(_side)
    add(
        _name,
        lambda s, d, side=_side: _sweep_shown(_search(s, d, side), *_TRIAL_COLUMNS),
        sql(
            "frame_all",
            f"""SELECT symbol, '{_side}' AS side, indicator, condition, {r6('value', 'value')}, {_RESULT_COLUMNS}
            FROM (SELECT *, row_number() OVER (PARTITION BY symbol, indicator
                    ORDER BY round(sharpe_raw, 9) DESC NULLS LAST, condition, value) AS best
                  FROM results JOIN trials USING (run)) WHERE best <= 3""",
            extra=_axis_trials(_rule, _axes, _side, "frame_all") | _trial_blocks(),
        ),
    )
# Axes behind gates, open and closed ones, on a panel that has symbols without volume.
_GATED_AXES = [
    SW.Axis("vfi10", -8, 8, 4, needs_volume=True),
    SW.Axis("rsi2_breadth", 10, 90, 20, first_year=2003),
    SW.Axis("rsi14_breadth", 20, 80, 20, first_year=1992),
]


def _gated(spark, sf):
    rule = RU.RULES[TIMED]
    wide = _wide(spark, sf, [rule], extra=[a.column for a in _GATED_AXES], bars=I.panel(spark, sf).filter(c("symbol") != "^VIX"))
    return SW.run_trials(wide, SW.threshold_grid(rule, _GATED_AXES), DEFAULT, _GATED_AXES)


add(
    "swp4_gated_axes",
    lambda s, d: _sweep_shown(_gated(s, d), *_TRIAL_COLUMNS),
    sql(
        "frame_all",
        f"SELECT symbol, 'buy' AS side, indicator, condition, {r6('value', 'value')}, {_RESULT_COLUMNS} FROM results JOIN trials USING (run)",
        source="trading_panel",
        extra=_axis_trials(TIMED, _GATED_AXES, "buy", "frame_all") | _trial_blocks(),
    ),
)
add(
    "swp5_best_trials",
    lambda s, d: _sweep_shown(SW.top_per(_day_sweep(s, d), 5, "symbol"), "days", "profit"),
    sql(
        "ind",
        f"SELECT symbol, days, profit, {_RESULT_COLUMNS} FROM results JOIN trials USING (run) WHERE place <= 5",
        extra=_DAY_TRIALS | _trial_blocks(none="NULL"),
    ),
)
add(
    "swp5_best_trials_overall",
    lambda s, d: _sweep_shown(SW.top(_day_sweep(s, d), 20), "days", "profit"),
    sql(
        "ind",
        f"""SELECT symbol, days, profit, {_RESULT_COLUMNS} FROM results JOIN trials USING (run)
        ORDER BY round(sharpe_raw, 9) DESC NULLS LAST, days, profit, symbol LIMIT 20""",
        extra=_DAY_TRIALS | _trial_blocks(none="NULL"),
    ),
)


# Boards over the ticker panel. The volatility level is context, never a traded symbol.
def _trading_panel(spark, sf) -> DataFrame:
    return I.panel(spark, sf).filter(c("symbol") != "^VIX")


def _scanned(spark, sf):
    rules = [RU.RULES[n] for n in RU.SCAN_RULES]
    bars = _trading_panel(spark, sf).filter(~c("symbol").isin(*BO.SCAN_EXCLUDED))
    return BO.scan(bars, rules, I.context(spark, sf))


_SCAN_TIMED = [n for n in RU.SCAN_RULES if RU.RULES[n].days > 0]
_SCAN_OPEN = [n for n in RU.SCAN_RULES if RU.RULES[n].days == 0]
_PAIRS = ", ".join(f"('{n}', '{x}')" for n in RU.SCAN_RULES for x in RU.RULES[n].symbols)
_NOTES = ", ".join(f"('{n}', '{RU.RULES[n].description}')" for n in RU.SCAN_RULES)
_BOARD_BLOCKS = {
    "rows_in": rule_rows(_limits(*_SCAN_TIMED), source="frame_all"),
    "rows_open": rule_rows(_limits(*_SCAN_OPEN), source="frame_all"),
    "play_rec": play_timed(),
    "open_rec": play_open("rows_open").replace("play_rec", "open_rec"),
    "played": played(),
    "open_played": played(True).replace("play_rec", "open_rec"),
}
_LAST_STATE = f"""SELECT symbol, signal, arg_max(tin, i) AS buy_now, arg_max(hold, i) AS holding, arg_max(tout, i) AS sell_now,
  CAST(max(days) AS BIGINT) AS days, CAST(max(profit) AS BIGINT) AS profit, arg_max(trade_pnl, i) * 100 AS trade_pnl_pct,
  {MEASURES["kelly_pct"]} AS kelly FROM @p GROUP BY 1, 2"""
_SCAN_BLOCKS = _BOARD_BLOCKS | {
    "scanned": f"""SELECT * FROM ({_LAST_STATE.replace("@p", "played")} UNION ALL {_LAST_STATE.replace("@p", "open_played")})
      SEMI JOIN (VALUES {_PAIRS}) AS u(signal, symbol) USING (signal, symbol)
      JOIN (VALUES {_NOTES}) AS n(signal, description) USING (signal)
      WHERE symbol NOT IN ('RSP', 'XLI', 'XLU', 'XLE', 'XLF')"""
}
add(
    "brd1_latest_scan",
    _scanned,
    sql(
        "frame_all",
        f"""SELECT symbol, signal, buy_now, holding, sell_now, days, profit, {r6("trade_pnl_pct", "trade_pnl_pct")},
          {r6("kelly", "kelly")}, description, '' AS verdict FROM scanned""",
        source="trading_panel",
        extra=_SCAN_BLOCKS,
    ),
)


def _alerts(spark, sf):
    lists = BO.alerts(_scanned(spark, sf))
    joined = {n: F.array_join(n, ",") for n in ("buy_signals", "sell_signals")}
    return lists.withColumns(joined)


def _listed(side: str, separator: str) -> str:
    entries = f"string_agg(signal || ' x' || {side}s, '{separator}' ORDER BY signal || ' x' || {side}s) FILTER ({side}s > 0)"
    return f"coalesce({entries}, '')"


add(
    "brd2_alerts",
    _alerts,
    sql(
        "frame_all",
        f"""SELECT {_listed("buy", ",")} AS buy_signals, {_listed("sell", ",")} AS sell_signals,
          CASE WHEN count(*) = 0 THEN 'No signals today'
          ELSE 'Buy signals: ' || {_listed("buy", ", ")} || '; sell signals: ' || {_listed("sell", ", ")} END AS message
        FROM (SELECT signal, count(*) FILTER (buy_now) AS buys, count(*) FILTER (sell_now) AS sells FROM scanned
              WHERE buy_now OR sell_now GROUP BY 1)""",
        source="trading_panel",
        extra=_SCAN_BLOCKS,
    ),
)


def _rule_board(spark, sf):
    rules = [RU.RULES[n] for n in RU.SCOREBOARD_RULES]
    board = BO.rule_board(_wide(spark, sf, rules, bars=_trading_panel(spark, sf)), rules)
    return board.withColumn("pnl", log_growth_of_gain()).withColumnRenamed("pnl", "log_pnl")


def log_growth_of_gain():
    """The board shows the gain over the start capital; its log needs the account again."""
    account = c("pnl") + DEFAULT.start_capital
    return F.when(account > 0, F.ln(account / DEFAULT.start_capital))


_BOARD_TIMED = [n for n in RU.SCOREBOARD_RULES if RU.RULES[n].days > 0]
_BOARD_OPEN = [n for n in RU.SCOREBOARD_RULES if RU.RULES[n].days == 0]
_SUBSCRIBED = ", ".join(f"('{n}', '{x}')" for n in RU.SCOREBOARD_RULES for x in RU.RULES[n].symbols)
_SCORE = f"""SELECT symbol, signal, bool_or(row(signal, symbol) IN (SELECT row(n, x) FROM (VALUES {_SUBSCRIBED}) AS u(n, x))) AS subscribe,
  {six(log_sql(f"(({MEASURES['last_equity']} - 15000) + 15000)"))} AS log_pnl, {r6(MEASURES["max_dd"], "max_dd")},
  {MEASURES["trades"]} AS trades, {r6(MEASURES["pct_positive"], "pct_positive")}, CAST(max(days) AS BIGINT) AS days,
  CAST(max(profit) AS BIGINT) AS profit FROM @p GROUP BY 1, 2"""
add(
    "brd3_rule_board",
    _rule_board,
    sql(
        "frame_all",
        _SCORE.replace("@p", "played") + " UNION ALL " + _SCORE.replace("@p", "open_played"),
        source="trading_panel",
        extra=_BOARD_BLOCKS
        | {
            "rows_in": rule_rows(_limits(*_BOARD_TIMED), source="frame_all"),
            "rows_open": rule_rows(_limits(*_BOARD_OPEN), source="frame_all"),
        },
    ),
)


def _symbol_board(spark, sf):
    rule = RU.RULES[RU.SYMBOL_BOARD_RULE]
    bars = _trading_panel(spark, sf).filter(~c("symbol").isin(*BO.SYMBOL_BOARD_EXCLUDED))
    board = BO.symbol_board(_wide(spark, sf, [rule], bars=bars), rule)
    return board.withColumn("pnl", log_growth("pnl")).withColumnRenamed("pnl", "log_pnl")


add(
    "brd4_symbol_board",
    _symbol_board,
    sql(
        "frame_all",
        f"""SELECT symbol, {six(log_sql(MEASURES["last_equity"]))} AS log_pnl, {r6(MEASURES["max_dd"], "max_dd")},
          {r6(MEASURES["cagr"], "cagr")}, {r6(MEASURES["sharpe"], "sharpe")}, {r6(MEASURES["sortino"], "sortino")}
        FROM played WHERE symbol <> 'RSP' GROUP BY 1""",
        source="trading_panel",
        extra=_blocks([RU.SYMBOL_BOARD_RULE], source="frame_all"),
    ),
)


def _snapshot(spark, sf):
    names = [*BO.SNAPSHOT_COLUMNS, *BO.SNAPSHOT_LEVELS]
    return BO.snapshot(with_indicators(I.bars(spark, sf), names, context=I.context(spark, sf), keep=()))


_moves = ", ".join(f"({x} / nullif({lag(x)}, 0) - 1) * 100 AS {x}_change_pct" for x in BO.SNAPSHOT_LEVELS)
_last_values = ", ".join(
    f"{six(f'arg_max_null({x}, i)')} AS {x}"
    for x in ("close", "ema8", "rsi2", "rsi5", "stoch", "rsi14_breadth", *[f"{x}_change_pct" for x in BO.SNAPSHOT_LEVELS])
)
add(
    "brd5_latest_snapshot",
    _snapshot,
    sql(
        "frame_all",
        f"""SELECT symbol, max(date) AS date, {_last_values}, {six("arg_max_null(volume_ema_diff, i) * 100")} AS volume_ema_diff_pct
        FROM (SELECT *, {_moves} FROM frame_all) GROUP BY 1""",
    ),
)
