"""The everyday jobs, put together from the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from quotemill.operators import boards, sweeps
from quotemill.operators.context import CONTEXT_COLUMNS, CONTEXT_RSIS, build_context, with_context_rsis
from quotemill.operators.indicators import with_indicators
from quotemill.operators.metrics import summary, yearly
from quotemill.operators.positions import positions
from quotemill.operators.relational import drop_null_close, keep_sessions
from quotemill.operators.rules import Rule, with_rules
from quotemill.params import DEFAULT, Params
from quotemill.session import write_table
from quotemill.sources.bars import CONTEXT_TICKERS, bulk_bars


def _session_panel(
    bars: DataFrame, calendar: DataFrame, symbols: Sequence[str], years: int, today: dt.date | None, params: Params
) -> DataFrame:
    """Session bars under plain names; a requested symbol without bars raises."""
    panel = keep_sessions(drop_null_close(bulk_bars(bars, [*dict.fromkeys([*symbols, *CONTEXT_TICKERS])], years, today)), calendar, params)
    found = {r.symbol for r in panel.filter(panel.symbol.isin(*symbols)).select("symbol").distinct().collect()}
    if missing := [s for s in symbols if s not in found]:
        raise ValueError(f"no bars of {missing} in these years")
    return panel


def _context(panel: DataFrame, names: Sequence[str], params: Params) -> DataFrame | None:
    """Context of a panel, with the ratio RSIs only where a name asks for them; stored, as all symbols read it."""
    names = [*names, *([params.proxy_column] if params.use_proxy else [])]
    if not any(n in CONTEXT_COLUMNS for n in names):
        return None
    context = build_context(panel)
    if any(n in CONTEXT_RSIS for n in names):
        context = with_context_rsis(context)
    return panel.sparkSession.read.parquet(write_table(context, "context"))


def _wide(panel: DataFrame, symbols: Sequence[str], rules: Sequence[Rule], params: Params, extra: Sequence[str] = ()) -> DataFrame:
    """The rule frame of some of a panel's symbols."""
    needs = [n for r in rules for n in r.needs]
    own = panel.filter(panel.symbol.isin(*symbols))
    return with_rules(own, rules, params, _context(panel, [*needs, *extra], params), extra)


def backtest(
    bars: DataFrame,
    calendar: DataFrame,
    symbol: str,
    rule: Rule,
    years: int,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> dict[str, DataFrame]:
    """One rule on one symbol: its position frame, its summary and its years."""
    panel = _session_panel(bars, calendar, [symbol], years, today, params)
    frame = positions(_wide(panel, [symbol], [rule], params), [rule], params)
    frame = panel.sparkSession.read.parquet(write_table(frame, "positions"))
    return {"positions": frame, "summary": summary(frame, params=params), "yearly": yearly(frame)}


def search(
    bars: DataFrame,
    calendar: DataFrame,
    symbols: Sequence[str],
    rule: Rule,
    years: int,
    today: dt.date | None = None,
    side: str = "buy",
    params: Params = DEFAULT,
    **switches,
) -> DataFrame:
    """Wide threshold search of one rule over several symbols, best trials first."""
    panel = _session_panel(bars, calendar, symbols, years, today, params)
    columns = sweeps.search_columns(side, **switches)
    wide = _wide(panel, symbols, [rule], params, columns)
    best = sweeps.report(sweeps.search(wide, rule, params, side, **switches))
    return best.orderBy(*sweeps.rank_key(), "symbol")


def scan(
    bars: DataFrame,
    calendar: DataFrame,
    symbols: Sequence[str],
    rules: Sequence[Rule],
    years: int = 1,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """What fires on the latest bar of the given symbols; context-only symbols are left out."""
    panel = _session_panel(bars, calendar, symbols, years, today, params)
    own = [s for s in symbols if s not in boards.SCAN_EXCLUDED]
    needs = [n for r in rules for n in r.needs]
    return boards.scan(panel.filter(panel.symbol.isin(*own)), rules, _context(panel, needs, params), params)


def alerts(scanned: DataFrame) -> DataFrame:
    """The buy and sell lists of a scan, and the message that says them."""
    return boards.alerts(scanned)


def hold_sweep(
    bars: DataFrame,
    calendar: DataFrame,
    symbol: str,
    rule: Rule,
    years: int,
    max_days: int = 10,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """One rule on one symbol under every pair of holding limits, best first."""
    panel = _session_panel(bars, calendar, [symbol], years, today, params)
    results = sweeps.run_trials(_wide(panel, [symbol], [rule], params), sweeps.day_grid(rule, max_days), params)
    return sweeps.report(results).orderBy(*sweeps.rank_key())


def rule_board(
    bars: DataFrame,
    calendar: DataFrame,
    symbol: str,
    rules: Sequence[Rule],
    years: int,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """Every rule on one symbol."""
    panel = _session_panel(bars, calendar, [symbol], years, today, params)
    return boards.rule_board(_wide(panel, [symbol], rules, params), rules, params)


def symbol_board(
    bars: DataFrame,
    calendar: DataFrame,
    symbols: Sequence[str],
    rule: Rule,
    years: int,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """One rule on every symbol; context-only symbols are left out."""
    panel = _session_panel(bars, calendar, symbols, years, today, params)
    own = [s for s in symbols if s not in boards.SYMBOL_BOARD_EXCLUDED]
    return boards.symbol_board(_wide(panel, own, [rule], params), rule, params)


def snapshot(
    bars: DataFrame,
    calendar: DataFrame,
    symbols: Sequence[str],
    years: int = 1,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """Latest price, indicators and moves of the context tickers, per symbol."""
    panel = _session_panel(bars, calendar, symbols, years, today, params)
    names = [*boards.SNAPSHOT_COLUMNS, *boards.SNAPSHOT_LEVELS]
    own = panel.filter(panel.symbol.isin(*symbols))
    return boards.snapshot(with_indicators(own, names, params, _context(panel, names, params), keep=()))
