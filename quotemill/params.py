"""Settings that carry meaning. Passed explicitly, never read from module globals."""

from __future__ import annotations

from dataclasses import dataclass

# Ticker symbols that trade under a suffixed name in the bar feed.
FUTURES = ("NQ", "ES", "RTY", "CL", "GC", "SI", "HG", "NG")
CURRENCIES = ("GBPUSD",)

# Symbols whose volume carries no information, so VFI sweeps skip them.
NO_VOLUME_SYMBOLS = ("NQ", "ES", "GC", "SI", "HG", "RTY", "YM", "CL", "SOXX", "FXI")

# Level columns and the ticker each one is the close of.
LEVEL_TICKERS = {
    "vix": "^VIX",
    "qqq": "QQQ",
    "soxx": "SOXX",
    "iwm": "IWM",
    "uvxy": "UVXY",
    "sqqq": "SQQQ",
    "spy": "SPY",
}

# Ratio columns, each the close of the ticker over the close of SPY.
RATIO_TICKERS = {
    "breadth": "RSP",
    "risk_breadth": "QQQ",
    "semis_breadth": "SMH",
    "financials_breadth": "XLF",
    "energy_breadth": "XLE",
    "utilities_breadth": "XLU",
    "industrials_breadth": "XLI",
    "iwm_breadth": "IWM",
    "bond_breadth": "TLT",
    "gold_breadth": "GLD",
}

# RSI periods taken of each ratio column.
CONTEXT_RSI_PERIODS = {
    "breadth": (2, 5, 14),
    "risk_breadth": (2, 5, 14),
    "semis_breadth": (2, 5, 14),
    "financials_breadth": (5, 14),
    "energy_breadth": (5, 14),
    "utilities_breadth": (5, 14),
    "industrials_breadth": (5, 14),
    "gold_breadth": (2, 5, 14),
    "bond_breadth": (2, 5, 14),
}


@dataclass(frozen=True)
class Params:
    """Strategy constants plus the physical limits the joins and machines respect."""

    # Strategy constants.
    leverage: float = 3.0
    stop_loss: float = 0.15
    start_capital: float = 15000.0
    volatility_period: int = 5
    volatility_threshold: float = 0.1
    volume_ema_threshold: float = 0.6
    volume_ema_threshold_buy: float = 0.15
    rsi2_buy: float = 15.0
    rsi5_buy: float = 35.0
    rsi2_sell: float = 95.0
    rsi5_sell: float = 70.0
    max_decline: float = 0.04
    down_days: int = 3
    exit_on_volatility: bool = True
    monday_buy: bool = True
    low_volume_buy: bool = True
    use_proxy: bool = False
    split_long: bool = False
    proxy_column: str = "soxx"
    periods_per_year: int = 252

    # Open-ended runs played together by one sweep task, and timed runs walked together; bounds their tables.
    runs_per_task: int = 128
    runs_per_walk: int = 1024
    # Bars a machine plays at once; bounds the bars x runs arrays a task holds.
    bars_per_step: int = 2048


DEFAULT = Params()
