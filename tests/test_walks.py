"""Runs walked from trade to trade against the same runs played by the machine."""

import numpy as np
import pytest

from quotemill.operators.machines import Run, Tally, TimedMachine
from quotemill.operators.walks import Flags, Series, next_in, walk
from quotemill.params import DEFAULT


def played(runs, close, track, buy, sell):
    machine, tally = TimedMachine(runs, DEFAULT), Tally(len(runs), DEFAULT)
    tally.push(machine.advance(close, track, np.arange(len(close)), buy, sell, np.zeros(len(close), bool)))
    return tally.result()


def walked(runs, close, track, buy, sell, base=None):
    n = len(close)
    series = Series(close, track, runs[0].is_long)
    base = np.ones(n, bool) if base is None else base
    buys = Flags(n, base, buy[base], len(runs))
    return walk(series, runs, buys, Flags(n, np.ones(n, bool), sell, len(runs)), DEFAULT)


@pytest.mark.parametrize("is_long", [True, False])
@pytest.mark.parametrize("seed", range(8))
def test_walk_equals_machine(seed, is_long):
    rng = np.random.default_rng(seed)
    n = [1, 2, 3, 40, 333, 700, 64, 65][seed]
    runs = [Run(d, p, is_long) for d in (1, 2, 7, 100) for p in (1, 3, 100)]
    close = np.round(100 * np.cumprod(1 + rng.normal(0, 0.02, n)), 1)
    track = np.concatenate([[np.nan], close[1:] / close[:-1] - 1]) * 3
    base = rng.random(n) < 0.6
    buy = (rng.random((n, len(runs))) < (0.05, 0.4, 1.0)[seed % 3]) & base[:, None]
    sell = rng.random((n, len(runs))) < (0.0, 0.1)[seed % 2]
    want, got = played(runs, close, track, buy, sell), walked(runs, close, track, buy, sell, base)
    assert set(got) == set(want)
    for name, values in want.items():
        np.testing.assert_allclose(got[name].astype(float), values.astype(float), rtol=1e-9, atol=1e-12, err_msg=name)


def test_shared_flags():
    """Runs that share their flags need no table of their own."""
    close = np.array([10.0, 11, 9, 12, 13, 8, 9, 10])
    track = np.concatenate([[np.nan], close[1:] / close[:-1] - 1])
    runs, n = [Run(d, 1) for d in (1, 2, 3)], len(close)
    base = np.array([1, 0, 1, 0, 0, 1, 1, 0], bool)
    sell = np.array([0, 0, 0, 1, 0, 0, 0, 0], bool)
    wide = [np.repeat(x[:, None], 3, axis=1) for x in (base, sell)]
    got = walk(Series(close, track, True), runs, Flags(n, base, None, 3), Flags(n, sell, None, 3), DEFAULT)
    for name, values in played(runs, close, track, *wide).items():
        np.testing.assert_allclose(got[name].astype(float), values.astype(float), rtol=1e-12, err_msg=name)


def test_what_cannot_be_walked():
    ok = np.array([np.nan, 0.1, -0.2])
    close = np.array([1.0, 1.1, 1.0])
    assert Series(close, ok, True).walkable and Series(close, ok, False).walkable
    assert not Series(close, np.array([np.nan, -1.0, 0.1]), True).walkable
    assert not Series(close, np.array([np.nan, 1.5, 0.1]), False).walkable
    assert not Series(close, np.array([np.nan, np.nan, 0.1]), True).walkable
    assert not Series(np.array([1.0, np.nan, 1.0]), ok, True).walkable
    assert not Series(np.array([1.0, 0.0, 1.0]), ok, True).walkable


def test_next_in():
    allowed = np.array([[0, 1], [1, 0], [0, 0]], bool)
    assert next_in(allowed).tolist() == [[1, 0], [1, 3], [3, 3], [3, 3]]
