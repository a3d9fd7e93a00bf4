"""Per-symbol window expressions. Every function shares one window, hence one shuffle and sort.

A bar table has one row per symbol and session, so a window partition is never longer than the
trading calendar, whatever share of the raw records its symbol holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quotemill.functions.scalars import div

KEYS: tuple[str, ...] = ("symbol",)
# Weights below this share of the newest one cannot change a double.
NEGLIGIBLE = 1e-17
# Sums over more rows are differences of running sums; extremes and deviations over more are put together. As measured:
# a running sum costs as much as a frame of some 16 rows, a lookup of an earlier row as much as 6 rows of a frame.
DIRECT_FRAME, DIRECT_ROLLED, LOOKUP = 16, 64, 6
# Values are split at multiples of 1 / FINE for exact sums.
FINE = float(1 << 20)


_specs: dict[tuple, WindowSpec] = {}
_noted: list[list[int]] = []


@contextmanager
def reaches() -> Iterator[list[int]]:
    """Collects how many rows back each window expression built inside looks."""
    found: list[int] = []
    _noted.append(found)
    try:
        yield found
    finally:
        _noted.remove(found)


def _note(rows: int) -> None:
    for found in _noted:
        found.append(rows)


def ordered(keys: Sequence[str] = KEYS, rows: int | None = None) -> WindowSpec:
    """The window of a series in date order, or its last `rows` rows; built once per application."""
    application = SparkSession.active().sparkContext.applicationId
    key = (application, tuple(keys), rows)
    if key not in _specs:
        spec = Window.partitionBy(*keys).orderBy("date")
        _specs[key] = spec if rows is None else spec.rowsBetween(-(rows - 1), 0)
    return _specs[key]


def lag(c, k: int = 1, keys: Sequence[str] = KEYS) -> Column:
    _note(k)
    return F.lag(c, k).over(ordered(keys))


def diff(c: Column, k: int = 1) -> Column:
    return c - lag(c, k)


def pct_change(c: Column, k: int = 1) -> Column:
    return div(c, lag(c, k)) - 1


def rolling(c: Column, n: int, agg: Callable[[Column], Column], keys: Sequence[str] = KEYS) -> Column:
    """Aggregate of the last n rows, NULL until n values are present.

    Spark walks a frame anew for every row, so this costs n values a row: see `rolling_sum` and `with_rolling` for long ones.
    """
    _note(n - 1)
    frame = ordered(keys, n)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def rolling_sum(c: Column, n: int, keys: Sequence[str] = KEYS) -> Column:
    """Sum of the last n rows, NULL until n values are present; the cost of a row does not depend on n.

    A long sum is what the series has summed up to now less what it had n rows before. Each value is split into
    a multiple of 2^-20, whose sums are exact while they stay below 2^33, and a rest too small to lose anything, so
    the difference is as good as a sum of the n values.
    """
    if n <= DIRECT_FRAME:
        return rolling(c, n, F.sum, keys)
    _note(n - 1)
    now = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    then = ordered(keys).rowsBetween(Window.unboundedPreceding, -n)
    coarse = F.rint(c * FINE) / FINE

    def gained(x: Column) -> Column:
        return F.sum(x).over(now) - F.coalesce(F.sum(x).over(then), F.lit(0.0))

    present = F.count(c).over(now) - F.count(c).over(then)
    return F.when(present == n, gained(coarse) + gained(c - coarse))


def rolling_mean(c: Column, n: int, keys: Sequence[str] = KEYS) -> Column:
    return rolling_sum(c, n, keys) / n


def rolling_min(c: Column, n: int) -> Column:
    return rolling(c, n, F.min)


def rolling_max(c: Column, n: int) -> Column:
    return rolling(c, n, F.max)


def rolling_std(c: Column, n: int) -> Column:
    return rolling(c, n, F.stddev_samp)


@dataclass(frozen=True)
class Rolled:
    """A long rolling extreme or deviation of a column, put together from short frames that end some rows apart.

    `kind` is min, max, std (of a sample) or std_pop. The n rows are `count` stretches of `size` rows and one of `rest`;
    each is aggregated once per row, in a frame of its own, and looked up where it ends. So a row costs some 5 * sqrt(n) reads.
    Deviations combine the stretches' variances and the distances of their means from the newest one's, so nothing large
    cancels.
    """

    kind: str
    source: str
    n: int

    @property
    def size(self) -> int:
        return self.n if self.n <= DIRECT_ROLLED else math.isqrt(LOOKUP * self.n - 1) + 1

    @property
    def count(self) -> int:
        return self.n // self.size

    @property
    def rest(self) -> int:
        return self.n % self.size

    def stretches(self) -> dict[str, tuple[str, Callable[[], Column]]]:
        """Columns that `column` reads: name -> (source, expression)."""
        out = {}
        for size in dict.fromkeys(x for x in (self.size, self.rest) if x):
            for part, agg in self._parts(size).items():
                out[part] = (self.source, lambda agg=agg, size=size: rolling(F.col(self.source), size, agg))
        return out

    def _parts(self, size: int) -> dict[str, Callable[[Column], Column]]:
        if self.kind in ("min", "max"):
            return {f"_{self.kind}{size}_{self.source}": F.min if self.kind == "min" else F.max}
        return {f"_mean{size}_{self.source}": F.avg, f"_var{size}_{self.source}": F.var_pop}

    def column(self) -> Column:
        """The value over n rows, NULL until n values are present."""
        at = [(self.size, k * self.size) for k in range(self.count)]
        at += [(self.rest, self.count * self.size)] * bool(self.rest)
        found = [(size, [lag(name, back) if back else F.col(name) for name in self._parts(size)]) for size, back in at]
        whole = found[0][1][0].isNotNull()
        for _, part in found[1:]:
            whole = whole & part[0].isNotNull()
        if self.kind in ("min", "max"):
            values = [part[0] for _, part in found]
            merge = F.least if self.kind == "min" else F.greatest
            return F.when(whole, merge(*values) if len(values) > 1 else values[0])
        first = found[0][1][0]
        mean = _added([(part[0] - first) * size for size, part in found]) / self.n
        apart = _added([(part[1] + F.pow(part[0] - first - mean, F.lit(2.0))) * size for size, part in found])
        return F.when(whole, F.sqrt(apart / (self.n - (self.kind == "std"))))


def _added(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def with_rolling(df: DataFrame, columns: dict[str, Rolled]) -> DataFrame:
    """Add rolling extremes and deviations of any length: two passes over the sorted series, whatever n."""
    stretches = {name: build for r in columns.values() for name, (_, build) in r.stretches().items()}
    df = df.withColumns({name: build() for name, build in stretches.items()})
    return df.withColumns({name: r.column() for name, r in columns.items()}).drop(*stretches)


def rolling_values(c: Column, n: int) -> Column:
    """The last n values, oldest first, for an arbitrary function of the window."""
    return rolling(c, n, F.collect_list)


def running_max(c: Column, keys: Sequence[str] = KEYS) -> Column:
    return F.max(c).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))


def mean_abs_deviation(values: Column, n: int) -> Column:
    """Mean distance of a window's values from their own mean."""
    zero = F.lit(0.0)
    mean = F.aggregate(values, zero, lambda acc, x: acc + x) / n
    return F.aggregate(F.transform(values, lambda x: F.abs(x - mean)), zero, lambda acc, x: acc + x) / n


def ewm_reach(span: int) -> int:
    """Rows back whose weight can still change a double in `with_ewm`."""
    decay, reach, rows = 1.0 - 2.0 / (span + 1), 1, 0
    while decay**reach > NEGLIGIBLE:
        rows += max(k * reach for k in range(1, 8) if decay ** (k * reach) > NEGLIGIBLE)
        reach *= 8
    return rows


def with_ewm(df: DataFrame, columns: dict[str, str], span: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted means with weights normalised by their sum; `columns` maps output names to input names.

    The sum over the last 8m rows is eight sums over m rows, each decayed by how far back it ends, so
    two or three lag passes over the one sorted window reach every row that can still matter.
    """
    decay = 1.0 - 2.0 / (span + 1)
    parts = {f"_{o}_num": f"coalesce({i}, 0D)" for o, i in columns.items()}
    parts |= {f"_{o}_den": f"CAST({i} IS NOT NULL AS DOUBLE)" for o, i in columns.items()}
    df = df.withColumns({p: F.expr(text) for p, text in parts.items()})
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY date)"
    reach = 1
    while decay**reach > NEGLIGIBLE:
        steps = [k * reach for k in range(1, 8) if decay ** (k * reach) > NEGLIGIBLE]
        # As SQL text: one call per column where the column API takes five per step.
        terms = {p: [f"lag({p}, {k}, 0D) {over} * {decay**k!r}D" for k in steps] for p in parts}
        df = df.withColumns({p: F.expr(" + ".join([p, *t])) for p, t in terms.items()})
        reach *= 8
    return df.withColumns({o: F.expr(f"try_divide(_{o}_num, _{o}_den)") for o in columns}).drop(*parts)
