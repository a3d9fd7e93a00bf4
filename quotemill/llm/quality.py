"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes some twenty numbers, taken from the whole text. Features are cut into quantile bins; boosting goes
round the features in turn and fits a shallow tree to the residuals of one feature at a time, so each feature ends up
with a lookup table over its bins. The pairs of features that explain most of what is left get tables over two features
in the same way. A score is the sum of table entries at the text's bins, through a logistic function; it is computed
by indexing the tables with whole columns of bins.

The model is fitted on the driver from numbers only, those of at most about `sample` labelled rows, drawn by a hash
of the id (the bound is in expectation). Features are computed once per document and stored; labels meet them by id.

Defined results: a null text is an empty text and gets a score as any other. Without labels of both kinds every score
is the share of label 1 (0.5 if there are none). Several labels for one id count as their rounded mean. Rows with a null id
are scored and never learned from. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import remainder, stored, texts

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "blank", "comma", "stop", "exclaim", "bars", "odd_signs", "other_signs",
    "beyond_ascii", "distinct", "top_word", "repeat_next", "same_length", "log_lines", "line_words", "repeat_lines", "capitals",
    "byte_entropy", "ends_signed", "sentence_words",
)
THRESHOLD = 0.3

_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_BLANK = np.array([9, 10, 11, 12, 13, 32])
_ODD = np.frombuffer(b"#%&$*^~<>{}\\", dtype=np.uint8)
_PLAIN = np.concatenate([np.arange(48, 58), np.arange(65, 91), np.arange(97, 123), _BLANK, np.frombuffer(b".,!|", dtype=np.uint8), _ODD, np.arange(128, 256)])


def features(raw: bytes) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    size = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = hist / size
    some = share[share > 0]
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    distinct, top = float(len(counts)), float(max(counts.values(), default=0))
    repeats = float(sum(map(eq, words, islice(words, 1, None))))
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = float((lengths[1:] == lengths[:-1]).sum())
    capitals = float(sum(map(bytes.isupper, words)))
    signed = float(sum(not (w[-1] in b".," or 48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] >= 128) for w in words))
    lines = [x for x in raw.split(b"\n") if x]
    count = max(n, 1)
    stops = max(int(hist[46]), 1)
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), (size - hist[_BLANK].sum()) / count, share[_UPPER].sum(), share[_DIGIT].sum(), share[_BLANK].sum(),
        share[44], share[46], share[33], share[124], share[_ODD].sum(), 1 - share[_PLAIN].sum() if raw else 0.0,
        share[128:].sum(), distinct / count, top / count, repeats / count, same / count, float(np.log1p(len(lines))),
        n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), capitals / count,
        float(-(some * np.log2(some)).sum()) if raw else 0.0, signed / count, n / stops,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x: the features) of every row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": [features(raw) for raw in pdf["raw"]]})

    return texts(docs).mapInPandas(each, "doc_id long, x array<double>")


def _best_tree(total: np.ndarray, weight: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """Values of a shallow tree over ordered bins: greedy cuts, each where it explains most."""
    bounds = [0, len(total)]
    g, h = np.concatenate(([0.0], np.cumsum(total))), np.concatenate(([0.0], np.cumsum(weight)))

    def gain(a: int, b: int) -> np.ndarray:
        cut = np.arange(a + 1, b)
        left, right = (g[cut] - g[a]) ** 2 / (h[cut] - h[a] + damp), (g[b] - g[cut]) ** 2 / (h[b] - h[cut] + damp)
        return left + right - (g[b] - g[a]) ** 2 / (h[b] - h[a] + damp)

    for _ in range(leaves - 1):
        best = max(((float(x.max()), a + 1 + int(x.argmax())) for a, b in zip(bounds, bounds[1:]) if b - a > 1 for x in [gain(a, b)]), default=(0.0, 0))
        if best[0] <= 1e-12:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(total))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + damp)
    return out


class Additive:
    """Tables over bins of single features and of pairs."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 150, pairs: int = 8, rate: float = 0.1, leaves: int = 4, damp: float = 1.0):
        self.bins, self.pair_bins, self.rounds, self.pairs = bins, pair_bins, rounds, pairs
        self.rate, self.leaves, self.damp = rate, leaves, damp
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: np.ndarray = np.zeros((0, 0))
        self.pair_tables: dict[tuple[int, int], np.ndarray] = {}
        self.base = 0.0

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        mean = float(y.mean()) if len(y) else 0.5
        if not len(y) or not 0 < mean < 1:
            self.base = 50.0 if mean == 1 else -50.0 if mean == 0 else 0.0
            return self
        self.base = float(np.log(mean / (1 - mean)))

        def cut(bins: int) -> list[np.ndarray]:
            return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]

        self.edges, self.coarse = cut(self.bins), cut(self.pair_bins)
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        margin = np.full(len(y), self.base)
        self.tables = np.zeros((x.shape[1], self.bins))
        for _ in range(self.rounds):
            for j in range(x.shape[1]):
                p = 1 / (1 + np.exp(-margin))
                total = np.bincount(fine[:, j], y - p, minlength=self.bins)
                weight = np.bincount(fine[:, j], p * (1 - p), minlength=self.bins)
                tree = self.rate * _best_tree(total, weight, self.leaves, self.damp)
                self.tables[j] += tree
                margin += tree[fine[:, j]]
        # Pairs by what their residuals, as they now stand, explain.
        side = self.pair_bins

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-margin))
            at = coarse[:, i] * side + coarse[:, j]
            return at, np.bincount(at, y - p, minlength=side * side), np.bincount(at, p * (1 - p), minlength=side * side)

        def worth(pair: tuple[int, int]) -> float:
            _, total, weight = sums(*pair)
            return float((total**2 / (weight + self.damp)).sum())

        chosen = sorted(combinations(range(x.shape[1]), 2), key=worth, reverse=True)[: self.pairs]
        self.pair_tables = {pair: np.zeros(side * side) for pair in chosen}
        for _ in range(self.rounds):
            for (i, j), table in self.pair_tables.items():
                at, total, weight = sums(i, j)
                # A tree of depth two: the first feature is cut, then the second in either part.
                grid, load = total.reshape(side, side), weight.reshape(side, side)
                first = _best_tree(grid.sum(1), load.sum(1), 2, self.damp)
                parts = np.concatenate(([0], np.nonzero(np.diff(first))[0] + 1, [side]))
                step = np.zeros((side, side))
                for a, b in zip(parts, parts[1:]):
                    step[a:b] = _best_tree(grid[a:b].sum(0), load[a:b].sum(0), 2, self.damp)
                step = self.rate * step.ravel()
                table += step
                margin += step[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        if self.edges:
            fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
            margin += self.tables[np.arange(x.shape[1]), fine].sum(axis=1)
            for (i, j), table in self.pair_tables.items():
                margin += table[coarse[:, i] * self.pair_bins + coarse[:, j]]
        return 1 / (1 + np.exp(-margin))


def fit(rows: DataFrame, labels: DataFrame, sample: int = 20_000) -> Additive:
    """Fit on feature rows (doc_id, x) that may be learned from and labels (doc_id, quality)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("quality"))
    share = min(1.0, sample / max(marks.count(), 1))
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # Sorted, so that the fit does not depend on the order of rows.
    found = rows.where("doc_id IS NOT NULL").join(drawn, "doc_id").select("doc_id", "x", "quality").toPandas()
    found = found.drop_duplicates("doc_id").sort_values("doc_id")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    return Additive().fit(x, found["quality"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = stored(featured(docs))
    model = fit(rows.where(remainder(5) != 0), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), sample)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(held.value.score(np.array(x.tolist(), dtype=float).reshape(len(x), len(FEATURES))))

    score = F.pandas_udf(each, "double")
    scored = rows.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
