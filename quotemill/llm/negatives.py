"""Hard-negative mining with score bounds along spanning trees of anchors.

Vectors become whole numbers, floor(scale * x), and a score is their inner product, so scores are exact. The anchors of one
label form blocks of about `BLOCK`; each block gets a minimum spanning tree by Euclidean distance. A block meets the rows
in chunks of about `CHUNK`: the tree's root is scored with every row of the chunk; below it, a row's score at an anchor
lies within its interval at the parent, widened by edge distance times the row's norm. Only rows whose interval
can matter are scored anew, the others keep their interval for the anchors below:

* positives: rows of the anchor's label whose upper bound reaches the k-th largest lower bound in the chunk;
* negatives: rows of another label whose interval overlaps the score window of one of the anchor's positives.

Each chunk gives its best few rows per anchor (and positive), which are merged by rank. Blocks and chunks meet in cells
of one chunk and up to `FAN` blocks: what a task holds is bounded by these three, whatever the share of a label. Anchors
are a stated query set against all rows; every row is met, none is sampled. Bounds only save scoring: they widen
by the edge, so they are tight among copies and near copies, and prune next to nothing among independent directions.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part. Rows repeated
whole count once; other rows of one id are rows of their own, in the order of a hash after the id. Vectors of different
lengths never meet. An anchor without positives, or a positive without negatives in its window, gives no rows, and so does
an empty table. Components from 2^20 on raise, since scores would not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import stored
from quotemill.session import ship_package

#: Anchors of a block, rows of a chunk, and blocks that meet a chunk in one task; in expectation, as hashes deal them out.
BLOCK, CHUNK, FAN = 256, 4096, 16
#: No component may reach this: 2^28 after scaling, so that 128 of them still fit 64 bits squared and summed.
LARGEST = 1 << 28


def whole(embedding: pd.Series, scale: int) -> list[bytes]:
    """floor(scale * x) of each vector, as 32-bit numbers."""
    out = []
    for x in embedding:
        v = np.floor(scale * np.asarray(x, dtype=np.float64))
        if v.size and (np.abs(v).max() >= LARGEST or v.size * np.abs(v).max() ** 2 >= 2.0**63):
            raise ValueError("components are too large for scores of 64 bits")
        out.append(v.astype(np.int32).tobytes())
    return out


def vectors(table: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, dim, row, vec) of every row that takes part; `row` tells the rows of one id apart."""
    ship_package(table.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(whole(x, scale), dtype=object)

    pack = F.pandas_udf(run, "binary")
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    used = table.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    used = used.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    used = used.select("vec_id", "label", F.size("embedding").alias("dim"), pack("embedding").alias("vec"))
    return used.distinct().withColumn("row", F.xxhash64("vec_id", "label", "vec"))


def spanning_tree(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (parents first), parent's place in that order (-1: root) and edge length of a minimum spanning tree."""
    n = len(vecs)
    points = vecs.astype(np.float64)
    square = (points * points).sum(axis=1)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    # Prim's algorithm: the nearest point outside the tree joins it, tied to its nearest point inside.
    best, through, free = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k] = at
        free[at] = False
        away = np.maximum(square + square[at] - 2 * (points @ points[at]), 0.0)
        closer = free & (away < best)
        best[closer], through[closer] = away[closer], k
        if k + 1 < n:
            at = int(np.argmin(np.where(free, best, np.inf)))
            parent[k + 1] = through[at]
            gap = points[at] - points[order[through[at]]]
            edge[k + 1] = np.sqrt((gap * gap).sum())
    return order, parent, edge


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are whole numbers below 2^53, else in integers."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    bound = rows.shape[1] * float(np.abs(rows).max()) * float(np.abs(anchor).max())
    kind = np.float64 if bound < 2.0**52 else np.int64
    return (rows.astype(kind, copy=False) @ anchor.astype(kind, copy=False)).astype(np.int64)


class Chunk:
    """Rows of one chunk as arrays."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.ids, self.rows, self.labels = (pdf[c].to_numpy(np.int64) for c in ("vec_id", "row", "label"))
        self.vecs = np.frombuffer(b"".join(pdf["vec"]), np.int32).reshape(len(pdf), dim).astype(np.float64)
        self.norms = np.sqrt((self.vecs * self.vecs).sum(axis=1))


def walk(block, chunk: Chunk, wanted, tally: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of a block, the rows of a chunk that `wanted(anchor, low, high)` asks for, with their scores.

    `tally`, if given, counts the pairs and those scored.
    """
    dim = chunk.vecs.shape[1]
    vecs = np.frombuffer(block.vecs, np.int32).reshape(len(block.ids), dim).astype(np.float64)
    low = np.empty((len(vecs), len(chunk.ids)))
    high = np.empty_like(low)
    for k, (parent, edge) in enumerate(zip(block.parent, block.edge, strict=True)):
        if parent < 0:
            low[k], high[k] = -np.inf, np.inf
            at = np.arange(len(chunk.ids))
        else:
            # The slack covers the rounding of distances and norms.
            reach = edge * chunk.norms * (1 + 1e-9) + 1e-3
            np.subtract(low[parent], reach, out=low[k])
            np.add(high[parent], reach, out=high[k])
            at = np.flatnonzero(wanted(k, low[k], high[k]))
        found = scores(chunk.vecs[at], vecs[k])
        low[k, at] = high[k, at] = found
        if tally is not None:
            tally["pairs"] = tally.get("pairs", 0) + len(chunk.ids)
            tally["scored"] = tally.get("scored", 0) + len(at)
        yield k, at, found


def _sizes(rows: DataFrame, anchors: DataFrame, keys: list[str], block: int, chunk: int) -> DataFrame:
    """Per group: n_chunks and n_blocks, at least one each."""
    n = lambda name, size: F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)
    return rows.groupBy(*keys).agg(n("n_chunks", chunk)).join(anchors.groupBy(*keys).agg(n("n_blocks", block)), keys)


def _dealt(column: str, into: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(13)), into).cast("int")


def blocks(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per block of anchors: its tree, parents first, with ids, row keys, vectors and windows.

    `anchors` may carry `positives`: an array of (score, id, row) each.
    """
    with_windows = "positives" in anchors.columns

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"]).reset_index(drop=True)
        vecs = np.frombuffer(b"".join(pdf["vec"]), np.int32).reshape(len(pdf), int(key[0]))
        order, parent, edge = spanning_tree(vecs)
        out = {
            "dim": key[0], "label": key[1], "block": key[2], "ids": [pdf["vec_id"].to_numpy()[order]], "rows": [pdf["row"].to_numpy()[order]],
            "vecs": [vecs[order].tobytes()], "parent": [parent], "edge": [edge],
        }
        if with_windows:
            held = [pdf["positives"][i] for i in order]
            out |= {"n_positives": [[len(p) for p in held]]} | {name: [[x[name] for p in held for x in p]] for name in ("p_score", "p_id", "p_row")}
        return pd.DataFrame(out)

    schema = "dim int, label long, block int, ids array<long>, rows array<long>, vecs binary, parent array<long>, edge array<double>"
    if with_windows:
        schema += ", n_positives array<int>, p_score array<long>, p_id array<long>, p_row array<long>"
    dealt = anchors.join(sizes, ["dim", "label"]).withColumn("block", _dealt("row", F.col("n_blocks"))).drop("n_blocks", "n_chunks")
    return dealt.groupBy("dim", "label", "block").applyInPandas(build, schema)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], each, schema: str) -> DataFrame:
    """`each(block, chunk)` over every block (left) and chunk (right) of a cell; rows of `schema`."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(rows):
            chunk = Chunk(rows, int(key[0]))
            for block in some.itertuples(index=False):
                out += each(block, chunk)
        return pd.DataFrame(out, columns=names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _best(at: np.ndarray, found: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Places in `at` from the highest score on, ties by id, then row."""
    return np.lexsort((chunk.rows[at], chunk.ids[at], -found))


def positives(rows: DataFrame, anchors: DataFrame, count: int, block: int, chunk: int, fan: int) -> DataFrame:
    """(a_row, p_score, p_id, p_row): the first `count` other rows of each anchor's label."""
    sizes = _sizes(rows, anchors, ["dim", "label"], block, chunk)

    def each(b, c: Chunk) -> list[tuple]:
        def wanted(k, low, high):
            other = c.rows != b.rows[k]
            low = np.where(other, low, -np.inf)
            least = np.partition(low, -count)[-count] if len(low) > count else -np.inf
            return other & (high >= least)

        out = []
        for k, at, found in walk(b, c, wanted):
            other = c.rows[at] != b.rows[k]
            at, found = at[other], found[other]
            first = _best(at, found, c)[:count]
            out += [(b.rows[k], *x) for x in zip(found[first].tolist(), c.ids[at[first]].tolist(), c.rows[at[first]].tolist(), strict=True)]
        return out

    group = (F.col("block") / fan).cast("int")
    left = blocks(anchors, sizes).join(sizes.drop("n_blocks"), ["dim", "label"])
    left = left.select("*", group.alias("team"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("part")).drop("n_chunks")
    teams = F.sequence(F.lit(0), ((F.col("n_blocks") - 1) / fan).cast("int"))
    right = rows.join(sizes, ["dim", "label"]).select("dim", "label", "vec_id", "row", "vec", _dealt("row", F.col("n_chunks")).alias("part"), F.explode(teams).alias("team"))
    met = _meet(left, right, ["dim", "label", "part", "team"], each, "a_row long, p_score long, p_id long, p_row long")
    first = Window.partitionBy("a_row").orderBy(F.desc("p_score"), "p_id", "p_row")
    return met.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= count).drop("nth")


def negatives(rows: DataFrame, anchors: DataFrame, count: int, window: tuple[int, int], block: int, chunk: int, fan: int) -> DataFrame:
    """(a_id, a_row, p_score, p_id, p_row, n_score, n_id, n_row): the first `count` rows of another label in each window.

    `anchors` carry their positives. A window reaches from window[0] to window[1] hundredths of the positive's score.
    """
    low_part, high_part = window

    def each(b, c: Chunk) -> list[tuple]:
        other = c.labels != b.label
        ends = np.cumsum(b.n_positives)
        score = np.array(b.p_score, np.int64)
        # Whole numbers n with low * p <= 100 * n <= high * p.
        floor, ceiling = -((-low_part * score) // 100), (high_part * score) // 100

        def span(k):
            return range(int(ends[k] - b.n_positives[k]), int(ends[k]))

        def wanted(k, low, high):
            hit = np.zeros(len(low), bool)
            for w in span(k):
                hit |= (high >= floor[w]) & (low <= ceiling[w])
            return hit & other

        out = []
        for k, at, found in walk(b, c, wanted):
            keep = other[at]
            at, found = at[keep], found[keep]
            place = _best(at, found, c)
            at, found = at[place], found[place]
            for w in span(k):
                begin, end = np.searchsorted(-found, [-ceiling[w], -floor[w] + 1])
                for x in range(begin, min(end, begin + count)):
                    out.append((int(b.ids[k]), int(b.rows[k]), int(score[w]), int(b.p_id[w]), int(b.p_row[w]), int(found[x]), int(c.ids[at[x]]), int(c.rows[at[x]])))
        return out

    by_label = _sizes(anchors, anchors, ["dim", "label"], block, chunk)
    made = blocks(anchors, by_label)
    teams = by_label.groupBy("dim").agg(F.ceil(F.sum("n_blocks") / fan).cast("int").alias("n_teams"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n_chunks")).join(teams, "dim")
    left = made.join(sizes, "dim").withColumn("team", F.pmod(F.xxhash64("label", "block"), F.col("n_teams")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).drop("n_teams", "n_chunks")
    right = rows.join(sizes, "dim").select(
        "dim", "label", "vec_id", "row", "vec", _dealt("row", F.col("n_chunks")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("n_teams") - 1)).alias("team")
    )
    schema = "a_id long, a_row long, p_score long, p_id long, p_row long, n_score long, n_id long, n_row long"
    met = _meet(left, right, ["dim", "part", "team"], each, schema)
    first = Window.partitionBy("a_row", "p_row").orderBy(F.desc("n_score"), "n_id", "n_row")
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)


def mine(
    table: DataFrame,
    label: Column | str = "label",
    is_anchor: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    block: int = BLOCK,
    chunk: int = CHUNK,
    fan: int = FAN,
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `table` has vec_id and embedding; `label` is a column of it, `is_anchor` a condition on vec_id (default: 50 divides it).
    """
    is_anchor = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    rows = stored(vectors(table, F.col(label) if isinstance(label, str) else label, scale))
    anchors = rows.where(is_anchor)
    near = positives(rows, anchors, n_positives, block, chunk, fan)
    listed = near.groupBy(F.col("a_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("p_score", "p_id", "p_row"))).alias("positives"))
    held = stored(anchors.join(listed, "row"))
    found = negatives(rows, held, n_negatives, window, block, chunk, fan)
    return found.select(
        F.col("a_id").alias("anchor_id"),
        F.col("p_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("n_id").alias("negative_id"),
        F.col("p_score").alias("positive_score"),
        F.col("n_score").alias("negative_score"),
    )


def shifted(table: DataFrame) -> DataFrame:
    """Negatives after the label of every id that 7 divides has moved on by one, modulo ten."""
    label = F.col("label").cast("long")
    return mine(table, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


NEGATIVES_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
