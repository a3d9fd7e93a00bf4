"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit set where over half of the XXH64 values of its word shingles (repeats
included) have it set. Fingerprints within `radius` bits are linked. The fingerprint is cut into segments with
radii r_i such that the sum of (r_i + 1) is radius + 1: two linked fingerprints then differ by at most r_i bits
in some segment i. So every distinct fingerprint is entered once per segment in a table, looks up the small
Hamming ball around each of its own segments, and the pairs found are verified on all bits inside the join.
Equal fingerprints are one class from the start, so groups of copies never make pairs. Classes are merged by
star contraction and the component is attached to every document through a salted lookup.

The number of segments is picked from the number of distinct fingerprints to balance balls against table
matches; it changes the cost only, since any choice finds every link.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other;
fewer words than a shingle give one shingle. Repeated rows get equal results. Null ids take part; a component
whose ids are all null has a null component_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import attach, components, stored
from quotemill.session import ship_package

BITS = 64
#: Shingles hashed at a time, which bounds the memory a very long text takes.
BLOCK = 1 << 16


def fingerprint(raw: bytes, words: int = 4) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    last = max(len(tokens) - words, 0)
    counts = np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, last + 1, BLOCK):
        stop = min(start + BLOCK, last + 1)
        hashes = np.fromiter((digest(join(tokens[i : i + words]), 42) for i in range(start, stop)), np.uint64, stop - start)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last + 1, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series], words: int) -> Iterator[pd.Series]:
    for raw in batches:
        yield pd.Series(np.array([fingerprint(x, words) for x in raw], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, words: int = 4) -> DataFrame:
    """`docs`, all columns, with __fp: the fingerprint's bits as a long."""
    ship_package(docs.sparkSession)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _fingerprints(batches, words)

    udf = F.pandas_udf(each, "long")
    return docs.withColumn("__fp", udf(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, for the number of segments that costs least at `count` fingerprints."""

    def plan(m: int) -> list[tuple[int, int, int]]:
        spare, out, shift = radius + 1 - m, [], 0
        for i in range(m):
            width = BITS // m + (i < BITS % m)
            out.append((shift, width, spare // m + (i < spare % m)))
            shift += width
        return out

    def cost(m: int) -> float:
        return sum((balls := len(ball(w, r))) + 2 * balls * count / 2.0**w for _, w, r in plan(m))

    return plan(min(range(min(2, radius + 1), radius + 2), key=cost))


def ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): ids of classes (id, fp) whose fingerprints differ by 1 to `radius` bits; a pair may come more than once.

    A row of the table and a probe meet on (segment, value); a value holds distinct fingerprints only, so no key
    grows with copies. The smaller id of a pair is the table's, so each pair is verified in one direction.
    """
    plan = segments(classes.count(), radius)

    def part(shift: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    held = F.array(*[F.struct(F.lit(i).alias("seg"), part(s, w).alias("val")) for i, (s, w, _) in enumerate(plan)])

    def around(seg: int, shift: int, width: int, reach: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, reach)])
        return F.transform(masks, lambda m: F.struct(F.lit(seg).alias("seg"), part(shift, width).bitwiseXOR(m).alias("val")))

    asked = F.flatten(F.array(*[around(i, *p) for i, p in enumerate(plan)]))
    entries = classes.select("id", "fp", F.explode(held).alias("k")).select("k.seg", "k.val", F.col("id").alias("a"), F.col("fp").alias("fa"))
    probes = classes.select("id", "fp", F.explode(asked).alias("k")).select("k.seg", "k.val", F.col("id").alias("b"), F.col("fp").alias("fb"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius
    met = entries.join(probes, (entries.seg == probes.seg) & (entries.val == probes.val) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "b")


def _grouped(fingerprints: DataFrame, radius: int) -> DataFrame:
    """fp -> component_id, n_links of its fingerprint; from stored (doc_id, __fp)."""
    first = fingerprints.groupBy("__fp").agg(F.min(F.col("doc_id").cast("long")).alias("first"))
    # A class without an id gets a stand-in above every id.
    none = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64("__fp"), F.lit(1 << 40))
    classes = stored(first.select(F.coalesce("first", none).alias("id"), F.col("__fp").alias("fp")))
    pairs = stored(links(classes, radius).distinct())
    roots = components(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    found = classes.join(roots, "id", "left").join(ends, "id", "left")
    root = F.coalesce("root", "id")
    return found.select(
        F.col("fp").alias("__fp"),
        F.when(root < F.lit((1 << 63) - (1 << 41)), root).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def simhash_dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest id reachable; n_links counts the other fingerprints linked to this one.
    """
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), words).select("doc_id", "__fp"))
    return attach(prints, _grouped(prints, radius), ["__fp"], F.col("doc_id")).select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `docs`, all columns, that stay: the smallest id of every component, once.

    Whole texts are moved once, with their fingerprint, and only those whose fingerprint has the component's first id.
    """
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), words).select("doc_id", "__fp"))
    grouped = stored(_grouped(prints, radius))
    kept = attach(prints, grouped, ["__fp"], F.col("doc_id"))
    gone = kept.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct()
    again = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__gone"))
    rest = docs.join(gone.unionByName(again).distinct(), docs.doc_id.eqNullSafe(F.col("__gone")), "left_anti")
    # Ids that occur on several rows are settled by row: one per id and fingerprint.
    repeats = docs.join(again, docs.doc_id.eqNullSafe(F.col("__gone")), "left_semi")
    repeats = attach(with_fingerprint(repeats, words), grouped, ["__fp"], F.col("doc_id"))
    repeats = repeats.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["doc_id", "__fp"])
    return rest.unionByName(repeats.select(*docs.columns))
