"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every row becomes (digest, check, length, doc_id). Rows are dealt to `runs` leaf runs by a hash of their id;
each leaf keeps one row per digest, its best. Then runs meet in rounds of `fan_in`: the runs of one parent are
merged, digest by digest, keeping again the best row and the sum of the counts, until one run is left. A run is
spread over partitions by (run, digest), so no task ever holds a whole run. The winners then descend the same
tree, from the root to the leaves and from a leaf to its rows, so a digest that a third of all rows share is
dealt out over all leaves both ways.

"Verified" means that rows only merge when, beside SHA-256, an independent 64-bit hash and the length of the
normalised text agree.

Defined results: null text counts as empty; empty texts are equal to each other. A null id loses to any other id
at equal length. Rows repeated whole count as members, and all repeats of the winner are marked kept
(`keep_one` keeps a single one). An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import BLANKS, partitions, stored

KEY = ["__digest", "__check", "__size"]


def with_digest(docs: DataFrame, runs: int) -> DataFrame:
    """`docs` with its digest key, the original length, and the leaf run."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.regexp_replace(text, BLANKS, "")
    return docs.withColumns(
        {
            "__digest": F.unhex(F.sha2(plain.cast("binary"), 256)),
            "__check": F.xxhash64(plain),
            "__size": F.length(plain),
            "__chars": F.length(text),
            "__run": F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(runs)).cast("int"),
        }
    )


def run_count(docs: DataFrame, fan_in: int) -> int:
    """Leaf runs: the first power of `fan_in` that is no less than the number of shuffle partitions."""
    runs = fan_in
    while runs < partitions(docs.sparkSession):
        runs *= fan_in
    return runs


def _best(rows: DataFrame, run: Column) -> DataFrame:
    """One row per (run, digest): the longest text's, then the smallest id's."""
    return rows.groupBy(run.alias("__run"), *KEY).agg(F.min("__best").alias("__best"), F.sum("__count").alias("__count"))


def merge_runs(keyed: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """One row per digest, from the leaves to the root."""
    best = F.struct(
        (-F.col("__chars")).alias("chars"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("id")
    )
    level = keyed.select("__run", *KEY, best.alias("__best"), F.lit(1).cast("long").alias("__count"))
    level = _best(level, F.col("__run"))
    while runs > 1:
        runs //= fan_in
        level = _best(level, F.floor(F.col("__run") / fan_in).cast("int"))
    return level.drop("__run")


def leaf_winners(digests: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """The winner and the count of every digest at every leaf that holds it."""
    winners = merge_runs(digests, runs, fan_in)
    return digests.select("__run", *KEY).distinct().join(winners, KEY)


def digest_rows(docs: DataFrame, runs: int) -> DataFrame:
    """The digest key, length, leaf run and id of every row, stored: texts are read and hashed once for all rounds."""
    return stored(with_digest(docs.select("doc_id", "text"), runs).drop("text"))


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = run_count(docs, fan_in)
    digests = digest_rows(docs, runs)
    keep = F.col("__best.id")
    return digests.join(leaf_winners(digests, runs, fan_in), ["__run", *KEY]).select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("__count").alias("group_size"),
        F.col("doc_id").cast("long").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """The rows of `docs`, all columns, that stay: exactly one of every group of equal texts.

    Repeats of the winner lie in one partition, sorted by the key, so the last step moves no rows.
    """
    runs = run_count(docs, fan_in)
    found = leaf_winners(digest_rows(docs, runs), runs, fan_in)
    rows = with_digest(docs, runs).join(found, ["__run", *KEY])
    won = F.col("doc_id").cast("long").eqNullSafe(F.col("__best.id")) & (F.col("__chars") == -F.col("__best.chars"))
    return rows.where(won).dropDuplicates(["__run", *KEY]).select(*docs.columns)


EXACT_DEDUP_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS kept,
       text_sha256
FROM keyed
"""
