"""Spelling variants: words one edit apart, found by a frontier that walks a trie level by level.

Words are counted over whole texts. The words that are long and frequent enough form two tries, one of them over the reversed
words. Both are tables: a node is a 61-bit hash of its prefix, kept where prefixes branch or a word ends; an edge is
(node, label, child), its label being all that lies between two such nodes, so that a word of a hundred thousand letters
has as few levels as there are branches on its way.

The frontier is a table of states (word, position, node); each has spent its edit. A word's own nodes are known, so
its first states leave them by one replaced, inserted or deleted code point where another edge begins, if the rest of that
edge's label fits. Each round joins the frontier with the edge table and goes one edge further where the label and the
code point after it fit. States that end on a node where a word ends are neighbours. Two words one edit apart share at
least half of the shorter one either before the edit or after it, so each trie is entered half way down: the crowded
nodes near the root, where every word would meet every letter, are never joined. A node that many words pass is dealt out over as many salts as its words ask for.

Hashes of prefixes may collide; that only adds states. Neighbours are verified letter by letter and must be
words. Forms are the most frequent near words; roots follow them by pointer doubling.

Defined results: null and empty texts have no words. A null id counts as the empty string before the colon. Repeated
rows count each; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import stored, texts

#: Runs of A to Z and U+00C0 to U+00FF in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
#: Distinct words that a task counts, and prefixes that it lists, before it passes them on.
HELD = 200_000
#: One in this many runs loses a code point.
DAMAGE = 199
#: Words of a node per salt.
PER_SALT = 2000
# A prefix's hash is a polynomial in its code points.
MODULUS, FACTOR = (1 << 61) - 1, 1_000_003_000_037


def runs(raw: bytes) -> Counter:
    """Letter runs of a UTF-8 text, A to Z lower-cased, with their counts."""
    return Counter(RUN.findall(raw.lower()))


def word_counts(docs: DataFrame, damage: bool = True, least: int = 1) -> DataFrame:
    """(word, n) of all words of `least` code points or more; counts are summed in the task before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for doc_id, raw in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["raw"], strict=True):
                found = runs(raw)
                if damage:
                    prefix = zlib.crc32(b":" if doc_id is pd.NA else b"%d:" % doc_id)
                    for run, h in [(run, h) for run in found if (h := zlib.crc32(run, prefix)) % DAMAGE == 0]:
                        # Counted apart: the shortened run may be another run of this document.
                        text = run.decode()
                        at = h % len(text)
                        total[(text[:at] + text[at + 1 :]).encode()] += found.pop(run)
                total.update(found)
                if len(total) > HELD:
                    yield frame(total)
                    total = Counter()
        if total:
            yield frame(total)

    def frame(total: Counter) -> pd.DataFrame:
        rows = [(text, n) for word, n in total.items() if len(word) >= least and len(text := word.decode()) >= least]
        return pd.DataFrame({"word": pd.Series([r[0] for r in rows], dtype=object), "n": pd.Series([r[1] for r in rows], dtype="int64")})

    return texts(docs).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(size: Column | int, way: Column | int):
    """Depth at which a search enters a trie: half of the word, rounded up forwards (way 0) and down backwards (1)."""
    if isinstance(size, int):
        return (size + 1 - way) // 2
    return F.floor((size + 1 - way) / 2).cast("int")


def paths(words: DataFrame, least: int) -> DataFrame:
    """(wid, depth, node, next): the prefixes of every word, forwards and reversed, that a search can reach.

    Words one shorter begin their search one letter higher up. A node's lowest bit is its way. `next` is the code point
    that follows, 0 where the word ends.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wids, depths, nodes, nexts = (array(kind) for kind in "qiqi")

            def frame() -> pd.DataFrame:
                return pd.DataFrame({"wid": np.array(wids), "depth": np.array(depths), "node": np.array(nodes), "next": np.array(nexts)})

            for wid, word in zip(pdf["wid"].tolist(), pdf["word"], strict=True):
                for way, text in enumerate((word, word[::-1])):
                    first = start(max(len(text) - 1, least), way)
                    h = 0
                    for depth, code in enumerate([*map(ord, text), 0]):
                        if depth >= first:
                            wids.append(wid)
                            depths.append(depth)
                            nodes.append(2 * h + way)
                            nexts.append(code)
                        h = (h * FACTOR + code) % MODULUS
                if len(wids) > HELD:
                    yield frame()
                    wids, depths, nodes, nexts = (array(kind) for kind in "qiqi")
            if wids:
                yield frame()

    return words.select("wid", "word").mapInPandas(walk, "wid long, depth int, node long, next int")


def routes(words: DataFrame, least: int) -> DataFrame:
    """(way, text, size, nodes), two rows a word: its nodes of the trie, from the top: depth, node, salts, the code points
    that follow (a bit each, modulo 64), whether a word ends.

    A node that many words pass has as many rows to join as words; the join splits it, as it needs none of them together.
    """
    steps = paths(words, least)
    first, last = F.min("next").alias("first"), F.max("next").alias("last")
    signs = F.expr("bit_or(shiftleft(1L, next % 64))").alias("signs")
    nodes = steps.groupBy("node").agg(first, last, signs, F.count(F.lit(1)).alias("n"))
    nodes = nodes.where((F.col("first") < F.col("last")) | (F.col("first") == 0))
    nodes = nodes.select("node", "signs", (F.col("first") == 0).alias("ends"), F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts"))
    met = steps.join(nodes, "node").groupBy("wid").agg(F.collect_list(F.struct("depth", "node", "salts", "signs", "ends")).alias("nodes"))
    way = F.explode(F.array(F.lit(0), F.lit(1))).alias("way")
    both = words.select("wid", "word").join(met, "wid").select("word", "nodes", way)
    own = F.sort_array(F.filter("nodes", lambda n: F.pmod(n.node, F.lit(2)) == F.col("way")))
    return both.select("way", _word(F.col("word")).alias("text"), F.length("word").alias("size"), own.alias("nodes"))


def _word(text: Column) -> Column:
    return F.when(F.col("way") == 1, F.reverse(text)).otherwise(text)


def edges(routes: DataFrame) -> DataFrame:
    """(node, salt, label, child, salts, signs, ending), and the label's first code point, width and tail.

    salts, signs and ending (the word that ends there, if any) are the child's.
    """
    pairs = F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] AS top, nodes[i] AS low))")
    each = routes.where(F.size("nodes") > 1).select("way", "text", F.explode(pairs).alias("e"))
    label = F.expr("substring(text, e.top.depth + 1, e.low.depth - e.top.depth)")
    ending = F.when(F.col("e.low.ends"), _word(F.expr("substring(text, 1, e.low.depth)")))
    distinct = each.select(
        F.col("e.top.node").alias("node"), F.col("e.top.salts").alias("own"), label.alias("label"), F.col("e.low.node").alias("child"),
        F.col("e.low.salts").alias("salts"), F.col("e.low.signs").alias("signs"), ending.alias("ending"),
    ).distinct()
    parts = {"sign": F.ascii("label"), "width": F.length("label"), "tail": F.expr("substring(label, 2)")}
    return distinct.withColumns(parts).withColumn("salt", F.explode(F.expr("sequence(0, own - 1)"))).drop("own")


def _moved(met: DataFrame, *moves: tuple[str, str]) -> DataFrame:
    """States one edge further: where a condition holds, at the place that goes with it, if the text may go on there.

    It may if the child has an edge for its next code point or, at the text's end, if a word ends there.
    """

    def to(fits: str, place: str) -> Column:
        bit = f"shiftright(signs, ascii(substring(text, {place} + 1, 1)) % 64) & 1 = 1"
        return F.when(F.expr(f"{fits} AND if({place} < size, {bit}, ending IS NOT NULL)"), F.expr(place))

    place = F.explode(F.array_compact(F.array(*[to(*m) for m in moves]))).alias("place")
    return met.select("way", "text", "size", place, F.col("child").alias("node"), _salt("salts"), "ending")


def depart(ways: DataFrame, edge_table: DataFrame) -> DataFrame:
    """The frontier's first states: every way to leave a word's own path by one edit at an edge that is not its own."""
    entered = F.filter("nodes", lambda n: n.depth >= start(F.col("size"), F.col("way")))
    own = ways.select("way", "text", "size", F.explode(entered).alias("at"))
    own = own.select("way", "text", "size", F.col("at.depth").alias("place"), F.col("at.node").alias("node"), F.col("at.salts").alias("salts"))
    own = own.select("*", _salt("salts"), F.expr("substring(text, place + 1)").alias("rest"), F.expr("substring(text, place + 2)").alias("beyond"))
    met = own.drop("salts").join(edge_table, ["node", "salt"]).where("sign <> ascii(rest)")
    return _moved(
        met,
        ("place < size AND startswith(beyond, tail)", "place + width"),  # a code point replaced
        ("startswith(rest, tail)", "place + width - 1"),  # one inserted
        ("startswith(beyond, label)", "place + width + 1"),  # one deleted
    )


def follow(frontier: DataFrame, edge_table: DataFrame) -> DataFrame:
    """The states one edge further along their texts; the edit is spent."""
    rest = F.expr("substring(text, place + 1)")
    met = frontier.drop("ending").select("*", rest.alias("rest"), F.expr("ascii(substring(text, place + 1, 1))").alias("sign"))
    return _moved(met.join(edge_table, ["node", "salt", "sign"]), ("startswith(rest, label)", "place + width"))


def _salt(salts: str) -> Column:
    return F.pmod(F.xxhash64("text"), F.col(salts)).cast("int").alias("salt")


def neighbours(words: DataFrame, least: int = 6) -> DataFrame:
    """(word, near), both ways: all pairs of `words` (wid, word) that differ by one inserted, deleted or replaced code point."""
    ways = stored(routes(words, least))
    table = stored(edges(ways))
    # Where the word but its last code point is a word, too, the edit comes after all edges.
    shorter = ways.where(F.expr("exists(nodes, n -> n.depth = size - 1 AND n.ends)"))
    found = [shorter.select(_word(F.col("text")).alias("word"), _word(F.expr("substring(text, 1, size - 1)")).alias("near"))]
    states = stored(depart(ways, table))
    while not states.isEmpty():
        done = (F.col("place") == F.col("size")) & F.col("ending").isNotNull()
        found.append(states.where(done).select(_word(F.col("text")).alias("word"), F.col("ending").alias("near")))
        states = stored(follow(states.where("place < size"), table))
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    return pairs.where(F.levenshtein("word", "near", 1) == 1).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): the last word that forms lead to."""
    held = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.drop("moved")
        held = after.drop("moved")


def variants(docs: DataFrame, least: int = 6, frequent: int = 5, ratio: int = 5, damage: bool = True) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have at least `least` code points and `frequent` occurrences; a form occurs at least `ratio` times as often.
    `damage` deletes a code point of some runs first, as a test of the grouping.
    """
    counted = word_counts(docs, damage, least).where(F.col("n") >= frequent)
    words = stored(counted.withColumn("wid", F.monotonically_increasing_id()))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    grouped = neighbours(words, least).join(known, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.n") >= ratio * F.col("n")
    rows = words.drop("wid").join(grouped, "word", "left").select(
        "word",
        F.when(strong, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.n")).alias("form_n"),
    )
    rows = stored(rows)
    rooted = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
