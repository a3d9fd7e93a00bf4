"""Language-model scores by a hidden Markov model over word classes.

Every token has a class: the `own` most frequent words and the end of a text are classes of their own; all others, seen or
not, share `SUFFIXES` classes by a hash of their last two bytes. A latent state chain emits classes, and within
a shared class a word has probability (count + 1) / (tokens + words + 1), which leaves one part for the unseen. So
the model is a proper distribution over token sequences, and a text's likelihood is the forward probability of its
classes times the within-class probabilities of its words; both are exact.

Word counts run over all training texts: each task counts, and sums meet by word. Baum-Welch starts from a random
model, settles on a bounded sample (`start_texts` segments), then makes `rounds` passes over all training texts:
each partition runs forward and backward over segments of `SEGMENT` tokens and gives expected counts, which are summed.
Forward passes go through many texts in step, longest first, so that those that end drop out.

The most frequent words, at most `head`, are broadcast (words of up to 256 bytes, so at most 51 MB; some 4 MB in
practice).
Rarer words are sent as distinct words of their text to meet their count, so no frequent word is ever a join key.

Defined results: null texts are empty and consist of the end alone. Without training texts, counts are 0 and every
class is equally likely. Rows with a null id are scored, never learned from, and not held out. Repeated rows get equal
results, one row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import remainder, stored, texts

HEAD = 200_000
OWN = 16_384
SUFFIXES = 512
STATES = 8
SEGMENT = 256
#: Texts that go in step, and the tokens they may have together.
LANES, LANE_TOKENS = 256, 1 << 19
LONGEST = 256


def suffix_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-2:], 42) & (SUFFIXES - 1)


def suffix_class_column(word: Column) -> Column:
    """`suffix_class` of a binary column; xxhash64 has the same seed."""
    return F.xxhash64(F.substring(word, -2, 2)).bitwiseAND(F.lit(SUFFIXES - 1))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all rows (doc_id, raw)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for pdf in batches:
            for raw in pdf["raw"]:
                seen.update(raw.lower().split())
                if len(seen) > 300_000:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return train.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What a task must know of the words."""

    index: dict[bytes, int]  # of the head, by falling count
    counts: np.ndarray  # of the head
    own: int  # head words with a class of their own
    shared_size: np.ndarray  # tokens + words + 1 of each shared class
    class_tokens: np.ndarray  # training tokens of each class
    tokens: int
    distinct: int
    texts: int

    @property
    def classes(self) -> int:
        return self.own + SUFFIXES + 1

    @property
    def end(self) -> int:
        return self.own + SUFFIXES


def vocabulary(counts: DataFrame, count_texts: int, head: int, own: int) -> Vocabulary:
    # Bins of counts, fine enough and bounded in number, tell how far down the head can reach; ties stay together.
    rank = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(16 * F.log2(F.col("n") / 1024))).cast("long")
    short = counts.where(F.length("word") <= LONGEST).withColumn("rank", rank)
    bins = sorted(((r["rank"], r["count"]) for r in short.groupBy("rank").count().collect()), reverse=True)
    reach, taken = [r for r, _ in bins], np.cumsum([c for _, c in bins])
    fit = int(np.searchsorted(taken, head, side="right"))
    top = short.where(F.col("rank") >= reach[fit - 1]).select("word", "n").toArrow() if fit else None
    pairs = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda p: (-p[1], p[0])) if fit else []
    words, n = [w for w, _ in pairs], np.array([c for _, c in pairs], dtype=np.int64)
    own = min(own, len(words))
    by_class = counts.groupBy(suffix_class_column(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    tokens, distinct = np.zeros(SUFFIXES, dtype=np.int64), np.zeros(SUFFIXES, dtype=np.int64)
    tokens[by_class["c"].to_numpy(dtype=int)] = by_class["n"]
    distinct[by_class["c"].to_numpy(dtype=int)] = by_class["v"]
    total, kinds = int(tokens.sum()) + count_texts, int(distinct.sum()) + (count_texts > 0)
    for w, k in zip(words[:own], n[:own], strict=True):
        tokens[suffix_class(w)] -= k
        distinct[suffix_class(w)] -= 1
    class_tokens = np.concatenate((n[:own], tokens, [count_texts])).astype(float)
    return Vocabulary({w: i for i, w in enumerate(words)}, n, own, tokens + distinct + 1, class_tokens, total, kinds, count_texts)


SEQUENCES = (
    "key long, doc_id long, train boolean, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, "
    "classes binary, rare array<binary>, times array<int>"
)


def sequences(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Classes and head scores of every text, and its rare words with their times.

    base_score and word_score lack only log10(count + 1) of the rare words.
    """
    held = rows.sparkSession.sparkContext.broadcast(vocab)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = held.value
        find, head = v.index.get, len(v.index)
        scale = np.log10(v.tokens + v.distinct + 1)
        shared = np.log10(v.shared_size)
        logs = np.log10(v.counts + 1.0)
        # What a head word without a class of its own weighs within its class.
        inner = np.zeros(head)
        cls = np.arange(head, dtype=np.int64)
        for w, i in v.index.items():
            if i >= v.own:
                k = suffix_class(w)
                cls[i] = v.own + k
                inner[i] = logs[i] - shared[k]
        suffixes: dict[bytes, int] = {}
        task, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for key, train, held_out, raw in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["train"], pdf["held_out"], pdf["raw"], strict=True):
                tokens = raw.lower().split()
                at = np.fromiter((find(w, -1) for w in tokens), np.int64, len(tokens))
                is_rare = at < 0
                known = at[~is_rare]
                sequence = np.empty(len(tokens) + 1, dtype="<u2")
                sequence[:-1][~is_rare] = cls[known]
                sequence[-1] = v.end
                where = np.nonzero(is_rare)[0].tolist()
                rare: Counter[bytes] = Counter()
                word_score = float(inner[known].sum())
                for i in where:
                    w = tokens[i]
                    rare[w] += 1
                    k = suffixes.get(w[-2:])
                    if k is None:
                        k = suffixes[w[-2:]] = suffix_class(w)
                    sequence[i] = v.own + k
                    word_score -= shared[k]
                base = float(logs[known].sum()) + np.log10(v.texts + 1) - (len(tokens) + 1) * scale
                out.append(
                    ((task << 33) + number, key, bool(train), bool(held_out), len(tokens) + 1, len(known) + (v.texts > 0), base, word_score,
                     sequence.tobytes(), list(rare), list(rare.values()))
                )
                number += 1
                if len(out) >= 500:
                    yield _sequence_frame(out)
                    out = []
            yield _sequence_frame(out)

    return rows.mapInPandas(each, SEQUENCES)


def _sequence_frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in SEQUENCES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


@dataclass
class Chain:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes by states

    @staticmethod
    def random(states: int, prior: np.ndarray, seed: int = 3) -> Chain:
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), states))
        move = np.eye(states) * 4 + rng.random((states, states))
        return Chain(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of(counts: np.ndarray, prior: np.ndarray) -> Chain:
        """From expected counts (rows: classes, then moves, then starts); the prior keeps every class possible."""
        states = counts.shape[1]
        emit = counts[: len(prior)] + 50.0 * prior[:, None]
        move = counts[len(prior) : len(prior) + states] + 1.0
        start = counts[-1] + 1.0
        return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def log_likelihoods(chain: Chain, texts_: list[np.ndarray]) -> np.ndarray:
    """log10 forward probability of each sequence, by the scaled recursion."""
    order = sorted(range(len(texts_)), key=lambda i: -len(texts_[i]))
    out = np.zeros(len(texts_))
    at = 0
    while at < len(order):
        lanes, total = [], 0
        while at < len(order) and len(lanes) < LANES and (not lanes or total + len(texts_[order[at]]) <= LANE_TOKENS):
            lanes.append(order[at])
            total += len(texts_[order[at]])
            at += 1
        lengths = np.array([len(texts_[i]) for i in lanes])
        # Step by step through the lanes; those that have ended are the last ones.
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        grid = np.zeros((lengths[0], len(lanes)), dtype=np.uint16) if lengths[0] * len(lanes) <= 8 * LANE_TOKENS else None
        if grid is not None:
            for c, i in enumerate(lanes):
                grid[: lengths[c], c] = texts_[i]
        logs = np.zeros(len(lanes))
        state = np.broadcast_to(chain.start, (len(lanes), len(chain.start)))
        for t in range(lengths[0]):
            n = active[t]
            seen = grid[t, :n] if grid is not None else np.fromiter((texts_[i][t] for i in lanes[:n]), np.int64, n)
            state = (state[:n] if t == 0 else state[:n] @ chain.move) * chain.emit[seen]
            size = state.sum(axis=1)
            logs[:n] += np.log10(size)
            state = state / size[:, None]
        out[lanes] = logs
    return out


def expected_counts(chain: Chain, segments: list[tuple[np.ndarray, bool]]) -> np.ndarray:
    """Expected counts of emissions, moves and starts over (segment, whether a text starts with it).

    A segment inside a text starts from equal states; its moves and emissions count as any other's.
    """
    classes, states = chain.emit.shape
    out = np.zeros((classes + states + 1, states))
    segments = sorted(segments, key=lambda s: -len(s[0]))
    even = np.full(states, 1 / states)
    for at in range(0, len(segments), LANES):
        part = segments[at : at + LANES]
        lengths = np.array([len(s) for s, _ in part])
        width, steps = len(part), int(lengths[0])
        first = np.array([is_first for _, is_first in part])
        seen = np.zeros((steps, width), dtype=np.int64)
        for c, (s, _) in enumerate(part):
            seen[: len(s), c] = s
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        emitted = chain.emit[seen]
        alpha = np.zeros((steps, width, states))
        size = np.ones((steps, width))
        state = np.where(first[:, None], chain.start, even)
        for t in range(steps):
            n = active[t]
            state = (state[:n] if t == 0 else state[:n] @ chain.move) * emitted[t, :n]
            size[t, :n] = state.sum(axis=1)
            state = state / size[t, :n, None]
            alpha[t, :n] = state
        beta = np.ones((width, states))
        gamma = np.zeros((steps, width, states))
        ahead = np.zeros((steps, width, states))  # emission times beta, scaled, of the next step
        for t in range(steps - 1, -1, -1):
            n = active[t]
            gamma[t, :n] = alpha[t, :n] * beta[:n]
            if t:
                ahead[t, :n] = emitted[t, :n] * beta[:n] / size[t, :n, None]
                beta[:n] = ahead[t, :n] @ chain.move.T
        flat = seen.ravel()
        for s in range(states):
            out[:classes, s] += np.bincount(flat, gamma[:, :, s].ravel(), minlength=classes)
        out[classes:-1] += chain.move * (alpha[:-1].reshape(-1, states).T @ ahead[1:].reshape(-1, states))
        out[-1] += gamma[0][first].sum(axis=0)
    return out


def cut(classes: bytes) -> list[tuple[np.ndarray, bool]]:
    """A text's classes in segments."""
    whole = np.frombuffer(classes, dtype="<u2")
    return [(whole[at : at + SEGMENT], at == 0) for at in range(0, len(whole), SEGMENT)]


def baum_welch(train: DataFrame, chain: Chain, prior: np.ndarray) -> Chain:
    """One pass over all training sequences."""
    held = train.sparkSession.sparkContext.broadcast(chain)
    states = chain.emit.shape[1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total, waiting, size = held.value, 0.0, [], 0
        for pdf in batches:
            for classes in pdf["classes"]:
                for segment in cut(classes):
                    waiting.append(segment)
                    size += len(segment[0])
                    if size >= 8 * LANES * SEGMENT:
                        total = total + expected_counts(own, waiting)
                        waiting, size = [], 0
        total = total + expected_counts(own, waiting)
        hit = np.nonzero(total.any(axis=1))[0]
        yield pd.DataFrame({"row": hit.astype(np.int32), **{f"s{s}": total[hit, s] for s in range(states)}})

    names = [f"s{s}" for s in range(states)]
    schema = "row int, " + ", ".join(f"{s} double" for s in names)
    summed = train.select("classes").mapInPandas(count, schema).groupBy("row").agg(*[F.sum(s).alias(s) for s in names]).toArrow()
    counts = np.zeros((len(prior) + states + 1, states))
    counts[summed["row"].to_numpy()] = np.stack([summed[s].to_numpy() for s in names], axis=1)
    return Chain.of(counts, prior)


def fit(rows: DataFrame, vocab: Vocabulary, states: int, rounds: int, start_texts: int, start_rounds: int) -> Chain:
    """The chain, from stored sequences."""
    prior = (vocab.class_tokens + 1.0) / (vocab.class_tokens + 1.0).sum()
    chain = Chain.random(states, prior)
    train = rows.where("train")
    if not vocab.texts:
        return chain
    share = min(1.0, start_texts / vocab.texts)
    drawn = train.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30))
    # A segment from somewhere in the text, by its key.
    begin = F.pmod(F.xxhash64(F.lit(1), "key"), F.floor((F.col("n_tokens") + SEGMENT - 1) / SEGMENT)) * (2 * SEGMENT)
    sample = drawn.select("key", begin.alias("begin"), F.substring("classes", begin.cast("int") + 1, F.lit(2 * SEGMENT)).alias("classes")).orderBy("key").collect()
    segments = [(np.frombuffer(bytes(r["classes"]), dtype="<u2"), r["begin"] == 0) for r in sample]
    for _ in range(start_rounds if segments else 0):
        chain = Chain.of(expected_counts(chain, segments), prior)
    for _ in range(rounds):
        chain = baum_welch(train, chain, prior)
    return chain


def score_texts(
    docs: DataFrame,
    states: int = STATES,
    rounds: int = 3,
    head: int = HEAD,
    own: int = OWN,
    start_texts: int = 800,
    start_rounds: int = 12,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    left = remainder(7)
    rows = texts(docs).withColumns({"train": F.coalesce(left != 2, F.lit(False)), "held_out": F.coalesce(left == 2, F.lit(False))})
    train = rows.where("train")
    counts = stored(word_counts(train.select("doc_id", "raw")))
    vocab = vocabulary(counts, docs.where(left != 2).count(), head, own)
    sequenced = stored(sequences(rows, vocab))
    chain = fit(sequenced, vocab, states, rounds, start_texts, start_rounds)

    # Rare words meet their counts; a word that no training text has counts 0.
    rare = sequenced.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(counts, "word", "left")
    logs = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1))
    seen = F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0))
    met = met.groupBy("key").agg(logs.alias("logs"), seen.alias("seen"))

    held = docs.sparkSession.sparkContext.broadcast(chain)

    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for classes in batches:
            yield pd.Series(log_likelihoods(held.value, [np.frombuffer(c, dtype="<u2") for c in classes]))

    state_score = F.pandas_udf(forward, "double")
    scored = sequenced.select("key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "word_score", state_score("classes").alias("chain"))
    both = scored.join(met, "key", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("chain") + F.col("word_score") + more).alias("score"),
    )
