"""Benchmark decontamination by latent semantic retrieval.

Texts become lower-case words, cut into passages: windows of three blocks of 32 words, one block apart, so any span
of up to 65 words lies whole in one passage. Benchmark items are cut into pieces of at most 64 words. Words are hashed to
`WIDTH` terms; document frequencies are counted over all documents. A randomised SVD of TF-IDF rows gives the latent
space: the rows are the item pieces, weighted up, and every passage of every document. The passages are first added up,
each with a random sign, into `sketch` rows, in one pass over all of them. Their space is the whole result, or with `whole`
only the directions to begin with: a further round then multiplies them with the rows of all passages, as they are. What is
summed over partitions has a fixed size for each. The QR step uses the Gram matrix, and only matrices of fixed size reach
the driver.
An item leaks into a document if its pieces' best common subsequences cover `sure` of its words, or `likely` of them
and as much of the answer as `answer` says. That allows for dropped, added and replaced words. So some piece must
have `likely` of its words in one passage. Every passage of every document is held against that first (`Shared`): a
passage that lacks the words for every piece can settle nothing, and goes no further. All others are projected
(block sums, since the projection is linear) and compared with all pieces by cosine. Passages above
`cosine` are candidates; so are, as a space of fixed rank cannot hold any number of pieces, passages with the words of a
piece, whatever their cosine. All are settled on the words themselves: the longest common subsequence with the
piece, and the same for the item's answer, its last sentence. Once a piece is found, the item's others are looked for in the
whole document.

Items are the query set. They are handled in blocks of about `block` items, each with a space of its own, so neither
the driver nor a task holds more than a block.

Defined results: null texts are empty. Items of fewer than five words match nothing: they cannot be told from chance.
Items repeated under one id are one item each row, reported once. Rows repeated whole are reported once per id.
Documents or items with a null id take part, with a null in the result. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sized
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import stored, texts
from quotemill.session import ship_package

WIDTH = 1 << 14
#: Terms whose sums travel together.
SLICE = 1 << 11
BLOCK, SPAN = 32, 3
PIECE = 64
LEAST = 5
RANK = 256
#: Rows that all passages are added up into.
SKETCH = 2 * RANK
#: What all passages together weigh at most, in passages; a piece weighs one or more, all together as much as this.
WEIGHT = 20_000
#: Partitions of the sketch in the SVD; each sends one matrix of terms by directions a round.
SKETCH_PARTS = 2
#: Words whose passages one task adds up; it sends one sketch.
SKETCH_WORDS = 1 << 24
#: Passages added up at a time.
FOLD = 1024
#: Words multiplied at a time, words read at a time, and words of one term summed at a time.
MULTIPLIED, READ, GROUP = 1 << 18, 1 << 12, 8
ITEM_BLOCK = 4096
COSINE, SURE, LIKELY, ANSWER = 0.25, 0.8, 0.6, 0.8
#: Most rare words of a piece that a passage must share to be looked at; any number finds the same leaks.
SHARED = 12
#: What a passage looked at costs, in entries read.
LOOK = 300
#: Bytes of a text hashed at a time.
HASHED = 1 << 20
#: Words of one text projected at a time.
CHUNK = BLOCK * 512

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def spaced(raw: bytes) -> bytes:
    """Lower case, and a space for all but digits, letters and what is beyond ASCII."""
    return raw.lower().translate(_SPACED)


def words(raw: bytes) -> list[bytes]:
    """Lower-case words: digits, letters and all beyond ASCII."""
    return spaced(raw).split()


# A word's hash is a polynomial in its bytes, modulo 2^64, and then mixed.
FACTOR, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """The powers of FACTOR, `count` or more of them."""
    global _powers
    if len(_powers) < count:
        steps = np.full(max(count, 64), FACTOR, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def hashes(spaced: bytes) -> Iterator[np.ndarray]:
    """Hashes of the words of a text that is lower-cased and spaced, in order, a part of it at a time."""
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + HASHED)
        end = len(spaced) if end < 0 else end
        a = np.frombuffer(spaced, np.uint8, end - at, at)
        inside = a != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            place = np.flatnonzero(inside)
            parts = (a[place].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[place - np.repeat(starts, sizes)]
            h = np.add.reduceat(parts, np.cumsum(sizes) - sizes)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
            yield h ^ (h >> np.uint64(32))
        at = end


def word_hash(word: bytes) -> int:
    """The same for one word."""
    h, p = 0, 1
    for byte in word:
        h += (byte + 1) * p
        p = p * FACTOR & (1 << 64) - 1
    h &= (1 << 64) - 1
    h = (h ^ h >> 29) * MIX & (1 << 64) - 1
    return h ^ h >> 32


class Terms(dict):
    """Word to term, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        term = word_hash(word) & (WIDTH - 1)
        if len(self) < 300_000:
            self[word] = term
        return term

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def common(masks: dict[bytes, int], length: int, tokens: list[bytes]) -> int:
    """Length of the longest common subsequence; `masks` has the places of each word of the first text."""
    full = (1 << length) - 1
    row = full
    for mask in map(masks.get, tokens):
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def places(tokens: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(tokens):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


class Item:
    """An item's words, its pieces and its answer."""

    def __init__(self, item_id: int | None, text: str):
        self.item_id = item_id
        self.tokens = words(text.encode())
        count = max(1, -(-len(self.tokens) // PIECE))
        bounds = [round(i * len(self.tokens) / count) for i in range(count + 1)]
        self.pieces = [self.tokens[a:b] for a, b in zip(bounds, bounds[1:])]
        sentences = [w for s in text.replace("?", ".").replace("\n", ".").split(".") if (w := words(s.encode()))]
        self.answer = sentences[-1] if sentences else []


def fewest(share: float, length: int) -> int:
    """The least number of words that is `share` of `length`."""
    return max(1, math.ceil(share * length - 1e-9))


def at_least(times: int, mean: float) -> float:
    """The chance of `times` or more events where `mean` are expected (Poisson)."""
    return max(0.0, 1.0 - math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(times)))


class Shared:
    """Pieces by their rare words; finds every passage that may have `likely` of a piece's words.

    A passage with m of a piece's n words misses n - m at most, so of any n - m + k words of the piece it has k.
    Each piece is entered under the n - m + k words that are rarest in the documents; any k finds the same leaks, and each piece
    takes the one that costs least if words fall into passages independently, as often as they occur in the documents.
    """

    def __init__(self, pieces: list[list[bytes]], likely: float, seen: Callable[[bytes], int], passages: Sized):
        """`seen` is how often a word occurs in the documents; of `passages`, only their number counts."""
        self.least = np.empty(len(pieces), np.int64)
        self.own, self.needed = [Counter(p) for p in pieces], [fewest(likely, len(p)) for p in pieces]
        entries: dict[bytes, list[tuple[int, int]]] = {}
        for q, piece in enumerate(pieces):
            m = self.needed[q]
            rarest = [w for _, w in sorted((seen(w), w) for w in piece)]
            # ways[i]: the chance that a passage has i of the words so far; the last: SHARED or more.
            ways, times, read, costs = np.eye(1, SHARED + 1)[0], Counter(), 0.0, {}
            for j, w in enumerate(rarest, 1):
                times[w] += 1
                there = at_least(times[w], SPAN * seen(w) / max(len(passages), 1))
                ways = ways * (1 - there) + np.append(0, ways[:-1] * there) + np.append(np.zeros(SHARED), ways[-1] * there)
                read += there
                if 1 <= (k := j - (len(piece) - m)) <= SHARED:
                    costs[k] = read + LOOK * ways[k:].sum()
            self.least[q] = k = min(costs, key=lambda k: (costs[k], k))
            for w, n in Counter(rarest[: len(piece) - m + k]).items():
                entries.setdefault(w, []).append((q, n))
        self.words = {w: i for i, w in enumerate(entries)}
        flat = [e for es in entries.values() for e in es]
        self.piece, self.times = (np.array([e[i] for e in flat], np.int64) for i in (0, 1))
        self.count = np.array([len(es) for es in entries.values()], np.int64)
        self.start = np.cumsum(self.count) - self.count

    def passages(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(block, piece) of the candidate passages of a text."""
        known = self.words
        at = [i for i, w in enumerate(tokens) if w in known]
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word = np.fromiter((known[tokens[i]] for i in at), np.int64, len(at))
        key, n = np.unique(np.array(at) // BLOCK * len(known) + word, return_counts=True)
        block, word = key // len(known), key % len(known)
        each = self.count[word]
        entry = np.repeat(self.start[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        piece, n = self.piece[entry], np.minimum(np.repeat(n, each), self.times[entry])
        # A block's words count for each of the passages that hold it.
        blocks, total = np.repeat(block, each), len(self.least)
        key = np.concatenate([(blocks - d) * total + piece for d in range(SPAN)])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.tile(n, SPAN)[order]
        first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        key, n = key[first], np.add.reduceat(n, first)
        key = key[(key >= 0) & (n >= self.least[key % total])]
        key = key[[self._holds(tokens, *divmod(x, total)) for x in key.tolist()]] if len(key) else key
        return key // total, key % total

    def _holds(self, tokens: list[bytes], block: int, piece: int) -> bool:
        """Whether a passage has `likely` of a piece's words, in any order."""
        own = self.own[piece]
        there = Counter(filter(own.__contains__, tokens[block * BLOCK : (block + SPAN) * BLOCK]))
        return sum(min(n, own[w]) for w, n in there.items()) >= self.needed[piece]


def weights(frequency: np.ndarray, count: int) -> np.ndarray:
    """Inverse document frequency by term; never zero, so that small tables have a space, too."""
    return np.maximum(np.log((2.0 + count) / (1.0 + frequency)), 0.05).astype(np.float32)


class Passages:
    """All passages: their number, and the stored terms of their texts (key, terms)."""

    def __init__(self, terms: DataFrame, count: int):
        self.terms, self.count = terms, count

    def __len__(self) -> int:
        return self.count

    def share(self) -> float:
        """What a passage weighs."""
        return min(1.0, WEIGHT / max(self.count, 1))


def statistics(docs: DataFrame, sketch: int, vocabulary: frozenset[bytes] = frozenset()) -> tuple[np.ndarray, int, DataFrame, Callable[[bytes], int], Passages]:
    """Document frequency by term, number of documents, the stored sketch of all passages, how often each word of
    `vocabulary` occurs, and the passages. One pass over all texts, and one over their terms."""
    known = np.array(sorted({word_hash(w) for w in vocabulary}), np.uint64)
    held = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_, seen, docs_seen, words_seen, passages_seen = held.value, np.zeros(WIDTH, dtype=np.int64), 0, 0, 0
        own, listed, low = np.zeros(len(known_), np.int64), np.zeros(WIDTH, bool), np.uint64(WIDTH - 1)
        listed[known_ & low] = True
        for pdf in batches:
            keys, all_terms = [], []
            for key, raw in zip(pdf["doc_id"], pdf["raw"], strict=True):
                here, parts = np.zeros(WIDTH, bool), []
                for h in hashes(spaced(raw)):
                    terms = (h & low).astype("<u2")
                    here[terms] = True
                    parts.append(terms.tobytes())
                    if len(known_):
                        some = h[listed[terms]]
                        at = np.minimum(np.searchsorted(known_, some), len(known_) - 1)
                        own += np.bincount(at[known_[at] == some], minlength=len(known_))
                seen += here
                docs_seen += 1
                if parts:
                    # The signs of a text's passages depend on its id and its bytes.
                    keys.append(xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(str(key).encode(), 11)) >> 1)
                    all_terms.append(b"".join(parts))
                    words_seen += len(all_terms[-1]) // 2
                    passages_seen += -(-len(all_terms[-1]) // (2 * BLOCK))
            if keys:
                yield pd.DataFrame({"kind": "text", "n": keys, "value": all_terms})
        hit, used = np.nonzero(seen)[0], np.nonzero(own)[0]
        yield pd.DataFrame({"kind": "term", "n": seen[hit], "value": [int(t).to_bytes(8, "little") for t in hit]})
        yield pd.DataFrame({"kind": ["documents", "words", "passages"], "n": [docs_seen, words_seen, passages_seen], "value": b""})
        yield pd.DataFrame({"kind": "word", "n": own[used], "value": [int(x).to_bytes(8, "little") for x in known_[used]]})

    both = stored(docs.mapInPandas(count, "kind string, n long, value binary"))
    rows = both.where("kind <> 'text'").groupBy("kind", "value").agg(F.sum("n").alias("n")).toPandas()
    found = {kind: dict(zip(map(bytes, part["value"]), part["n"].tolist(), strict=True)) for kind, part in rows.groupby("kind")}
    documents, total, passages = (found.get(kind, {}).get(b"", 0) for kind in ("documents", "words", "passages"))
    frequency = np.zeros(WIDTH)
    for term, n in found.get("term", {}).items():
        frequency[int.from_bytes(term, "little")] = n
    terms = both.where("kind = 'text'").select(F.col("n").alias("key"), F.col("value").alias("terms")).coalesce(max(1, -(-total // SKETCH_WORDS)))
    all_passages = Passages(terms, passages)
    drawn = stored(sketched(terms, weights(frequency, documents), sketch, all_passages.share()))
    held.destroy()
    by_word = found.get("word", {})
    return frequency, documents, drawn, lambda w: by_word.get(word_hash(w).to_bytes(8, "little"), 0), all_passages


def fold(total: np.ndarray, keys: np.ndarray, texts: list[bytes], idf: np.ndarray) -> None:
    """Adds every passage of `texts` (their terms), a TF-IDF row of length one, to a row of `total`, with a sign; row
    and sign come from the text's key and the passage's number."""
    terms = np.frombuffer(b"".join(texts), "<u2")
    sizes = np.array([len(t) // 2 for t in texts], np.int64)
    blocks = -(-sizes // BLOCK)
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(texts)), blocks)
    number = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]
    starts = (ends - sizes)[owner] + number * BLOCK
    widths = np.minimum(starts + SPAN * BLOCK, ends[owner]) - starts
    h = keys.astype(np.uint64)[owner] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    h ^= h >> np.uint64(32)
    place, sign = (h >> np.uint64(1)) % np.uint64(len(total)), np.where(h & np.uint64(1), np.float32(1), np.float32(-1))
    flat = total.reshape(-1)
    for at in range(0, len(owner), FOLD):
        wide = widths[at : at + FOLD]
        row = np.repeat(np.arange(len(wide)), wide)
        key = row * WIDTH + terms[np.arange(len(row)) + (starts[at : at + FOLD] - (np.cumsum(wide) - wide))[row]]
        key = np.sort(key.astype(np.int32))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, key = np.diff(np.append(first, len(key))), key[first]
        row, term = key // WIDTH, key % WIDTH
        value = n * idf[term]
        scale = sign[at : at + FOLD] / np.sqrt(np.bincount(row, np.square(value)))
        np.add.at(flat, place[at : at + FOLD].astype(np.int64)[row] * WIDTH + term, (value * scale[row]).astype(np.float32))


def sketched(texts: DataFrame, idf: np.ndarray, rows: int, share: float) -> DataFrame:
    """The passages of all `texts` (key, terms) added up into `rows` rows (a sparse random projection), scaled to `share` of their weight.

    The products of the rows with themselves are, in expectation, those of all passages.
    """
    held = texts.sparkSession.sparkContext.broadcast(idf)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, WIDTH), np.float32)
        for pdf in batches:
            fold(total, pdf["key"].to_numpy(), pdf["terms"].tolist(), held.value)
        used = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(used), 32):
            yield pd.DataFrame({"row": used[at : at + 32].astype(np.int32), "part": [total[r].tobytes() for r in used[at : at + 32]]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in pdf["part"]], axis=0, dtype=np.float64) * math.sqrt(share)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    schema = "row int, part binary"
    return texts.mapInPandas(part, schema).groupBy("row").applyInPandas(add, schema)


def multiply(total: np.ndarray, texts: list[bytes], lens: np.ndarray, idf: np.ndarray) -> None:
    """Adds transpose(A) A W to `total`, A being the counts of every passage of `texts` (their terms) over its TF-IDF length.

    `lens` is W times `idf`, with a row of zeros behind it; so the caller has `total` times `idf` to take. Passages
    are sums of blocks, and so are the products: every word is read once for A W and added once for the transpose.
    """
    parts, words_held = [], 0
    for text in texts:
        # A long text goes through in parts that overlap by a passage.
        for at in range(0, len(text), 2 * CHUNK):
            parts.append((text[at : at + 2 * (CHUNK + (SPAN - 1) * BLOCK)], at + 2 * CHUNK < len(text)))
            words_held += len(parts[-1][0]) // 2
            if words_held >= MULTIPLIED:
                _multiply(total, parts, lens, idf)
                parts, words_held = [], 0
    if parts:
        _multiply(total, parts, lens, idf)


def _multiply(total: np.ndarray, parts: list[tuple[bytes, bool]], lens: np.ndarray, idf: np.ndarray) -> None:
    """The same for parts of texts, each with whether its last blocks belong to passages of the next one."""
    flat = np.frombuffer(b"".join(p for p, _ in parts), "<u2")
    sizes = np.array([len(p) // 2 for p, _ in parts], np.int64)
    blocks = -(-sizes // BLOCK)
    count, wide = int(blocks.sum()), lens.shape[1]
    owner = np.repeat(np.arange(len(parts)), blocks)
    number = np.arange(count) - (np.cumsum(blocks) - blocks)[owner]
    starts = number < np.where([more for _, more in parts], CHUNK // BLOCK, blocks)[owner]
    padded = np.full(count * BLOCK, WIDTH, np.int32)
    word = np.arange(len(flat)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(sizes) - sizes), sizes)
    padded[word] = flat
    # Words by term, then block; lengths of passages from a term's counts in blocks next to each other.
    bits = max(1, (count - 1).bit_length())
    key = np.sort(flat.astype(np.int64) << bits | word // BLOCK)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    each, n = key[first], np.diff(np.append(first, len(key))).astype(np.float32)
    weight, place = np.square(idf)[each >> bits], each & (1 << bits) - 1
    # products[d]: of each block's row with the one d blocks on.
    products = np.zeros((SPAN, count))
    products[0] = np.bincount(place, weight * n * n, count)
    for step in range(1, SPAN):
        gap = each[step:] - each[:-step]
        for d in range(step, SPAN):
            at = np.flatnonzero((gap == d) & (each[step:] >> bits == each[:-step] >> bits))
            products[d] += np.bincount(place[at], weight[at] * n[at] * n[at + step], count)
    left = blocks[owner] - number
    square = np.zeros(count)
    for i in range(SPAN):
        for d in range(SPAN - i):
            here = np.flatnonzero(left > i + d)
            square[here] += (2 if d else 1) * products[d][here + i]
    # Block sums of A W.
    sums, read = np.empty((count, wide), np.float32), np.empty((READ, wide), np.float32)
    ones = np.ones((1, BLOCK), np.float32)
    for at in range(0, len(padded), READ):
        some = padded[at : at + READ]
        np.take(lens, some, axis=0, out=read[: len(some)], mode="clip")
        sums[at // BLOCK : (at + len(some)) // BLOCK] = np.matmul(ones, read[: len(some)].reshape(-1, BLOCK, wide))[:, 0]
    # A passage's row over its squared length, given to each of its blocks; some blocks at a time, to stay in the cache.
    scale = np.where(starts, 1 / square, 0).astype(np.float32)[:, None]
    after = [(left > d).astype(np.float32)[:, None] for d in range(SPAN)]
    before = [(number >= d).astype(np.float32)[:, None] for d in range(SPAN)]
    given = np.empty((count + 1, wide), np.float32)
    given[-1] = 0
    rows = np.zeros((SPAN - 1 + BLOCK, wide), np.float32)
    for at in range(0, count, BLOCK):
        end = min(at + BLOCK, count)
        here = rows[SPAN - 1 : SPAN - 1 + end - at]
        here[:] = sums[at:end]
        for d in range(1, SPAN):
            other = sums[at + d : end + d]
            here[: len(other)] += other * after[d][at : at + len(other)]
        here *= scale[at:end]
        given[at:end] = here
        for d in range(1, SPAN):
            given[at:end] += rows[SPAN - 1 - d : SPAN - 1 - d + end - at] * before[d][at:end]
        rows[: SPAN - 1] = rows[end - at : end - at + SPAN - 1].copy()
    # Each term takes what its words' blocks were given, in groups that are filled up with zeros.
    terms, at = np.unique(key >> bits, return_index=True)
    times = np.diff(np.append(at, len(key)))
    groups = -(-times // GROUP)
    begin = np.cumsum(groups) - groups
    index = np.full(int(groups.sum()) * GROUP, count, np.int64)
    index[np.arange(len(key)) + np.repeat(begin * GROUP - at, times)] = key & (1 << bits) - 1
    term, ones = np.repeat(terms, groups), np.ones((1, GROUP), np.float32)
    for at in range(0, len(index), READ):
        some = index[at : at + READ]
        np.take(given, some, axis=0, out=read[: len(some)], mode="clip")
        added = np.matmul(ones, read[: len(some)].reshape(-1, GROUP, wide))[:, 0]
        own = term[at // GROUP : (at + len(some)) // GROUP]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total[own[first]] += np.add.reduceat(added, first, axis=0) if len(first) < len(own) else added


def multiplied(passages: Passages, w: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """transpose(A) A W for the TF-IDF rows A of all passages, each of length one: a pass over all of them."""
    wide = w.shape[1]
    held = passages.terms.sparkSession.sparkContext.broadcast((w.astype(np.float16), idf))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lens = np.concatenate([held.value[0] * held.value[1][:, None], np.zeros((1, wide), np.float32)])
        total = np.zeros((WIDTH, wide), np.float32)
        for pdf in batches:
            multiply(total, pdf["terms"].tolist(), lens, held.value[1])
        slices = total.reshape(-1, SLICE, wide)
        yield pd.DataFrame({"slice": np.arange(len(slices), dtype=np.int32), "part": [x.tobytes() for x in slices]})

    found = summed(passages.terms.mapInPandas(product, "slice int, part binary"), wide)
    held.destroy()
    return found * idf[:, None]


def summed(slices: DataFrame, wide: int) -> np.ndarray:
    """Sums of matrices of terms by directions that come in slices."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in pdf["part"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": [total.tobytes()]})

    rows = slices.groupBy("slice").applyInPandas(add, "slice int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], np.float32).reshape(SLICE, wide) for r in sorted(rows, key=lambda r: r["slice"])])


def leading(w: np.ndarray, rank: int) -> np.ndarray:
    """The leading left singular vectors of `w`, `rank` at most."""
    values, vectors = np.linalg.eigh((w.T @ w).astype(np.float64))
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > max(values.max(), 1e-30) * 1e-9]
    return (w @ (vectors[:, order] / np.sqrt(values[order]))).astype(np.float32)


def _row(terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's distinct terms and its TF-IDF values, scaled to length one."""
    at, n = np.unique(terms, return_counts=True)
    value = n * idf[at]
    size = np.linalg.norm(value)
    return at, value / size if size else value


def latent_space(sketch: DataFrame, pieces: list[np.ndarray], idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 5, passages: Passages | None = None) -> np.ndarray:
    """Terms by directions: the leading right singular vectors of piece rows and of all passages, by randomised SVD.

    Each round is one pass over the stored rows: Y = A W, an orthogonal basis of Y from its Gram matrix, and
    W = transpose(A) Q. The rounds over the sketch of the passages give the directions to begin with; the last round
    is over the rows of the passages themselves, if there are `passages`. Piece rows weigh as much together as the passages do.
    """
    spark = sketch.sparkSession
    wide = min(rank + 16, WIDTH)
    lift = float(np.sqrt(max(1.0, WEIGHT / max(len(pieces), 1))))
    own = spark.createDataFrame([(p.astype("<i4").tobytes(), lift) for p in pieces], "terms binary, lift double").coalesce(1)
    # A row of the sketch has a value for every term; a piece, its terms.
    rows = own.withColumn("part", F.lit(None).cast("binary")).unionByName(sketch.select("part"), allowMissingColumns=True).coalesce(SKETCH_PARTS)
    w = np.random.default_rng(seed).standard_normal((WIDTH, wide)).astype(np.float32)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
        """Rows of the sketch as a matrix, and rows of pieces."""
        for pdf in batches:
            own_ = pdf["part"].isna()
            yield np.frombuffer(b"".join(pdf["part"][~own_]), np.float32).reshape(-1, WIDTH), pdf[own_]

    for _ in range(rounds):
        # Half precision halves what every executor keeps; sums are taken in single.
        held = spark.sparkContext.broadcast((w.astype(np.float16), idf))

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            basis, weight = held.value[0].astype(np.float32), held.value[1]
            total = np.zeros((wide, wide))
            for dense, pdf in split(batches):
                y = np.array([lift_ * (v @ basis[t]) for (t, v), lift_ in zip((_row(np.frombuffer(x, "<i4"), weight) for x in pdf["terms"]), pdf["lift"], strict=True)])
                for y_ in (y, dense @ basis):
                    if len(y_):
                        total += y_.T.astype(np.float64) @ y_
            yield pd.DataFrame({"part": [total.tobytes()]})

        parts = rows.mapInPandas(gram, "part binary").collect()
        g = sum(np.frombuffer(r["part"]).reshape(wide, wide) for r in parts)
        # Y R is orthogonal for R = U / sqrt(values) of the Gram matrix.
        values, vectors = np.linalg.eigh(g)
        good = values > max(values.max(), 1e-30) * 1e-9
        turn = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        narrow = turn.shape[1]
        turned = spark.sparkContext.broadcast(turn)

        def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            basis, weight = held.value[0].astype(np.float32), held.value[1]
            right = turned.value
            total = np.zeros((WIDTH, narrow), dtype=np.float32)
            for dense, pdf in split(batches):
                total += dense.T @ ((dense @ basis) @ right)
                for x, lift_ in zip(pdf["terms"], pdf["lift"], strict=True):
                    t, v = _row(np.frombuffer(x, "<i4"), weight)
                    v = v * np.float32(lift_)
                    total[t] += np.outer(v, (v @ basis[t]) @ right)
            slices = total.reshape(-1, SLICE, narrow)
            yield pd.DataFrame({"slice": np.arange(len(slices), dtype=np.int32), "part": [x.tobytes() for x in slices]})

        w = summed(rows.mapInPandas(product, "slice int, part binary"), narrow)
        wide = narrow
        # Entries of a unit scale, as half precision needs.
        w /= max(float(np.abs(w).max()), 1e-30)
        held.destroy()
        turned.destroy()
    if passages is not None and len(passages):
        # Half precision is what the tasks get; what follows holds for these very directions.
        w = leading(w, wide).astype(np.float16).astype(np.float32)
        z = multiplied(passages, w, idf) * np.float32(passages.share())
        for p in pieces:
            t, v = _row(p, idf)
            z[t] += np.outer(v, (v @ w[t]) * np.float32(lift * lift))
        # With Z = transpose(A) A W, the Gram matrix of Y = A W is transpose(W) Z, and transpose(A) Q is Z R.
        g = (w.T @ z).astype(np.float64)
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        good = values > max(values.max(), 1e-30) * 1e-9
        w = z @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    return leading(w, rank)


def project(tokens: list[bytes], at: np.ndarray, terms: Terms, lens: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors and lengths of the passages that start at the blocks `at` (sorted) of a text.

    Only blocks of these passages are read. A repeated word counts once more in the length, not squared, so the
    cosine errs upwards and loses nothing.
    """
    count = -(-len(tokens) // BLOCK)
    used = np.unique(np.concatenate([at + d for d in range(SPAN)]))
    used = used[used < count]
    vector, square = np.empty((len(used), lens.shape[1]), lens.dtype), np.empty(len(used), lens.dtype)
    for i, block in enumerate(used.tolist()):
        own = terms.of(tokens[block * BLOCK : (block + 1) * BLOCK])
        vector[i], square[i] = lens[own].sum(axis=0), np.square(idf[own]).sum()
    first = np.searchsorted(used, at)
    vectors, squares = vector[first], square[first]
    for extra in range(1, SPAN):
        here = at + extra < count
        vectors[here] += vector[first[here] + extra]
        squares[here] += square[first[here] + extra]
    return vectors, np.sqrt(squares)


def search(docs: DataFrame, items: list[Item], seen: Callable[[bytes], int], passages: Sized, idf: np.ndarray, space: np.ndarray, cosine: float, sure: float, likely: float, answer: float) -> DataFrame:
    """One row per document and item that leaks into it."""
    lens = space * idf[:, None]
    owners, queries, lookup = [], [], Terms()
    for n, item in enumerate(items):
        for p, piece in enumerate(item.pieces):
            t, v = _row(lookup.of(piece), idf)
            owners.append((n, p))
            queries.append(v @ space[t])
    queries = np.array(queries, dtype=np.float32)
    shared = Shared([p for item in items for p in item.pieces], likely, seen, passages)
    held = docs.sparkSession.sparkContext.broadcast((items, owners, queries.T.copy(), lens.astype(np.float16), idf, shared))

    def settle(tokens: list[bytes], found: list[tuple[int, int, float, bool]], facts: list, keep: dict) -> None:
        """Common subsequences of the candidate passages; keeps the best of each piece and of the answer."""
        for block, q, score, near in found:
            n, p = facts[1][q]
            if n not in facts[2]:
                facts[2][n] = [places(x) for x in facts[0][n].pieces], places(facts[0][n].answer)
            piece, answer_ = facts[2][n]
            got = common(piece[p], len(facts[0][n].pieces[p]), tokens[block * BLOCK : (block + SPAN) * BLOCK])
            # Found by its words alone, and they are not in order.
            if not near and got < fewest(likely, len(facts[0][n].pieces[p])):
                continue
            # The answer may lie just behind the passage that holds the rest.
            beyond = (block + SPAN + 2) * BLOCK + max(0, len(facts[0][n].answer) - PIECE)
            said = common(answer_, len(facts[0][n].answer), tokens[block * BLOCK : beyond])
            best = keep.setdefault(n, [{}, 0, 0.0])
            best[0][p] = max(best[0].get(p, 0), got)
            best[1], best[2] = max(best[1], said), max(best[2], score)

    def complete(tokens: list[bytes], facts: list, keep: dict) -> None:
        """The other pieces of an item of which one piece is there: their best passages, however little they have."""
        for n, best in list(keep.items()):
            item = facts[0][n]
            if len(item.pieces) > 1 and any(got >= fewest(likely, len(item.pieces[p])) for p, got in best[0].items()):
                for p, piece in enumerate(item.pieces):
                    if best[0].get(p, 0) < len(piece):
                        got = [common(facts[2][n][0][p], len(piece), tokens[at : at + SPAN * BLOCK]) for at in range(0, len(tokens), BLOCK)]
                        settle(tokens, [(int(np.argmax(got)), facts[3][n, p], 0.0, True)], facts, keep)

    def leaks(key: int | None, tokens: list[bytes], terms: Terms, facts: list, right: np.ndarray, lens_: np.ndarray, idf_: np.ndarray, shared_: Shared) -> Iterator[tuple]:
        keep: dict = {}
        # A long text goes through in chunks that overlap by a passage.
        for at in range(0, len(tokens), CHUNK):
            part = tokens[at : at + CHUNK + (SPAN - 1) * BLOCK]
            held, piece = shared_.passages(part)
            if not len(held):
                continue
            blocks, row = np.unique(held, return_inverse=True)
            vectors, size = project(part, blocks, terms, lens_, idf_)
            size = np.maximum(size, 1e-9)
            near = vectors @ right >= cosine * size[:, None]
            both = near.copy()
            both[row, piece] = True
            place, q = np.nonzero(both)
            scores = np.einsum("ij,ij->i", vectors[place], right.T[q]) / size[place]
            found = [(at // BLOCK + b, *x) for b, *x in zip(blocks[place].tolist(), q.tolist(), scores.tolist(), near[place, q].tolist(), strict=True)]
            settle(tokens, found, facts, keep)
        complete(tokens, facts, keep)
        for n, (pieces, said, score) in keep.items():
            item = facts[0][n]
            matched = sum(pieces.values())
            covered = matched / len(item.tokens)
            answered = said / len(item.answer) if item.answer else 0.0
            if covered >= sure or covered >= likely and answered >= answer:
                yield key, item.item_id, min(1.0, score), matched, covered, answered

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items_, owners_, right, lens_, idf_, shared_ = held.value
        lens_ = lens_.astype(np.float32)
        terms, facts = Terms(), [items_, owners_, {}, {o: q for q, o in enumerate(owners_)}]
        for pdf in batches:
            out: list[tuple] = []
            for key, raw in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["raw"], strict=True):
                if len(tokens := words(raw)) >= LEAST:
                    out += leaks(key, tokens, terms, facts, right, lens_, idf_, shared_)
            frame = pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "matched", "covered", "answered"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    schema = "doc_id long, item_id long, cosine double, matched long, covered double, answered double"
    return docs.mapInPandas(each, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = RANK,
    sketch: int = SKETCH,
    block: int = ITEM_BLOCK,
    cosine: float = COSINE,
    sure: float = SURE,
    likely: float = LIKELY,
    answer: float = ANSWER,
    whole: bool = False,
) -> DataFrame:
    """The leaks: doc_id, item_id, cosine, matched (words), covered and answered (shares).

    With `whole` each block of items fits its space on the rows of all passages, one more pass over their terms.
    """
    spark = docs.sparkSession
    ship_package(spark)
    raws = texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # The words of all items, the query set.
    vocabulary = frozenset(w for r in items.toLocalIterator() for w in words(r["text"].encode()))
    frequency, count, folded, seen, passages = statistics(raws, sketch, vocabulary)
    idf = weights(frequency, count)
    blocks = max(1, -(-items.count() // block))
    found = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        parsed = [i for r in rows if len((i := Item(r["item_id"], r["text"])).tokens) >= LEAST]
        if parsed:
            lookup = Terms()
            pieces = [lookup.of(p) for i in parsed for p in i.pieces]
            space = latent_space(folded, pieces, idf, rank, passages=passages if whole else None)
            found.append(search(raws, parsed, seen, passages, idf, space, cosine, sure, likely, answer))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, matched long, covered double, answered double")
    return reduce(DataFrame.unionByName, found).dropDuplicates(["doc_id", "item_id"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, into which no item leaks."""
    leaks = decontaminate(docs, benchmark, **options).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, docs.doc_id.eqNullSafe(F.col("__leak")), "left_anti")
