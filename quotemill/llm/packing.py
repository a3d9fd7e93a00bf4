"""Hierarchical multi-length packing of tokenised documents.

Every document is tokenised once, as it is read, and routed to the smallest context size (tier) that holds it;
longer ones go to the longest tier. Documents are dealt by a hash of their id and text, and of their
number if rows repeat, into groups of about `group_chars` characters. Within a group the tiers are packed from long to short: a tier's documents, in id order,
fill windows of its size end to end, and the gap that is left in its last window is filled from the next shorter
tier. So only the very last window of a group can have padding. Windows are dealt to step groups of `step_tokens`
tokens each; windows are powers of two in falling order, so step groups are equal.

The ids of chunks are cached. White space always ends a token of this vocabulary, and so does the step from a letter to
a stop; it also lowers all letters. So a text's ids are those of its lowered chunks, cut at white space and before a
closing stop or comma, put together.

Defined results: null and empty texts give the closing id alone, as one piece. Repeated rows are packed each on
its own; within a group they are told apart by their order. Null ids are packed. An empty table gives no rows.
A group holds whole documents only; its memory is bounded by `group_chars` plus the longest document.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.common import partitions, texts

TIERS = (2048, 1024, 512, 256)
CACHE = 250_000
#: Longest chunk that is worth a place in the cache.
LONG_CHUNK = 64
#: Printable ASCII but the apostrophe, which contractions need, and Latin-1 letters: nothing but case is normalised.
SIMPLE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Its tokens before merges, lowered: words, digits one by one, runs of signs.
PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for
# themselves, the others, in order, from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
END = 1
#: Bytes of text encoded at a time; a longer text is encoded on its own.
PART = 2 << 20
STEP_TOKENS = 8 * 2048

PIECES = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")
    ]
    + [T.StructField("ids", T.BinaryType())]
)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def part_stops(texts: list[bytes]) -> list[bytes]:
    """`texts` with a space before every stop or comma that ends a word of a-z, at white space or the text's end."""
    a = np.frombuffer(b"\n".join(texts), np.uint8)
    at = np.flatnonzero((a == ord(".")) | (a == ord(",")))
    after = a[np.minimum(at + 1, len(a) - 1)]
    ends = (at + 1 == len(a)) | (after == 0x20) | (after - np.uint8(9) < 5)
    at = at[ends & (at > 0) & (a[at - 1] - np.uint8(ord("a")) < 26)]
    whole = np.insert(a, at, 0x20).tobytes()
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts += np.searchsorted(at, starts)
    return [whole[i : j - 1] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


class Encoder(dict):
    """Texts to ids, little-endian 16-bit, through a cache of chunks.

    The cache has two generations: what is used moves to the young one, the dict itself; when that is full, it
    becomes the old one, and what was not used since is forgotten.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.merged = self.tokenizer.model.tokenize
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _encode(self, chunk: bytes) -> bytes:
        """Ids of a chunk. A simple one is put together from its words, digits and runs of signs; each of these is
        one token before merges, so the model alone will do."""
        text = chunk.decode("utf-8", "replace")
        if SIMPLE.fullmatch(text) and "<|" not in text:
            text = text.lower()
            parts = PARTS.findall(text)
            if len(parts) > 1:
                return b"".join([self[p.encode()] for p in parts])
            return array("H", [t.id for t in self.merged(text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
        return array("H", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def batch(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text with the closing id."""
        end, ids = array("H", [END]).tobytes(), self.__getitem__
        # Case is left to the tokenizer where a special token could come about by lowering.
        spaced = part_stops([raw if b"<|" in raw else raw.lower() for raw in raws])
        return [b"".join(map(ids, text.split())) + end for text in spaced]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its cache serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def by_size(pdf: pd.DataFrame, limit: int) -> Iterator[pd.DataFrame]:
    """`pdf` in runs of rows whose texts have about `limit` bytes."""
    size = pdf["raw"].str.len().cumsum() // limit
    for _, part in pdf.groupby(size.to_numpy(), sort=False):
        yield part


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens: 16-bit ids, salt: a number that spreads rows of one id) of every row."""
    path = path or vocabulary()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()

        def salt(key: int | None, raw: bytes) -> int:
            # Rows that are equal throughout are told apart by their task and their number in it; as any of them may
            # take any of their salts, a task that runs again deals out the same rows.
            own_ = xxhash.xxh64_intdigest(raw, 0 if key is pd.NA else key & (1 << 63) - 1)
            n = seen[own_] = seen.get(own_, -1) + 1
            return (xxhash.xxh64_intdigest(f"{own_} {task} {n}") if n else own_) >> 1

        for pdf in batches:
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            for part in by_size(pdf, PART):
                raws = list(part["raw"])
                yield pd.DataFrame({"doc_id": part["doc_id"], "tokens": own.batch(raws), "salt": [salt(i, raw) for i, raw in zip(part["doc_id"].tolist(), raws, strict=True)]})

    return texts(docs).mapInPandas(encode, "doc_id long, tokens binary, salt long")


def layout(counts: np.ndarray, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one group for documents of `counts` tokens sorted from long to short tiers.

    Returns the window's start in the group's stream of tokens, its size, and the tier of each document.
    """
    tier = np.full(len(counts), tiers[0])
    for size in tiers:
        tier[counts <= size] = size
    starts, sizes, at = [], [], 0
    done = 0
    for size in tiers:
        done += int(counts[tier == size].sum())
        need = max(0, -(-(done - at) // size))
        starts.append(at + size * np.arange(need, dtype=np.int64))
        sizes.append(np.full(need, size, dtype=np.int64))
        at += size * need
    return np.concatenate(starts), np.concatenate(sizes), tier


def pack_group(group: int, ids: list, tokens: list[bytes], tiers: tuple[int, ...], step: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    """Pieces of one group, document by document in chunks of bounded size."""
    counts = np.array([len(t) // 2 for t in tokens], dtype=np.int64)
    tier = layout(counts, tiers)[2]
    order = sorted(range(len(ids)), key=lambda i: (-tier[i], ids[i] is None or ids[i] is pd.NA, ids[i] if ids[i] is not pd.NA else 0, tokens[i]))
    counts = counts[order]
    starts, sizes, _ = layout(counts, tiers)
    steps = np.cumsum(sizes) - sizes
    at, rows = 0, []
    for place, i in enumerate(order):
        n = int(counts[place])
        stream = np.frombuffer(tokens[i], dtype="<u2").astype("<u4")
        first = int(np.searchsorted(starts, at, side="right")) - 1
        last = int(np.searchsorted(starts, at + n - 1, side="right")) - 1
        for w in range(first, last + 1):
            begin = max(at, int(starts[w]))
            stop = min(at + n, int(starts[w] + sizes[w]))
            piece = stream[begin - at : stop - at].tobytes()
            rows.append(
                (ids[i], begin - at, stop - begin, zlib.crc32(piece), n, (group << 32) + w, begin - int(starts[w]), int(sizes[w]),
                 (group << 32) + int(steps[w]) // step, piece if with_ids else None)
            )
        at += n
        if len(rows) >= 5000:
            yield _frame(rows)
            rows = []
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=PIECES.names)
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    return pdf


def pack(
    docs: DataFrame,
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    group_chars: int = 1 << 20,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it comes from, where it goes, its ids (32-bit) and their checksum.

    window is the size of the sequence's tier. A sequence is padded to the longest tier unless its length is a
    power of two; only the last one of a group can need it.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers are falling powers of two")
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_chars))
    dealt = tokenised(docs, path).withColumn("grp", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups))).drop("salt")

    def fill(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, tokens = [], []
        for pdf in batches:
            ids += pdf["doc_id"].astype("Int64").tolist()
            tokens += pdf["tokens"].tolist()
        yield from pack_group(int(key[0]), ids, tokens, tiers, step_tokens, with_ids)

    count = min(groups, max(partitions(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism))
    return _grouped_map(dealt.repartition(count, "grp"), fill)


def _grouped_map(dealt: DataFrame, fill: Callable) -> DataFrame:
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PIECES)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group; one group is held at a time.
        key, held = None, []
        for pdf in batches:
            for grp, part in pdf.groupby("grp", sort=False):
                if key is not None and grp != key:
                    yield from fill((key,), iter(held))
                    held = []
                key = grp
                held.append(part)
        if held:
            yield from fill((key,), iter(held))

    return dealt.sortWithinPartitions("grp").mapInPandas(over, names)


def packed(docs: DataFrame, **options) -> DataFrame:
    """The pieces without their ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id."""
    return pack(docs, with_ids=False, **options).drop("ids")

