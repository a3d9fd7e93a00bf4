"""Byte-pair encoding by a dynamic programme over prefixes, and decoding.

A text is cut into words as the tokenizer file says: its special tokens, then NFC, white space and case, then its
split pattern. A word is a string of symbols, one per byte; its last symbol carries the end-of-word mark, so that it
is another symbol than the same byte inside a word. Merging pairs by rank gives every prefix of such a string
exactly one encoding, whose last token is unique:

* an automaton over the vocabulary (a trie with suffix links) lists, for each prefix, all tokens that end it;
* a token t ends the encoding of a prefix if it follows p, the last token of the prefix without t, compatibly: merging p
  and t side by side by rank leaves the two as they are. Undoing their merges from the latest to the earliest
  shows it: the pair is broken if, at any point, the two tokens that touch would have merged earlier than what is
  undone there;
* each prefix keeps its one token; from the whole word, tokens lead back to its start.

A word of n bytes takes n steps, and a step as many tests as tokens end there (each test is remembered), so one word of
megabytes is linear work. Tokens that merging never yields (none in the files at hand) are left out of the automaton.

Words between white space repeat: each worker remembers their ids in two generations of bounded size. Texts never leave
their task; there is no shuffle.

Defined results: null and empty texts, and texts of white space alone, have no ids and decode to an empty text.
Null ids, repeated rows and an empty table pass through row by row; other columns of the input are ignored. Decoding
joins the names of the tokens by a space, as a file without a decoder asks for; null ids are read as none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import texts
from quotemill.llm.packing import BYTE_CHARS, vocabulary
from quotemill.session import ship_package

MARK = "</w>"
#: Added to the last symbol of a word; above every symbol of a byte.
FINAL = 0x400
#: Rank of a symbol that no merge makes, and of no limit.
BASE, NONE = -1, 1 << 60
#: Entries of one generation of the caches, and the longest word in bytes that is worth one.
CACHE, LONG = 250_000, 64
#: Pair tests that are remembered at a time.
PAIRS = 300_000
#: Bytes of text encoded at a time; a longer text is encoded on its own.
PART = 2 << 20
# The file's split pattern for texts of ASCII alone, in lower case; white space is the space and 9 to 13.
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")
#: A stop or comma that ends a word; white space may be put before it without a change of the words.
STOP = re.compile(rb"(?<=[a-z])[.,](?=[\x20\x09-\x0D]|\Z)")
#: Words of letters that neither normalisation nor the split pattern changes.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


class Merges:
    """The vocabulary as numbers: for each token its two parts and its rank, and the pairs that merge."""

    def __init__(self, vocab: dict[str, int], merges: list):
        def symbols(name: str) -> str:
            return name[: -len(MARK) - 1] + chr(ord(name[-len(MARK) - 1]) + FINAL) if name.endswith(MARK) and len(name) > len(MARK) else name

        self.names = {symbols(name): i for name, i in vocab.items()}
        self.rank = dict.fromkeys(vocab.values(), BASE)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            self.merged[vocab[left], vocab[right]] = (rank, made)
            if made not in self.parts:
                self.parts[made] = (vocab[left], vocab[right])
                self.rank[made] = rank

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their symbols are merged side by side."""
        limit = NONE
        while True:
            met = self.merged.get((left, right))
            if met is not None and met[0] < limit:
                return False
            if self.rank[left] > self.rank[right]:
                limit = self.rank[left]
                left = self.parts[left][1]
            elif self.rank[right] == BASE:
                return True
            else:
                # On equal ranks the left one merges first, so what is left of this merge may not be of its rank.
                limit = self.rank[right] + 1
                right = self.parts[right][0]

    def whole(self, token: int) -> bool:
        """Whether merging by rank yields this token from its symbols: its two parts each are so, and are compatible
        up to the merge that makes it."""
        if self.rank[token] == BASE:
            return True
        left, right = self.parts[token]
        limit = self.rank[token]
        while True:
            met = self.merged.get((left, right))
            if met is not None and met[0] < limit:
                return False
            if self.rank[left] > self.rank[right]:
                limit = min(limit, self.rank[left])
                left = self.parts[left][1]
            elif self.rank[right] == BASE:
                return True
            else:
                limit = min(limit, self.rank[right] + 1)
                right = self.parts[right][0]


class PrefixEncoder:
    """Words to ids, prefix by prefix."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.merges = Merges(vocab, merges)
        self.automaton = ahocorasick.Automaton()
        sound: dict[int, bool] = {}
        for name, token in sorted(self.merges.names.items(), key=lambda x: (len(x[0]), x[1])):
            # Shorter tokens come first, so both parts are judged before what they make.
            parts = self.merges.parts.get(token, ())
            sound[token] = all(sound[p] for p in parts) and self.merges.whole(token)
            if sound[token]:
                self.automaton.add_word(name, (len(name), token))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, a string of symbols."""
        single = self.automaton.get(symbols, None)
        if single is not None:
            return [single[1]]
        # Token and width of what ends each prefix; -1 while there is none.
        last, widths = [-1] * len(symbols), [1] * len(symbols)
        pairs = self.pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        for end, (width, token) in self.automaton.iter(symbols):
            if last[end] >= 0:
                continue
            start = end - width
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.merges.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
            widths[end] = width
        out, end = [], len(symbols) - 1
        while end >= 0:
            # A symbol that the vocabulary lacks gives no token.
            if last[end] >= 0:
                out.append(last[end])
            end -= widths[end]
        return out[::-1]


class Encoder:
    """Whole texts to ids, with a cache of what stands between white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.special = special
        self.split = re.compile("|".join(f"({re.escape(x)})" for x in sorted(special, key=len, reverse=True)) or "(?!)")
        self.bytes_split = re.compile("|".join(re.escape(x) for x in special).encode() or b"(?!)")
        self.prefixes = PrefixEncoder(model["model"]["vocab"], model["model"]["merges"])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _mark(self, symbols: str) -> str:
        return symbols[:-1] + chr(ord(symbols[-1]) + FINAL)

    def _chunk(self, raw: bytes) -> list[int]:
        """Ids of what stands between white space."""
        word, bare = self.prefixes.word, raw.isascii()
        if bare and not self.bytes_split.search(raw):
            return [i for w in ASCII_WORDS.findall(raw.lower()) for i in word(self._mark(w.decode("latin-1").translate(BYTE_CHARS)))]
        text = raw.decode("utf-8", "replace")
        if LETTERS.fullmatch(text):
            return word(self._mark(raw.decode("latin-1").translate(BYTE_CHARS)))
        ids: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    ids += word(self._mark(symbols))
        return ids

    def _known(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old, known = self.young, self.old, {}
        for chunk in chunks:
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    ids = np.array(self._chunk(chunk), np.int32).tobytes()
                if len(chunk) <= LONG:
                    young[chunk] = ids
            known[chunk] = ids
        return known

    def batch(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers one after the other."""
        # Case is left to the normaliser where a special token could come about by lowering.
        split = [STOP.sub(rb" \g<0>", raw if b"<|" in raw else raw.lower()).split() for raw in raws]
        known = self._known(set().union(*split))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its cache serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(rows: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in rows), np.int64, len(rows))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text; with `decoded`, also the `text` that they decode to.

    Results leave in batches of about PART bytes of text, so that a task holds few of them.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = encoder(path), _names(path)
        for batch in batches:
            raws = batch.column("raw")
            sizes = pc.fill_null(pc.binary_length(raws), 0).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PART, append=-1)) + 1
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                ids = own.batch(raws.slice(begin, end - begin).to_pylist())
                out = {"doc_id": batch.column("doc_id").slice(begin, end - begin), "ids": _lists(ids)}
                if decoded:
                    out["text"] = pa.array([" ".join(names[np.frombuffer(x, np.int32)]) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`rows` (doc_id, ids) with `text`: the names of the tokens, joined by a space."""
    path = path or vocabulary()
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = _names(path)
        for ids in batches:
            yield pd.Series([" ".join(names[np.asarray(x, np.int64)]) for x in ids], dtype=object)

    udf = F.pandas_udf(run, "string")
    none = F.array().cast("array<int>")
    return rows.select("doc_id", "ids", udf(F.coalesce("ids", none)).alias("text"))


_known_names: dict[str, np.ndarray] = {}


def _names(path: str) -> np.ndarray:
    if path not in _known_names:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        found = {i: name for name, i in model["model"]["vocab"].items()} | {x["id"]: x["content"] for x in model["added_tokens"]}
        table = np.full(max(found) + 1, "", object)
        table[list(found)] = list(found.values())
        _known_names[path] = table
    return _known_names[path]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded text."""
    rows = encode(docs, path, decoded=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
