"""Byte-pair encoding against a plain merge loop and the tokenizers library; decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotemill.llm import bpe
from quotemill.llm.packing import vocabulary

SIGNS = [chr(c) for a, b in ((32, 127), (0x80, 0x250), (0x300, 0x370), (0x370, 0x600), (0x1E00, 0x2100), (0x3000, 0x3100), (0xAC00, 0xAC80), (0x1F600, 0x1F640), (0, 32)) for c in range(a, b)]
PARTS = ["a", "aa", "e", "ing", "th", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", "İ", "Σ", " ", "'s", "'LL", "é", "é", ".", ", "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(raws):
    return [np.frombuffer(x, np.int32).tolist() for x in bpe.encoder(vocabulary()).batch([t.encode() for t in raws])]


def merged_by_rank(symbols, merges):
    """The textbook loop: the pair of lowest rank first, from the left."""
    out = list(symbols)
    while True:
        met = [(merges[a, b], i) for i, (a, b) in enumerate(zip(out, out[1:])) if (a, b) in merges]
        if not met:
            return out
        _, i = min(met)
        out[i : i + 2] = [out[i] + out[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=2, max_size=2), max_size=3), st.text("abc", max_size=14), st.randoms())
def test_any_vocabulary(first, word, rnd):
    """Vocabularies of random merges, unsound tokens among them, give what the merge loop gives."""
    tokens, merges = ["a", "b", "c"], []
    for _ in range(rnd.randint(0, 9)):
        pair = [rnd.choice(tokens), rnd.choice(tokens)]
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    vocab = {t: i for i, t in enumerate(tokens)}
    rank = {tuple(p): i for i, p in enumerate(merges)}
    want = [vocab[t] for t in merged_by_rank(word, rank)]
    assert bpe.PrefixEncoder(vocab, merges).word(word) == want


def test_as_the_library(library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    texts += ["a" * 1001, "ab" * 5000, "z" * 20_000, "", " ", "　"]
    got = ids_of(texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_all_tokens_are_sound():
    own = bpe.encoder(vocabulary()).prefixes
    assert len(own.automaton) == len(own.merges.names)


def test_cache_generations(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.Encoder(vocabulary())
    texts = [f"word{i} again word{i % 5} Ünder" for i in range(40)]
    got = [np.frombuffer(x, np.int32).tolist() for t in texts for x in own.batch([t.encode()])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.old) <= 3 + 6


@pytest.mark.parametrize("name", ["small", "odd", "none"])
def test_round_trip(request, name, library):
    docs = request.getfixturevalue(name)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        want.append((r.doc_id, len(ids), *digest))
    got = [tuple(r) for r in bpe.round_trip(docs).collect()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want, key=key)
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r.text == library.decode(r.ids, skip_special_tokens=False)


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [512])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(rows).collect()} == {1: "", 2: "", 3: "in"}
