"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotemill.llm import spelling


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def plain_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return total


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=6, frequent=5, ratio=5):
    counts = {w: n for w, n in plain_counts(rows).items() if len(w) >= least and n >= frequent}
    # Near words share what is left when any one code point is taken out of either.
    groups = {}
    for w in counts:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            groups.setdefault(x, []).append(w)
    near = {w: set() for w in counts}
    for held in groups.values():
        for a in held:
            near[a].update(b for b in held if b != a and one_edit(a, b))
    form = {}
    for w, others in near.items():
        if others and counts[best := min(others, key=lambda x: (-counts[x], x))] >= ratio * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        last = w
        while last in form:
            last = form[last]
        out.add((w, form.get(w), last, n, len(near[w]), counts.get(form.get(w))))
    return out


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("name", ["small", "odd", "none"])
def test_as_brute_force(request, name):
    docs = request.getfixturevalue(name)
    assert got(spelling.variants(docs)) == plain_variants(rows_of(docs))


@pytest.mark.parametrize("least", [1, 2, 5, 6])
def test_dense_words(spark, least, monkeypatch):
    """Few letters, so that nearly all words have neighbours; chains of forms; words of every length."""
    monkeypatch.setattr(spelling, "PER_SALT", 3)
    rnd = random.Random(least)
    words = sorted({"".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 9))) for _ in range(700)})
    # Two in five are frequent, so that forms chain.
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(150)]
    rows += [(1000 + k, " ".join([w] * 5 ** rnd.randint(1, 4))) for k, w in enumerate(rnd.sample(words, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(docs, least)) == plain_variants(rows, least)


def test_very_long_words(spark):
    """Words of fifty thousand letters take as many rounds as their branches, not their letters."""
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh") for _ in range(50_000))
    texts = [long, long + "x", "x" + long, long[:20_000] + long[20_001:], long[:30_000] + "y" + long[30_001:], long[::-1]]
    rows = [(i, " ".join([t] * (5 if k else 40))) for i, (k, t) in enumerate(enumerate(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {t: n for t, n in plain_counts(rows).items() if n >= 5}
    found = {r.word: (r.n_near, r.form == long) for r in spelling.variants(docs).collect()}
    assert set(found) == set(words)
    for t in texts[1:5]:
        if t in words and long in words:
            assert found[t] == (1, True)
    assert found[long][0] == sum(t in words for t in texts[1:5])


def test_no_damage_counts_words_as_they_are(spark):
    docs = spark.createDataFrame([(k, "Colour colour ÀÉ×÷ xĀcolour") for k in range(400)], "doc_id long, text string")
    counts = {r.word: r.n for r in spelling.word_counts(docs, damage=False).collect()}
    assert counts == {"colour": 1200, "ÀÉ×÷": 400, "x": 400}


def test_colliding_hashes(spark, monkeypatch):
    """Nodes that share a hash add states, and neither lose nor add pairs."""
    monkeypatch.setattr(spelling, "MODULUS", 5)
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["abcdef", "abcdeg", "abcde", "bbcdef", "xyzxyz", "xyzxyzz", "fedcba"])], "wid long, word string")
    pairs = {(r.word, r.near) for r in spelling.neighbours(words, 5).collect()}
    known = [r.word for r in words.collect()]
    # A hash that short may name prefixes that are no words; the caller's join drops them.
    assert {p for p in pairs if p[1] in known} == {(a, b) for a in known for b in known if one_edit(a, b)}


def test_roots(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("v", "w3"), ("lone", "end")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {f"w{k}": "w11" for k in range(11)} | {"v": "w11", "lone": "end"}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).where(F.lit(True)).collect() == []
