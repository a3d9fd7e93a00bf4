"""Language ID, quality, language model: held-out accuracy, brute force, and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import language, language_model, quality
from quotemill.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_dedup import lower


def left(i, divisor):
    return zlib.crc32(str(i).encode()) % divisor


def test_language_id(small):
    known = {r.doc_id: r.lang for r in small.collect()}
    got = language.language_id(small).collect()
    assert len(got) == len(known) and all(r.held_out == (left(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) > 0.95 * len(held)
    # Labels, sources and ids of the rows that are predicted do not count.
    blank = small.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(blank.withColumn("source", F.lit("s"))).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_language_id_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in language.language_id(odd).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} - {None} == {1, 2, 3, 11} and got[1].score == 0
    assert got[None].held_out is False and language.language_id(odd).count() == odd.count()
    assert language.language_id(none).count() == 0 and language.keep_known(none).count() == 0
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9, 10, 12, 13}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_features_do_not_depend_on_pieces(monkeypatch, piece):
    texts = ["", "a", "ab", "Straße, 12 ÉTÉ!  x", "word " * 40, "12 !!", " a b  c ", "ΟΔΟΣ ΣΑΣ", "".join(chr(97 + i * i % 26) + " " * (i % 3) for i in range(64))]
    whole = [language.features(t) for t in texts]
    monkeypatch.setattr(language, "PIECE", piece)
    for text, want in zip(texts, whole):
        got = language.features(text)
        assert (got is None) == (want is None) == (not any(map(str.isalpha, text)))
        if want is not None:
            np.testing.assert_array_equal(got, want)


def test_every_language_is_learned(spark, monkeypatch):
    """More than a hundred languages with a single text each, in eleven families."""
    signs = "abcdefghijklmnopqrstuvwxyz"
    codes = [f"{a}{b}x" for a in signs[:11] for b in signs[:10]]
    monkeypatch.setattr(language, "FAMILY_OF", {code: code[0] for code in codes})
    rows = [(i, f"{code} {code[::-1]} " * 5, code) for i, code in enumerate(codes)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(codes)
    got = [lang for lang, _ in model.predict([t for _, t, _ in rows])]
    assert sum(a == c for a, (_, _, c) in zip(got, rows)) >= 0.9 * len(rows)


def test_nothing_to_learn_keeps_what_has_letters(spark):
    rows = [(i, f"plain words {i}", None) for i in range(50)] + [(90, "12 !!", None), (91, "", None), (92, None, None), (93, "ж", None)]
    kept = language.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in kept.collect()} == {*range(50), 93}


def test_machines_separate_and_vote():
    """A machine against its loss by small steps in every direction; the vote against sums written out."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (60, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 * rng.normal(0, 1, 60) > 0, 1, -1).astype(np.float32)
    w = language.fit_machine(x, y, rounds=3000).astype(float)

    def loss(v):
        full = np.hstack([x, np.ones((60, 1))])
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        return 0.5e-3 * v @ v + (share * np.maximum(0, 1 - y * (full @ v)) ** 2).sum()

    for k in range(6):
        for step in (-0.01, 0.01):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) > loss(w)
    model = language.Model({}, ["de", "en", "nl"])
    margin = {("language", "de", "en"): 1.0, ("language", "de", "nl"): -0.2, ("language", "en", "nl"): 0.4}
    odds = {k: 1 / (1 + np.exp(-4 * v)) for k, v in margin.items()}
    total = {
        "de": odds["language", "de", "en"] + odds["language", "de", "nl"],
        "en": 1 - odds["language", "de", "en"] + odds["language", "en", "nl"],
        "nl": 2 - odds["language", "de", "nl"] - odds["language", "en", "nl"],
    }
    name = max(total, key=total.get)
    assert model.choose("language", ["de", "en", "nl"], margin) == (name, pytest.approx(total[name] / 2))


def test_families_come_first():
    machines = {("family", "germanic", "romance"): np.zeros(language.WIDTH + 1), ("language", "de", "en"): np.zeros(language.WIDTH + 1)}
    machines[("family", "germanic", "romance")][-1] = 2.0
    machines[("language", "de", "en")][-1] = -2.0
    lang, score = language.Model(machines, ["de", "en", "fr"]).predict(["abc"])[0]
    assert lang == "en" and score == pytest.approx((1 / (1 + np.exp(-8))) ** 2)


def test_quality(spark, small):
    labels = table(spark, SMALL, "labels")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality(small, labels).collect()
    assert len(got) == small.count()
    assert all(r.held_out == (left(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    judged = [r for r in got if r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in judged) >= 0.9 * len(judged)
    # Labels of held-out rows do not count.
    blind = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert {(r.doc_id, r.score) for r in quality.quality(small, blind).collect()} == {(r.doc_id, r.score) for r in got}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 1), (13, 0), (99, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(odd, labels.where("false")).collect()} == {0.5}
    assert quality.quality(none, labels).count() == 0


def test_features_of_long_texts_are_those_of_short_ones():
    """Counts over a whole text, whatever its length, against their plain definitions."""
    words = [b"w%d" % (i * i % 1000) for i in range(280_000)]
    found = dict(zip(quality.FEATURES, quality.features(b" ".join(words)), strict=True))
    assert found["distinct"] == len(set(words)) / len(words)
    assert found["top_word"] == max(Counter(words).values()) / len(words)
    assert found["repeat_next"] == sum(a == b for a, b in zip(words, words[1:])) / len(words)
    assert found["same_length"] == sum(len(a) == len(b) for a, b in zip(words, words[1:])) / len(words)
    assert dict(zip(quality.FEATURES, quality.features(b""), strict=True))["distinct"] == 0


def test_additive_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] - 0.5) * (x[:, 1] - 0.5) > 0).astype(float)
    model = quality.Additive(pairs=2).fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    plain = quality.Additive(pairs=0).fit(x[:3000], y[:3000])
    assert ((plain.score(x[3000:]) > 0.5) == y[3000:]).mean() < 0.7


def tokens(text):
    return [w for w in lower(text).encode().split()]


@pytest.mark.parametrize("name", ["small", "odd", "none"])
@pytest.mark.parametrize("head, own", [(200_000, 16_384), (40, 10)])
def test_language_model(request, name, head, own):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    train = Counter()
    for i, words in rows:
        if i is not None and left(i, 7) != 2:
            train.update([*words, None])
    total, kinds = sum(train.values()), len(train)
    got = language_model.score_texts(docs, rounds=1, head=head, own=own, start_rounds=3).collect()

    def base(words):
        return sum(np.log10((train[w] + 1) / (total + kinds + 1)) for w in [*words, None])

    want = Counter((i, len(w) + 1, sum(train[x] > 0 for x in [*w, None]), round(base(w), 5)) for i, w in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == total and np.isfinite(r.score) for r in got)
    assert all(r.held_out == (r.doc_id is not None and left(r.doc_id, 7) == 2) for r in got)
    if name == "small":
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_forward_is_the_sum_over_all_paths():
    chain = language_model.Chain.random(3, np.array([0.2, 0.3, 0.5]))
    texts = [np.array(t, dtype="<u2") for t in ([0], [2, 1], [1, 1, 0, 2, 2], [2] * 4)]
    got = language_model.log_likelihoods(chain, texts)
    for text, value in zip(texts, got, strict=True):
        state = chain.start * chain.emit[text[0]]
        for t in text[1:]:
            state = (state @ chain.move) * chain.emit[t]
        assert 10**value == pytest.approx(state.sum())
    # All texts of one length: probabilities add up to one.
    every = [np.array([a, b, c]) for a in range(3) for b in range(3) for c in range(3)]
    assert (10 ** language_model.log_likelihoods(chain, every)).sum() == pytest.approx(1)


def test_expected_counts_against_plain_forward_backward():
    chain = language_model.Chain.random(2, np.array([0.2, 0.3, 0.5]))
    segments = [(np.array([0, 2, 1, 1]), True), (np.array([2, 2]), False), (np.array([1]), True)]
    want = np.zeros((3 + 2 + 1, 2))
    for text, first in segments:
        paths = np.stack(np.meshgrid(*[range(2)] * len(text), indexing="ij"), -1).reshape(-1, len(text))
        weight = np.array([
            (chain.start[p[0]] if first else 0.5) * np.prod(chain.emit[text, p]) * np.prod(chain.move[p[:-1], p[1:]]) for p in paths
        ])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t, s in enumerate(p):
                want[text[t], s] += w
                if t:
                    want[3 + p[t - 1], s] += w
            want[-1, p[0]] += w * first
    np.testing.assert_allclose(language_model.expected_counts(chain, segments), want, atol=1e-12)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 4, 30) + 4 * (i % 2) for i in range(40)]
    prior = np.full(8, 1 / 8)
    chain, scores = language_model.Chain.random(2, prior), []
    for _ in range(15):
        scores.append(language_model.log_likelihoods(chain, texts).sum())
        chain = language_model.Chain.of(language_model.expected_counts(chain, [(t, True) for t in texts]), prior * 0.01)
    assert all(b > a - 1e-6 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0] + 100
