"""Language ID by hierarchical discrimination.

A text is first put into a language family; one-versus-one linear support vector machines then tell the languages
of that family apart. Families are told apart by machines of the same kind. The features are hashed counts of one
to three letters, word bounds included, over the whole text, square-rooted and scaled to length one.

Every machine is fitted in a task of its own on at most about `per_language` texts of each of its languages, drawn
by a hash of the id in the same share everywhere (the bound is in expectation). Every language that has a text with a
letter is learned, so the model grows with the number of languages, and with the square of those of one family. Prediction
reads the text alone.

Defined results: a null text, a text without letters, and any text when no language could be learned give `und`
with score 0; in the last case `keep_known` keeps all texts that have a letter, since nothing speaks against them. Ties between languages go to the first in alphabetical order. Rows with a null id are never learned
from and count as not held out. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import remainder, stored
from quotemill.session import ship_package

UNKNOWN = "und"
WIDTH = 1 << 12
#: Characters looked at together; longer texts are counted piece by piece, to the same counts.
PIECE = 1 << 20
STEEPNESS = 4.0

# ISO 639-1 codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayic": ("id", "ms", "jv", "tl"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """The feature vector of a whole text, or None if it has no letter."""
    counts, low = np.zeros(WIDTH, dtype=np.int64), (text or "").lower()
    # The last two codes so far, and how many there are; a text begins with a gap.
    last, known, in_word, seen = np.zeros(2, dtype=np.uint32), 1, False, False
    for at in range(0, len(low) + 1, PIECE):
        codes = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "replace"), dtype="<u4")
        is_letter = letters()[codes]
        seen = seen or bool(is_letter.any())
        codes = np.where(is_letter, codes, 0).astype(np.uint32)
        # One gap between words, and one at either end.
        codes = codes[is_letter | np.concatenate(([in_word], is_letter[:-1]))[: len(codes)]]
        in_word = bool(is_letter[-1]) if len(is_letter) else in_word
        if at + PIECE > len(low):
            codes = np.append(codes, np.uint32(0))
        if not at:
            counts += _counted(np.zeros(1, dtype=np.uint32) * np.uint32(0x9E3779B1))
        codes = np.concatenate((last[2 - known :], codes)).astype(np.uint32)
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0x165667B1)
        # Only what ends behind the codes that were carried over is new.
        for h in (one[known:], two[known - 1 :], three[max(0, known - 2) :]):
            counts += _counted(h)
        known = min(2, len(codes))
        last[2 - known :] = codes[len(codes) - known :]
    if not seen:
        return None
    root = np.sqrt(counts).astype(np.float32)
    return root / np.linalg.norm(root)


def _counted(h: np.ndarray) -> np.ndarray:
    return np.bincount((h ^ (h >> np.uint32(16))) & np.uint32(WIDTH - 1), minlength=WIDTH)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights and offset of a linear support vector machine (squared hinge, classes weighted alike), y in -1, 1."""
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), dtype=np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    rate, pull = 1.0 / (4.0 + penalty), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * x.T @ (share * y * slack))
        again = (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        ahead, w, pull = step + (pull - 1) / again * (step - w), step, again
    return w


class Model:
    """Machines by pair of classes: (family, family), and (language, language) within a family."""

    def __init__(self, machines: dict[tuple[str, str, str], np.ndarray], languages: list[str]):
        self.languages = sorted(languages)
        self.members: dict[str, list[str]] = {}
        for lang in self.languages:
            self.members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        self.keys = sorted(machines)
        self.weights = np.array([machines[k] for k in self.keys], dtype=np.float32).reshape(-1, WIDTH + 1)

    def choose(self, level: str, names: list[str], margin: dict) -> tuple[str, float]:
        """The class with most probability against the others, and its mean probability."""
        best = (names[0], 1.0)
        if len(names) > 1:
            total = dict.fromkeys(names, 0.0)
            for a, b in combinations(names, 2):
                p = 1 / (1 + np.exp(-STEEPNESS * margin[(level, a, b)]))
                total[a] += p
                total[b] += 1 - p
            name = max(names, key=lambda n: total[n])
            best = (name, total[name] / (len(names) - 1))
        return best

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for text in texts:
            vector = features(text) if self.languages else None
            if vector is None:
                out.append((UNKNOWN, 0.0))
                continue
            margin = dict(zip(self.keys, self.weights[:, :-1] @ vector + self.weights[:, -1], strict=True))
            family, sure = self.choose("family", self.families, margin)
            lang, surer = self.choose("language", self.members[family], margin)
            out.append((lang, float(min(1.0, max(0.0, sure * surer)))))
        return out


def fit(learnable: DataFrame, per_language: int = 600) -> Model:
    """Fit on rows (doc_id, text, lang), all of which may be learned from."""
    spark = learnable.sparkSession
    ship_package(spark)
    rows = learnable.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({}, [])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    sample = rows.where(F.col("lang").isin(*sizes) & drawn).select("doc_id", "text", "lang")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(lang, v.astype(np.float16).tobytes()) for lang, t in zip(pdf["lang"], pdf["text"], strict=True) if (v := features(t)) is not None]
            yield pd.DataFrame(found, columns=["lang", "vector"])

    sample = stored(sample.mapInPandas(vectors, "lang string, vector binary"))
    languages = [r["lang"] for r in sample.select("lang").distinct().collect()]
    members: dict[str, list[str]] = {}
    for lang in sorted(languages):
        members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    duels = [("family", a, b, lang, FAMILY_OF.get(lang, lang) == a) for a, b in combinations(sorted(members), 2) for lang in members[a] + members[b]]
    duels += [("language", a, b, lang, lang == a) for names in members.values() for a, b in combinations(names, 2) for lang in (a, b)]
    if not duels:
        return Model({}, languages)

    def machine(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["vector"]), dtype=np.float16).reshape(len(pdf), WIDTH)
        w = fit_machine(x, np.where(pdf["first"], 1, -1).astype(np.float32))
        key = pdf.iloc[:1][["level", "a", "b"]].copy()
        key["weights"] = [w.astype(np.float32).tobytes()]
        return key

    sides = F.broadcast(spark.createDataFrame(duels, "level string, a string, b string, lang string, first boolean"))
    fitted = sample.join(sides, "lang").groupBy("level", "a", "b").applyInPandas(machine, "level string, a string, b string, weights binary")
    return Model({(r["level"], r["a"], r["b"]): np.frombuffer(r["weights"], dtype=np.float32) for r in fitted.collect()}, languages)


def predictor(model: Model, docs: DataFrame) -> Column:
    """lang and score of the column `text`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            yield pd.DataFrame(held.value.predict(list(series)), columns=["lang", "score"])

    return F.pandas_udf(each, "lang string, score double")(F.col("text"))


def learnable(docs: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id, modulo 4, is not 2."""
    return docs.select("doc_id", "text", "lang").where(remainder(4) != 2)


def language_id(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(learnable(docs), per_language)
    guess = docs.select("doc_id", "text").withColumn("guess", predictor(model, docs))
    return guess.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("guess.lang").alias("lang_pred"), "guess.score")


def keep_known(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """The rows of `docs`, all columns, whose language is not `und`; without a label to learn from, those with a letter."""
    model = fit(learnable(docs), per_language)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.withColumn("__guess", predictor(model, docs)).where(F.col("__guess.lang") != UNKNOWN).select(*docs.columns)
