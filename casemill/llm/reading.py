"""Reading level of each document: a linear pairwise ranker over syntax and vocabulary features, calibrated into bands.

One Arrow pass per document counts words by language and computes the features of its running prose: word and sentence lengths,
shares of long words, punctuation, and the mean difficulty of its vocabulary (each word's average band among the graded
documents). The ranker learns from pairs of graded documents with different bands (logistic loss on feature differences);
isotonic regression maps its scores to the bands' scale, and the nearest band is the level.

Training reads at most ``MAX_GRADED`` graded documents (those with the least hash of their id) and ``MAX_PAIRS`` pairs; that bound
is the only sample, every document is scored. A document's grade is the mean of its annotators. Null and empty texts and texts
in other languages get no level; very long texts are read whole; repeated rows get equal levels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GRADED = 6_000
MAX_PAIRS = 60_000
SEED = 7

# Frequent words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the and of to was that by on with at before because which this not is for from after it".split(),
    "es": "el la los las que de en una por con del se al para su como más fue lo".split(),
    "fr": "le les des et une dans que qui est du pour sur pas au par il elle été la de".split(),
    "de": "der die das und den dem ein eine nicht ist zu mit auf für von wurde hat im des sich".split(),
}
_ENGLISH = frozenset(FUNCTION_WORDS["en"])
_OTHER = {k: frozenset(v) - _ENGLISH for k, v in FUNCTION_WORDS.items() if k != "en"}
_OUTER = ".,;:!?()[]{}\"'“”‘’«»¿¡-–—…¶§*/|"
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-­¬‐] ?\n(?=[a-zà-ÿ])")
_SUBORDINATE = frozenset("although whereas notwithstanding whereupon inasmuch insofar unless provided because while after before if though since until".split())
_PERSONAL = frozenset("i we he she they you me my our his her their us him them".split())
NAMES = ("word", "long7", "long10", "long13", "sentence", "clauses", "subordinate", "personal", "variety", "deep", "vocabulary", "hard", "easy")


def prose(text: str) -> str:
    """Lines that read as running text, words mended at line ends; short lines and headings in capitals are left out."""
    if "\n" not in text:
        return text
    lines = [x for x in _BROKEN.sub("", text).split("\n") if len(x) >= 40 and not x.isupper()]
    return " ".join(lines) if lines else text


def word_counts(body: str) -> Counter[str]:
    """Words without the punctuation around them; each distinct token is stripped once."""
    out: Counter[str] = Counter()
    for t, k in Counter(body.lower().split()).items():
        w = t if t.isalpha() else t.strip(_OUTER)
        if w and not w[0].isdigit():
            out[w] += k
    return out


def is_english(words: Counter[str]) -> bool:
    en = sum(words[w] for w in _ENGLISH)
    return en > 0 and en >= max(sum(words[w] for w in ws) for ws in _OTHER.values())


class Words:
    """What the features need of a word, looked up once: (letters, 7+, 10+, 13+, subordinating, personal, known, grade, hard, easy)."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.vocabulary, self.seen = vocabulary, {}

    def __call__(self, w: str) -> tuple[float, ...]:
        if (got := self.seen.get(w)) is None:
            m, g = len(w), self.vocabulary.get(w)
            got = (m, m >= 7, m >= 10, m >= 13, w in _SUBORDINATE, w in _PERSONAL, g is not None, g or 0.0, g is not None and g > 3.7, g is not None and g < 2.3)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = got
        return got


def features(text: str | None, words: Words) -> list[float] | None:
    """Feature values in the order of NAMES, None if the text is not English or has no words."""
    if not text:
        return None
    body = prose(text)
    counts = word_counts(body)
    if not counts or not is_english(counts):
        return None
    n = sum(counts.values())
    sentences = max(1, len(_SENTENCE.findall(body)))
    k = np.fromiter(counts.values(), float, len(counts))
    length, long7, long10, long13, sub, per, known, grade, hard, easy = k @ np.array([words(w) for w in counts], dtype=float)
    return [
        length / n, long7 / n, long10 / n, long13 / n, math.log(n / sentences), body.count(",") / n, sub / n, per / n, len(counts) / math.sqrt(n), math.log1p(length / sentences),
        grade / max(known, 1), hard / max(known, 1), easy / max(known, 1),
    ]


def learn_vocabulary(graded: list[tuple[str, float]]) -> dict[str, float]:
    """Mean grade of the documents in which a word stands, shrunk to the mean of all; words of five documents or more."""
    total, seen = Counter(), Counter()
    mean = sum(g for _, g in graded) / max(1, len(graded))
    for text, g in graded:
        for w in word_counts(prose(text)):
            total[w] += g
            seen[w] += 1
    return {w: (total[w] + 5 * mean) / (k + 5) for w, k in seen.items() if k > 4}


def learn_ranker(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Weights that put the harder document of a pair first (logistic loss on differences, Newton steps)."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(y), MAX_PAIRS), rng.integers(0, len(y), MAX_PAIRS)
    ok = y[i] != y[j]
    d = (x[i] - x[j])[ok] * np.sign(y[i] - y[j])[ok, None]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = d.T @ p - 1e-2 * len(d) * w / 100
        hess = (d * (p * (1 - p))[:, None]).T @ d + 1e-2 * len(d) / 100 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (thresholds, values) of the non-decreasing step function nearest to y."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least score
    for k in order:
        blocks.append([float(y[k]), 1.0, float(score[k])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _ = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + m * n) / (b[1] + n)
            b[1] += n
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    """Vocabulary, scaling, ranker and calibration."""

    def __init__(self, graded: list[tuple[str, float]]) -> None:
        """``graded``: (text, mean band). Words are graded on other documents than those that the ranker learns from."""
        half = [graded[::2], graded[1::2]]
        rows, y = [], []
        for a, b in ((0, 1), (1, 0)):
            words = Words(learn_vocabulary(half[a]))
            for text, g in half[b]:
                if (f := features(text, words)) is not None:
                    rows.append(f)
                    y.append(g)
        self.words = Words(learn_vocabulary(graded))
        self.ready = len(set(y)) > 1
        if not self.ready:
            return
        x, y = np.array(rows), np.array(y)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        self.weights = learn_ranker(z, y)
        self.at, self.value = isotonic(z @ self.weights, y)

    def levels(self, texts: list[str | None]) -> list[int | None]:
        out: list[int | None] = [None] * len(texts)
        if not self.ready:
            return out
        got = [(k, f) for k, t in enumerate(texts) if (f := features(t, self.words)) is not None]
        if got:
            s = (np.array([f for _, f in got]) - self.mean) / self.scale @ self.weights
            v = self.value[np.clip(np.searchsorted(self.at, s, side="right") - 1, 0, len(self.at) - 1)]
            for (k, _), b in zip(got, np.clip(np.floor(v + 0.5), 1, 5).astype(int)):
                out[k] = int(b)
        return out


def reading_levels(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MAX_GRADED) -> DataFrame:
    """(id, reading_band) for every English document. ``labels``: (id_col, reading_band), several rows a document allowed."""
    grades = labels.where("reading_band BETWEEN 1 AND 5").groupBy(F.col(id_col).alias("id")).agg(F.avg("reading_band").alias("grade"))
    chosen = grades.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    graded = [(r["text"], float(r["grade"])) for r in texts.join(F.broadcast(chosen), "id").where("text IS NOT NULL").orderBy("id").select("text", "grade").collect()]
    model = documents.sparkSession.sparkContext.broadcast(Model(graded))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.levels(b.column(1).to_pylist()), pa.int32())], names=["id", "reading_band"])

    return texts.mapInArrow(run, f"id {kind}, reading_band int").where("reading_band IS NOT NULL")
