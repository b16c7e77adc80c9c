"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features; that document a is preferred to b has the probability
``sigmoid(strength(a) - strength(b))``. Preference pairs are a document labelled 1 against one labelled 0. The weights
minimise the logistic loss on feature differences with an L2 penalty, by Newton steps. The threshold is a quantile of
the strengths: the one below which the share of training documents equals the share labelled 0, moved by ``lenience`` towards
the 0.99 quantile of those labelled 0, if that lies below, so that clean documents at the edge stay. A score is the sigmoid of the strength's distance from the threshold, placed so
that the threshold scores ``cut``.

Features are counted on the bytes of the whole text (kinds of characters, words, lines, repeats), no label, language,
source or id among them. Training uses at most ``max_rows`` labelled rows, those with the smallest hashes of their id,
and ``pairs`` pairs; both bounds are parameters. Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import crc_mod, release_memory, table, written

MAX_ROWS, PAIRS, CUT = 20_000, 60_000, 0.3
#: Kinds of bytes: each feature is the share of its bytes in all that are no white space.
KINDS = {
    "symbols": b"#*$%&|<>", "marks": b".,;:", "bangs": b"!?", "digits": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
    "vowels": b"aeiouAEIOU", "brackets": b"()[]{}=_/\\@~^`+", "quotes": b"\"'-", "high": bytes(range(128, 256)), "control": bytes(range(0, 9)) + bytes(range(14, 32)) + b"\x7f",
}
_CLASS = np.zeros((256, len(KINDS)))
for _i, _chars in enumerate(KINDS.values()):
    _CLASS[list(_chars), _i] = 1.0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str | None) -> np.ndarray:
    """Features of a whole text; null counts as empty. Sizes enter by logarithm."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = int(counts[~_SPACE].sum())
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = counts @ _CLASS / max(solid, 1)
    known = Counter(words)
    top = sum(c for _, c in known.most_common(3))
    pairs = n - len(set(zip(words, words[1:], strict=False))) - 1 if n > 1 else 0
    ends = sum(w[-1:] in b".,;:!?" for w in words) if n else 0
    longest = max(map(len, words), default=0)
    m = max(n, 1)
    extra = [
        math.log1p(n), min(n, 20) / 20, solid / m, math.log1p(longest), len(known) / m, (len(known) / math.sqrt(m)), top / m, pairs / m,
        math.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)), ends / m,
        sum(w.isupper() for w in words) / m, sum(len(w) == 1 for w in words) / m, sum(x > 1 for x in known.values()) / m,
    ]
    return np.concatenate([share, np.sqrt(share), extra])


NAMES = [*KINDS, *(f"sqrt_{k}" for k in KINDS), *(f"extra_{i}" for i in range(15))]


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steep: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip(self.steep * (self.strength(x) - self.threshold) + math.log(self.cut / (1 - self.cut)), -40, 40)
        return 1 / (1 + np.exp(-at))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, lenience: float = 0.5, cut: float = CUT, seed: int = 42) -> Ranking:
    """The ranking learnt from features and labels. With labels of one kind only every document scores 0.5."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return Ranking(mean, scale, np.zeros(len(mean)), math.log(cut / (1 - cut)), 1.0, cut)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        slope = diff.T @ (p - 1) / pairs + penalty * w
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    strength = z @ w
    share = len(poor) / len(y)
    at = float(np.quantile(strength, share))
    high = float(np.quantile(strength[poor], 0.99))
    threshold = at - lenience * max(0.0, at - high)
    spread = float(np.median(strength[good]) - np.median(strength[poor]))
    return Ranking(mean, scale, w, threshold, 6.0 / max(spread, 1e-6), cut)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled rows, those with the smallest hashes of their id; features
    are counted on the executors, so no text reaches the driver."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    known = docs.where("doc_id is not null").select("doc_id").distinct().join(marked, "doc_id")
    chosen = written(known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": pd.Series([features(t) for t in batch["text"]], dtype=object, index=batch.index)})

    # of rows with one id the one with the least features, picked before the driver sees any
    least = rows.mapInPandas(task, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row"))
    found = least.select("doc_id", "row.quality", "row.x").toArrow()
    ids, y = found["doc_id"].to_numpy(), found["quality"].to_numpy()
    x = found["x"].combine_chunks().values.to_numpy().reshape(len(ids), len(NAMES))
    order = np.argsort(ids)
    return x[order], y[order]


def scored(docs: DataFrame, ranking: Ranking, key: str = "doc_id") -> DataFrame:
    """(key, score) of each row. Null and empty texts have the score of a text without words; null keys and repeated
    rows each get a row; an empty table gives an empty result."""
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]], dtype=float).reshape(len(batch), len(NAMES))
            yield pd.DataFrame({"key": batch["key"].array, "score": ranking.score(x)})

    plain = docs.select(F.col(key).cast("string").alias("key"), F.col("text"))
    return plain.mapInPandas(task, "key string, score double").select(F.col("key").cast(kind).alias(key), "score")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ranking:
    ranking = fit(*training_rows(docs, labels, max_rows))
    release_memory()
    return ranking


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each documents row. Null and empty texts score as texts without words, null ids are not held out and teach
    nothing, ids whose labels differ teach nothing, repeated rows score alike; without labels of both kinds all score 0.5, and
    an empty table gives an empty result. lang, source and other columns are not read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = train(docs.where(crc_mod(F.col("doc_id"), 5) != 0), labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    held_out = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored(docs, ranking).select("doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score ``CUT`` or more, all columns kept; learnt from the labelled ones among them."""
    ranking = train(docs, labels)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
            yield pd.Series(ranking.score(x) >= CUT, dtype=bool)
        release_memory()

    return docs.where(good(F.col("text")))
