"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of one to three characters of the lower-cased whole text, hashed to ``BUCKETS`` columns, log counts
times inverse document frequency, scaled to length one. Training: follow the regularised leader (FTRL-proximal) with
per-coordinate rates; its L1 part keeps most weights at exactly zero, its L2 part holds the others down. Calibration: one
temperature, chosen on rows that training did not see, by their log loss.

Training uses at most ``max_rows`` rows with a language. They are those with the smallest product of a hash of the id and
the number of rows of their language, which takes about as many of each language, and all of a rare one. Executors count
their n-grams; the driver holds max_rows sparse rows. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import crc_mod, release_memory, table, written

BUCKETS, MAX_ROWS, UNKNOWN = 1 << 15, 4_000, "und"
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text or ""))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns and counts of a text's n-grams of one to three characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) + one[2:]
    mixed = np.concatenate([one, two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 rows, the last for the bias
    temperature: float

    def row(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.row(at, counts) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; und and 0 for null and texts without a letter, and
        where no language was learnt."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*gram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 42) -> np.ndarray:
    """Weights (BUCKETS + 1, classes) after ``epochs`` passes over the rows (columns, values) in random orders."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def leader(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            zi, ni = z[at], n[at]
            w = leader(zi, ni)
            p = softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return leader(z, n)


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 0.05 and 20 with the least log loss; 1 without rows."""
    if not len(y):
        return 1.0
    loss = lambda t: -float(np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()) + 1e-4 * abs(np.log(t))
    return float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))


def fit(langs: list[str], counted: list[tuple[np.ndarray, np.ndarray]], aside: np.ndarray) -> Model:
    """Learns from all rows but those set ``aside``, which calibrate."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    y = np.array([names.index(x) for x in langs])
    frequency = np.zeros(BUCKETS)
    for at, _ in counted:
        frequency[at] += 1
    model = Model(names, np.log((1 + len(counted)) / (1 + frequency)) + 1, np.zeros((BUCKETS + 1, len(names))), 1.0)
    own = np.flatnonzero(~aside)
    model.weights = ftrl([(counted[i][0], model.row(*counted[i])) for i in own], y[own], len(names))
    rest = np.flatnonzero(aside)
    if len(rest):
        model.temperature = calibrated(np.array([model.logits(*counted[i]) for i in rest]), y[rest])
    return model


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from (doc_id, text, lang). Rows without a language, an id or a letter teach nothing."""
    known = docs.where("lang is not null and doc_id is not null and text is not null")
    sizes = written(known.groupBy("lang").count())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("count")
    chosen = written(known.select("doc_id", "lang").distinct().join(sizes, "lang").orderBy(share, "doc_id", "lang").limit(max_rows).select("doc_id", "lang"))
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most max_rows ids

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            counted = [gram_counts(t) for t in batch["text"]]
            lists = ([x[k].astype(np.int32) for x in counted] for k in (0, 1))
            at, n = (pd.Series(x, dtype=object, index=batch.index) for x in lists)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "at": at, "n": n})

    # of rows with one id and language one, picked before the driver sees any; Arrow gives views, no Python lists
    counts = rows.mapInPandas(task, "doc_id long, lang string, at array<int>, n array<int>")
    total = F.aggregate("n", F.lit(0).cast("long"), lambda acc, k: acc + k)
    least = counts.groupBy("doc_id", "lang").agg(F.min(F.struct(F.size("at").alias("size"), total.alias("total"), "at", "n")).alias("row"))
    found = least.select("doc_id", "lang", "row.at", "row.n").toArrow()
    ids, langs = found["doc_id"].to_numpy(), found["lang"].to_pylist()
    at, n = (_split(found[c].combine_chunks()) for c in ("at", "n"))
    first = sorted(range(len(ids)), key=lambda i: (ids[i], langs[i]))
    aside = (ids[first] * 2654435761 >> 7) % 5 == 0
    model = fit([langs[i] for i in first], [(at[i], n[i]) for i in first], aside)
    release_memory()
    return model


def _split(lists: pa.ListArray) -> list[np.ndarray]:
    """The arrays of a list column."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def predicted(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of each row. Null keys and repeated rows each get a row; an empty table gives an empty
    result; columns other than key and text are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"].array, "lang_pred": [x for x, _ in found], "score": [p for _, p in found]})

    plain = docs.select(F.col(key).cast("string").alias("key"), F.col("text"))
    return plain.mapInPandas(task, "key string, lang_pred string, score double").select(F.col("key").cast(kind).alias(key), "lang_pred", "score")


def op6_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each documents row. Texts that are null or have no letter are ``und``; null ids and langs teach nothing,
    repeated rows are predicted alike; without anything learnt all are ``und``, and an empty table gives an empty result. Other
    columns are not read."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return predicted(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def identified_documents(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` in a learnt language with a score of ``least`` or more, all columns kept."""
    model = train(docs)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = (model.predict(t) for t in texts)
            yield pd.Series([x != UNKNOWN and p >= least for x, p in found], dtype=bool)
        release_memory()

    return docs.where(known(F.col("text")))
