"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 .. K-1 are ordered. One weight vector over hashed text features is shared by all grades and K-1 ordered
thresholds t_1 < t_2 < ... cut its score: P(grade >= k) = sigmoid(w.x - t_k). The expected grade is the sum of these tail
probabilities; a document is selected if P(grade >= select_grade) >= select_at.

Features of a text: the square roots of the shares of its hashed byte trigrams and of its trigrams over byte classes
(case, digit, blank, each sign), and the share of distinct words in bins. Whole texts count. Training is numpy on a
bounded sample of rated rows; scoring runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, own_prefix, score_texts

HASHED, SHAPED, BINS = 2048, 4096, 16
WIDTH = HASHED + SHAPED + 2 * BINS
#: The most rated rows that training reads.
MAX_RATED = 4000
SELECT_GRADE, SELECT_AT = 1, 0.5


def _classes() -> np.ndarray:
    """16 classes of bytes: lower and upper case, digits, line ends, blanks, the bytes of other scripts, and signs by a
    remainder."""
    c = np.arange(256)
    out = 6 + c % 10
    out[(c >= 97) & (c <= 122)] = 0
    out[(c >= 65) & (c <= 90)] = 1
    out[(c >= 48) & (c <= 57)] = 2
    out[c == 10], out[c == 32], out[c >= 128] = 3, 4, 5
    return out.astype(np.int64)


_CLASS = _classes()


def features(text: str | None) -> np.ndarray:
    """WIDTH non-negative numbers; all 0 but the length bin for null and empty texts."""
    x = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    if len(raw) >= 3:
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        h = ((a * 65536 + b * 256 + c) * 2654435761 >> 15) % HASHED
        x[:HASHED] = np.sqrt(np.bincount(h, minlength=HASHED) / len(h))
        k = _CLASS[raw]
        x[HASHED : HASHED + SHAPED] = np.sqrt(np.bincount(k[:-2] * 256 + k[1:-1] * 16 + k[2:], minlength=SHAPED) / len(h))
    words = (text or "").split()
    if words:
        x[HASHED + SHAPED + min(BINS - 1, int(len(set(words)) / len(words) * BINS))] = 1
    x[HASHED + SHAPED + BINS + min(BINS - 1, len(raw).bit_length())] = 1
    return x


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade above 0

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds, -30, 30)))


def train(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 250, rate: float = 0.05, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with a small ridge by full-batch Adam. Thresholds are a first one and logs of the gaps, so
    that they stay ordered."""
    n, width = x.shape
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used].astype(np.float32)
    above = [(grade >= k).mean() if n else 0.5 for k in range(1, grades)]
    cut = [-np.log(np.clip(p, 0.01, 0.99) / (1 - np.clip(p, 0.01, 0.99))) for p in above]
    raw = np.array([cut[0], *np.log(np.maximum(np.diff(cut), 0.05))])
    w = np.zeros(len(used), np.float32)
    m, s = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    order = lambda r: r[0] + np.append(0, np.cumsum(np.exp(r[1:])))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rows = np.arange(n)
    for step in range(1, steps + 1 if n else 1):
        z = (x @ w)[:, None] - order(raw)
        tail = np.concatenate([np.ones((n, 1)), sig(z), np.zeros((n, 1))], axis=1)
        p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
        slope = tail * (1 - tail)
        g_tail = np.zeros_like(tail)
        g_tail[rows, grade] -= 1 / p / n
        g_tail[rows, grade + 1] += 1 / p / n
        g_z = (g_tail * slope)[:, 1:-1]
        g_cut = -g_z.sum(axis=0)
        g_raw = np.array([g_cut.sum(), *(np.exp(raw[1:]) * np.cumsum(g_cut[::-1])[::-1][1:])])
        g = np.append(g_z.sum(axis=1).astype(np.float32) @ x + decay * w, g_raw)
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, raw = w - d[: len(w)].astype(np.float32), raw - d[len(w) :]
    weights = np.zeros(width, np.float32)
    weights[used] = w
    return OrdinalModel(weights, order(raw))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels (doc_id, quality, toxic): 0 low quality, 1 good but toxic, 2 good. The table has no grades
    of its own; this order is a choice that its two marks allow, and fit() takes any other. Rows without a quality or an id
    are left out; of rows that repeat an id the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, max_rated: int = MAX_RATED) -> OrdinalModel:
    """Learn from docs (doc_id, text) and ratings (doc_id, grade 0 .. grades-1), max_rated rows of them by id hash."""
    sample = F.broadcast(bounded_sample(ratings, F.col("doc_id"), max_rated))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [features(t).astype(np.float16).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "grade": pdf["grade"].astype("int32"), "x": x})

    # Arrow's buffers, filled into one array: no object for each row on the driver
    got = rows.mapInPandas(featurise, "doc_id string, grade int, x binary").toArrow()
    place = np.empty(got.num_rows, np.int64)
    place[np.argsort(np.array(got.column("doc_id").to_pylist(), object), kind="stable")] = np.arange(got.num_rows)
    x, grade, at = np.zeros((got.num_rows, WIDTH), np.float16), np.zeros(got.num_rows, np.int64), 0
    for batch in got.to_batches():
        to = place[at : at + batch.num_rows]
        at += batch.num_rows
        grade[to] = batch.column("grade").to_numpy()
        for i, b in zip(to, batch.column("x"), strict=True):
            x[i] = np.frombuffer(b.as_buffer(), np.float16)
    del got
    return train(x, grade, grades)


def keep_selected(docs: DataFrame, model: OrdinalModel, select_grade: int = SELECT_GRADE, select_at: float = SELECT_AT) -> DataFrame:
    """The selected rows of docs, columns as they are. Null and empty texts are rated by their length alone; repeated rows
    go or stay alike; very long texts are rated whole; an empty table stays empty."""

    selected = own_prefix(docs) + "selected"

    def run(texts: list) -> dict:
        got = [model.tails(np.stack([features(t) for t in texts[a : a + 256]]))[:, select_grade - 1] for a in range(0, len(texts), 256)]
        return {selected: np.concatenate(got) >= select_at if got else np.zeros(0, bool)}

    return score_texts(docs, run, f"{selected} boolean").where(selected).drop(selected)


def rate(docs: DataFrame, model: OrdinalModel, select_grade: int = SELECT_GRADE, select_at: float = SELECT_AT, keep_text: bool = True) -> DataFrame:
    """docs (text and more) with expected_grade, tail (P(grade >= select_grade)) and selected.

    Null and empty texts are rated by their length alone; repeated rows alike. A very long text is rated whole, in memory
    proportional to it. An empty table gives no rows. Columns of these names are replaced.
    """

    def run(texts: list) -> dict:
        tails = np.zeros((len(texts), len(model.thresholds)))
        for a in range(0, len(texts), 256):
            tails[a : a + 256] = model.tails(np.stack([features(t) for t in texts[a : a + 256]]))
        tail = tails[:, select_grade - 1]
        return {"expected_grade": tails.sum(axis=1), "tail": tail, "selected": tail >= select_at}

    return score_texts(docs, run, "expected_grade double, tail double, selected boolean", keep_text)
