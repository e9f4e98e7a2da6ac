"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; the unlabelled rows are drawn from all rows that may be learned from, toxic ones
among them at their natural rate. A linear model over the presence of words minimises the class-prior-corrected risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
and where the corrected negative risk falls below 0 the step ascends it, so that it can't overfit to negative values.
Features are words and their beginnings, so that a stem counts under any ending. They enter the model if enough positive
rows hold them, near copies counting once; weights start at 0 and shrink, so features as frequent in either set stay near
0. Training is numpy on bounded samples; scoring runs in Arrow batches on the set of a text's features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialise, score_texts

#: The most rows of either kind that training reads, and the most words of the model.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 3000, 6000, 2000
MIN_ROWS, LIFT, THRESHOLD = 6, 5, 0.7
#: Lengths of the beginnings of longer words; they carry marks that no word has.
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> set[str]:
    """The distinct words of a text, their beginnings, and the beginnings that two or more of them share."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        seen = Counter([w[:n] for w in words if len(w) > n])
        out.update([s + "-" for s in seen])
        out.update([s + "+" for s, k in seen.items() if k > 1])
    return out


def copy_keys(text: str, keys: int = 3) -> list[str]:
    """Near copies mostly agree in one of these at least: the three word triples of the smallest hash, for several seeds."""
    words = text.lower().split()
    triples = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
    return [" ".join(map(str, sorted(zlib.crc32(t, seed) for t in triples)[:3])) for seed in range(1, keys + 1)]


@dataclass
class WordModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[w] for w in self.weights.keys() & tokens(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def vocabulary(positive: list[set[str]], unlabelled: list[set[str]]) -> list[str]:
    """Words of MIN_ROWS positive rows at least whose rate there clearly exceeds, or falls below, the unlabelled rate."""
    p, u = Counter(w for t in positive for w in t), Counter(w for t in unlabelled for w in t)
    n, m = max(len(positive), 1), max(len(unlabelled), 1)
    scored = sorted((-abs(_lift(p[w], n, u[w], m)), w) for w in p if p[w] >= MIN_ROWS)
    return [w for z, w in scored[:MAX_WORDS] if -z > LIFT]


def _lift(p, n, u, m):
    """How many standard errors p of n is above u of m; for numbers and columns alike."""
    return (p / n - u / m) / ((u / m + 1 / m) * (1 / n + 1 / m)) ** 0.5


def minimise(words: list[str], positive: Counter, unlabelled: Counter, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-5) -> WordModel:
    """Non-negative PU risk with the logistic loss, full-batch Adam; a bias that says `prior` if there are no words.

    Rows are counters of tuples of word numbers: most rows hold few of the words, and equal rows are one.
    """
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled or not words:
        return WordModel({}, start)

    def matrix(rows: Counter) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(words)), np.float32)
        for i, t in enumerate(rows):
            x[i, list(t)] = 1
        n = np.array(list(rows.values()), np.float32)
        return x, n / n.sum()

    (xp, wp), (xu, wu) = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(words), np.float32), start
    m, s = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w + np.float32(b), xu @ w + np.float32(b)
        negative = wu @ np.logaddexp(0, zu) - prior * (wp @ np.logaddexp(0, zp))
        gp, gpn, gu = -prior * wp * (1 - sig(zp)), -prior * wp * sig(zp), wu * sig(zu)
        g_p, g_u = (gp + gpn, gu) if negative >= 0 else (-gpn, -gu)
        g = np.append(g_p.astype(np.float32) @ xp + g_u.astype(np.float32) @ xu + decay * w, g_p.sum() + g_u.sum())
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1].astype(np.float32), b - d[-1]
    return WordModel(dict(zip(words, map(float, w), strict=True)), float(b))


def train(positive: list[set[str]], unlabelled: list[set[str]], prior: float) -> WordModel:
    """From sets of features in memory."""
    words = vocabulary(positive, unlabelled)
    at = {w: i for i, w in enumerate(words)}
    rows = lambda sets: Counter(tuple(sorted(at[w] for w in at.keys() & t)) for t in sets)
    return minimise(words, rows(positive), rows(unlabelled), prior)


def _sample(base: DataFrame, ids: DataFrame, kind: int) -> DataFrame:
    """kind, doc_id, keys, text of the rows of these ids; of rows that repeat an id one."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"kind": kind, "doc_id": pdf["doc_id"].astype(str), "keys": [copy_keys(t) for t in pdf["text"]], "text": pdf["text"]})

    rows = base.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.mapInPandas(keyed, "kind int, doc_id string, keys array<string>, text string")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, prior: float | None = None) -> WordModel:
    """Learn from docs (doc_id, text) where learn (a condition on doc_id) holds, with labels (doc_id, toxic).

    Positives: rows labelled 1. Unlabelled: all rows of non-null text, without regard to labels. prior, the share of toxic
    rows among all, is by default the share of 1 among the labelled rows that may be learned from, which is right only if
    those are a random sample; where toxic rows were labelled by preference, pass the share. Both samples are bounded (MAX_POSITIVE, MAX_UNLABELLED),
    by id hash; of rows that repeat an id one counts, and of near copies. The words are counted by Spark; the driver gets
    those of the model and, for each row of the samples, which of them it holds. No positive row: every score is a small
    constant.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, ones = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(0.9, max(0.01, prior if prior is not None else ones / n if n else 0.01))
    key = F.col("doc_id")
    base = docs.where(F.col("text").isNotNull() & key.isNotNull() & learn).select("doc_id", "text")
    positive = bounded_sample(known.where(F.col("toxic") == 1).select("doc_id"), key, MAX_POSITIVE)
    others = bounded_sample(base.select("doc_id").distinct(), key, MAX_UNLABELLED)
    both = _sample(base, positive, 1).union(_sample(base, others, 0))
    for i in range(3):  # one of those that share a key
        both = both.groupBy("kind", F.get("keys", F.lit(i)).alias("key")).agg(F.min(F.struct("doc_id", "keys", "text")).alias("x")).select("kind", "x.*")
    rows = materialise(docs.sparkSession, both.select("kind", "text"), "pu-sample")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                of = [Counter(), Counter()]
                for kind, text in zip(part["kind"], part["text"], strict=True):
                    of[kind].update(tokens(text))
                w = list(of[0].keys() | of[1].keys())
                yield pd.DataFrame({"w": w, "p": [of[1][x] for x in w], "u": [of[0][x] for x in w]})

    sizes = dict(rows.groupBy("kind").count().collect())
    n, m = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    words = rows.mapInPandas(counts, "w string, p long, u long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= MIN_ROWS)
    words = words.withColumn("z", F.abs(_lift(F.col("p"), n, F.col("u"), m))).where(F.col("z") > LIFT).orderBy(F.desc("z"), "w").limit(MAX_WORDS)
    chosen = [r["w"] for r in words.collect()]
    at = {w: i for i, w in enumerate(chosen)}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"kind": pdf["kind"], "held": [sorted(at[w] for w in at.keys() & tokens(t)) for t in pdf["text"]]})

    got: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for kind, which in rows.mapInPandas(held, "kind int, held array<int>").collect():
        got[kind][tuple(which)] += 1
    ordered = {k: Counter(dict(sorted(c.items()))) for k, c in got.items()}
    return minimise(chosen, ordered[1], ordered[0], prior)


def score(docs: DataFrame, model: WordModel, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text and more) with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the score of a text without words. Repeated rows are scored alike. A very long text is scored
    whole, by the set of its words. An empty table gives no rows. Columns of these names are replaced.
    """

    def run(texts: list) -> dict:
        p = np.array([model.score(t or "") for t in texts])
        return {"score": p, "predicted": (p >= threshold).astype("int32")}

    return score_texts(docs, run, "score double, predicted int", keep_text)
