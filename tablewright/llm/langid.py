"""Language identification by a byte convolutional network.

The text's UTF-8 bytes, ASCII letters in lower case, are cut into windows of fixed length. Filters of several widths run
over a window; as the input is one-hot bytes, a filter is a table of one weight for each of its places and byte values.
Each filter's maximum over the window feeds a softmax over the languages. A text's prediction is the mean of its windows'
probabilities, each weighed by its bytes: whole texts count, and a passage in another language counts for its length only,
however sure the network is of it. Training is plain numpy (Adam on the cross-entropy) over a
bounded sample of windows; scoring runs in Arrow batches, windows of many texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import score_texts

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: The most documents, windows of one document, characters of a window, and languages that training reads.
MAX_DOCS, DOC_WINDOWS, WINDOW_CHARS, MAX_LANGS = 3000, 3, 200, 500
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1024


@dataclass
class ByteCNN:
    langs: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    out: np.ndarray  # (filters, languages)
    bias: np.ndarray

    def features(self, windows: np.ndarray, arg: bool = False):
        """Each filter's maximum over each window, and where it is if asked."""
        best, where = [], []
        for w, t in self.tables.items():
            span = windows.shape[1] - w + 1
            acc = t[0].take(windows[:, :span], axis=0)
            for j in range(1, w):
                acc += t[j].take(windows[:, j : j + span], axis=0)
            best.append(acc.max(axis=1))
            if arg:
                where.append(acc.argmax(axis=1))
        return np.concatenate(best, axis=1), where

    def log_proba(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.features(windows)[0], 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut(text: str) -> np.ndarray:
    """(windows, WINDOW) lower-case bytes of the whole text, the last window filled up with zeros; none for ''."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    n = -(-len(raw) // WINDOW)
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(raw)] = raw
    return flat.reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> ByteCNN:
    """Adam on the cross-entropy; classes weigh alike."""
    rng = np.random.default_rng(seed)
    net = ByteCNN(langs, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.tables.values(), net.out, net.bias]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = 1 / np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    weight = (weight / weight[labels].mean()).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]], labels[order[at : at + batch]]
            raw, where = net.features(x, arg=True)
            h = np.maximum(raw, 0)
            z = h @ net.out + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(y)
            back = (p @ net.out.T) * (raw > 0)
            grads = []
            for k, (w, t) in enumerate(net.tables.items()):
                g, part = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), part.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, where[k] + j, axis=1), f), part)
                grads.append(g)
            grads += [h.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, a, b in zip(params, grads, m, s, strict=True):
                g = g + decay * q
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, learn: Column, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> ByteCNN | None:
    """Learn from the rows of docs (doc_id, text, lang) where learn holds and text and lang are not null.

    For each language the documents of the smallest id hash, max_docs in all, and DOC_WINDOWS windows of each, chosen by
    hash: a bounded sample, taken by three passes whatever the number of languages. If there are more languages than
    max_langs the most frequent are learned, of equally frequent ones the first by name. Of rows that repeat an id and a
    language the least text counts. None if no row can be learned from.
    """
    rows = docs.where(learn & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    langs = sorted(r.lang for r in known)
    if not langs:
        return None
    # a threshold of the hash for each language leaves few more ids than are wanted, so that ranking them is cheap
    wanted = max(1, max_docs // len(langs))
    share = {r.lang: (wanted + 6 * wanted**0.5 + 10) * 1.4 / max(1, r.ids) for r in known}
    least = docs.sparkSession.createDataFrame([(la, min(2**63 - 1, int(-(2**63) + min(1.0, x) * 2**64))) for la, x in share.items()], "lang string, most long")
    h = F.xxhash64("doc_id")
    ids = rows.select("lang", "doc_id").join(F.broadcast(least), "lang").where(h <= F.col("most")).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).select("lang", "doc_id")
    every = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(DOC_WINDOWS - 1)),
        lambda j: F.substr("text", F.pmod(F.xxhash64(F.col("doc_id"), j), F.ceil(F.length("text") / WINDOW_CHARS)).cast("int") * WINDOW_CHARS + 1, F.lit(WINDOW_CHARS)),
    )
    sample = every.select("lang", F.explode(parts).alias("part")).toPandas().sort_values(["lang", "part"])
    pieces = [(cut(p)[:1], langs.index(la)) for la, p in zip(sample["lang"], sample["part"], strict=True) if any(c.isalpha() for c in p)]
    if not pieces:
        return None
    return train(np.concatenate([p[0] for p in pieces]), np.array([p[1] for p in pieces]), langs)


def identify(docs: DataFrame, net: ByteCNN | None, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text and more) with lang_pred and score (the predicted language's probability, 0 to 1).

    `und` with score 0 if text is null or has no letter, and everywhere if there was nothing to learn from. Columns of
    these names are replaced. Repeated rows are predicted alike; of equally likely languages the first by name is
    predicted; a very long text is read window by window; an empty table gives no rows.
    """

    def run(texts: list) -> dict:
        lang, prob = np.full(len(texts), "und", object), np.zeros(len(texts))
        rows, held = [], []

        def flush() -> None:
            # windows of many texts at a time; a long text's windows go in chunks
            stacked, sizes = np.concatenate(held), [len(h) for h in held]
            p = np.exp(np.concatenate([net.log_proba(stacked[a : a + _CHUNK]) for a in range(0, len(stacked), _CHUNK)]))
            weight = (stacked != 0).sum(axis=1, keepdims=True).astype(np.float64)
            starts = np.cumsum([0, *sizes[:-1]])
            p = np.add.reduceat(p * weight, starts, axis=0) / np.add.reduceat(weight, starts, axis=0)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            lang[rows] = np.array(net.langs, object)[best]
            prob[rows] = p[np.arange(len(best)), best]
            rows.clear()
            held.clear()

        for i, t in enumerate(texts):
            if net is not None and t and any(map(str.isalpha, t)):
                rows.append(i)
                held.append(cut(t))
                if sum(map(len, held)) >= _CHUNK:
                    flush()
        if rows:
            flush()
        return {"lang_pred": lang.tolist(), "score": prob}

    return score_texts(docs, run, "lang_pred string, score double", keep_text)
