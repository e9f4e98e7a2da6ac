"""Exact top-k search by no-random-access aggregation over sorted lists.

For a query q the score of x is the sum over dimensions d of q[d] * x[d]. Every dimension has one list of the vectors
sorted by their value there; it is read from the top where q[d] > 0, from the bottom where q[d] < 0, and not at all where
q[d] = 0. Reading goes on in rounds of growing depth. A round adds the entries that are new to the partial sums of their
vectors; what a vector lacks yet lies between the value at the read front and the list's last value, which gives it a
lower and an upper score bound. The k-th lower bound is the floor; a vector whose upper bound is below it cannot qualify,
and reading stops for a query when no more than k others are left or those left are known to the full, or at once if
even the lists' heads stay below the floor. The scores of those that remain are then resolved from their remaining entries.

A block of queries moves through a block of lists together, so a round is a few matrix products, over the rows that are
still live for some query. The floor is carried from block to block: within a task, and from a first chunk of vectors,
a hash sample that every query meets before the others, to the rest. On vectors without structure in many dimensions the
bounds close late (read_share tells how much is read), and the work stays that of queries times vectors.

Queries and vectors meet in cells of a grid (query block x vector chunk), each of bounded size. A query's k best of each
cell are merged by a window over at most k rows of each chunk.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

K, QUERY_BLOCK, VECTOR_BLOCK, LIST_BLOCK = 20, 2048, 8192, 2048
#: So many times k candidates are few; depths of the rounds, in parts of the lists.
RESOLVE = 4
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
#: The bounds of a long that a double holds.
_MOST = 9223372036854774784


def nra_block(q: np.ndarray, v: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Which (query, vector) pairs can still be among the k best when reading stops, and to what depth each query read.

    q (Q, D) and v (N, D) hold integers as floats; own marks pairs to leave out; floor (Q) is a k-th score known from
    earlier blocks; slack is how far sums of these floats may be off.
    """
    n, few = len(v), max(RESOLVE * k, len(v) // 32)
    lists = np.sort(v, axis=0)
    low, high = lists[0], lists[-1]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    live, depth_of = np.zeros_like(own), np.zeros(len(q), np.int64)
    # no vector's score is above what the lists' heads would give together
    act = np.flatnonzero(up @ high + down @ low + slack >= floor)
    alive, bar, seen = ~own[act], floor[act].astype(np.float64), np.zeros((len(act), n), v.dtype)
    bare = np.isneginf(bar)
    last_top, last_bottom = np.full(v.shape[1], np.inf, v.dtype), np.full(v.shape[1], -np.inf, v.dtype)
    for depth in sorted({max(1, int(n * part)) for part in DEPTHS}):
        if not len(act):
            break
        top, bottom = lists[n - depth], lists[depth - 1]
        depth_of[act] = depth
        # while a vector that no list has shown yet could qualify, reading goes on; without a floor, one is looked for
        due = np.flatnonzero((up[act] @ top + down[act] @ bottom + slack < bar) | bare | (depth == n))
        if not len(due):
            continue
        from_top, from_bottom = v >= top, v <= bottom
        seen += up[act] @ np.where(from_top & (v < last_top), v, 0).T + down[act] @ np.where(from_bottom & (v > last_bottom), v, 0).T
        last_top, last_bottom = top, bottom
        u, d = up[act[due]], down[act[due]]
        upper = seen[due] + u @ np.where(from_top, 0, top).T + d @ np.where(from_bottom, 0, bottom).T
        look = np.flatnonzero(bare[due] | (depth == n))
        if n > k and len(look):
            lower = upper[look] if depth == n else seen[due[look]] + u[look] @ np.where(from_top, 0, low).T + d[look] @ np.where(from_bottom, 0, high).T
            lower = np.where(own[act[due[look]]], -np.inf, lower)
            bar[due[look]] = np.maximum(bar[due[look]], np.minimum(np.partition(lower, n - k, axis=1)[:, n - k] - slack, _MOST))
        alive[due] &= upper + slack >= bar[due][:, None]
        done = np.zeros(len(act), bool)
        done[due] = (alive[due].sum(axis=1) <= few) | (depth == n)
        live[act[done]] = alive[done]
        act, alive, bar, seen, bare = act[~done], alive[~done], bar[~done], seen[~done], bare[~done]
    return live, depth_of


def top_in_cell(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query its best (vec_id, score) among the vectors, exact, as far as they reach its floor, and how many list
    entries it read for each of its dimensions. Scores beyond the range of long count as its ends."""
    reach = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float32 if reach < 2**24 else np.float64
    slack = 0.0 if reach < 2**53 else reach * q.shape[1] * 2.0**-50
    q_f = q.astype(kind)
    best_id = [np.empty(0, np.int64)] * len(qid)
    best_score = [np.empty(0, np.int64)] * len(qid)
    floor = np.full(len(qid), -np.inf) if floor is None else np.nan_to_num(floor.astype(np.float64), nan=-np.inf)
    read = np.zeros(len(qid), np.int64)
    for start in range(0, len(vid), LIST_BLOCK):
        ids, block = vid[start : start + LIST_BLOCK], v[start : start + LIST_BLOCK]
        block_f = block.astype(kind)
        live, depth = nra_block(q_f, block_f, qid[:, None] == ids[None, :], floor, k, slack)
        # what was read of the lists, and what is read to resolve the candidates
        read += depth + (live.sum(axis=1) * (1 - depth / len(ids))).astype(np.int64)
        for i in np.flatnonzero(live.any(axis=1)):
            at = np.flatnonzero(live[i])
            whole = block_f[at] @ q_f[i] if reach < 2**53 else np.clip((block[at].astype(object) * q[i].astype(object)).sum(axis=1), -_MOST, _MOST)
            made = whole.astype(np.int64)
            score, cand = np.concatenate([best_score[i], made]), np.concatenate([best_id[i], ids[at]])
            order = np.lexsort((cand, -score))[:k]
            best_id[i], best_score[i] = cand[order], score[order]
            if len(order) == k:
                floor[i] = max(floor[i], float(score[order[-1]]) - slack)
    return list(zip(best_id, best_score, strict=True)), read


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * component) of every component, those beyond the range of long as its ends; vectors that
    are null, empty or hold a null or non-finite component take no part, nor do rows without a vec_id."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    number = lambda c: F.floor(F.greatest(F.lit(-float(_MOST)), F.least(F.lit(float(_MOST)), c.cast("double") * scale))).cast("long")
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, number).alias("v"))


def exact_top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, with_read_share: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id; if asked,
    also read_share, the part of the list entries that were read for the query.

    vectors has vec_id and embedding (array of numbers); is_query is a condition on vec_id. Only vectors of the query's
    own length are compared with it; rows of its own vec_id are no candidates. Rows that repeat a vec_id are candidates
    each, and as queries they share the k places of their id. Scores beyond the range of long count as its ends. No
    vectors or no queries: no rows. Other columns are not read, so their names cannot clash.
    """
    v = materialise(spark, quantised(vectors), "topk-vectors").withColumn("rid", F.monotonically_increasing_id())
    n, m = v.agg(F.count("*"), F.count_if(is_query)).first()
    across, down = max(1, math.ceil(n / vector_block)), max(1, math.ceil(m / query_block))
    chunk, block = F.pmod(F.xxhash64("rid"), F.lit(across)).cast("int"), F.pmod(F.xxhash64(F.lit(5), "rid"), F.lit(down)).cast("int")
    dim = F.size("v").alias("dim")
    lists = v.select(dim, F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("qb"), chunk.alias("vb"), "vec_id", "v")
    asks = v.where(is_query).select(dim, block.alias("qb"), "rid", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    schema = "rid long, query_id long, vec_id long, score long, n_read long, n_all long"

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in schema.split(", ")})
        rid, qid, vid, q = left["rid"].to_numpy(), left["query_id"].to_numpy(), right["vec_id"].to_numpy(), np.stack(left["q"].to_list())
        best, read = top_in_cell(qid, q, vid, np.stack(right["v"].to_list()), k, left["floor"].to_numpy(dtype=np.float64))
        lists = (q != 0).sum(axis=1)
        many = [len(b[0]) for b in best]
        # one row more for each query, which tells what was read
        none = [pd.NA] * len(rid)
        told = {"rid": rid, "query_id": qid, "vec_id": none, "score": none, "n_read": read * lists, "n_all": len(vid) * lists}
        found = {"rid": np.repeat(rid, many), "query_id": np.repeat(qid, many), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best])}
        found |= {"n_read": [pd.NA] * sum(many), "n_all": [pd.NA] * sum(many)}
        return pd.concat([pd.DataFrame({c: pd.array(x, "Int64") for c, x in part.items()}) for part in (found, told)])

    key = ["dim", "qb", "vb"]

    def meet(questions: DataFrame, part: DataFrame) -> DataFrame:
        return questions.groupBy(*key).cogroup(part.groupBy(*key)).applyInPandas(cell, schema)

    first = asks.withColumns({"vb": F.lit(0), "floor": F.lit(None).cast("double")})
    found = meet(first, lists.where("vb = 0"))
    if across > 1:
        found = materialise(spark, found, "topk-first")
        floors = found.where(F.col("vec_id").isNotNull()).groupBy("rid").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
        later = asks.join(floors, "rid", "left").withColumn("vb", F.explode(F.sequence(F.lit(1), F.lit(across - 1))))
        found = found.unionByName(meet(later, lists.where("vb > 0")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.where(F.col("vec_id").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if not with_read_share:
        return best
    share = found.groupBy("query_id").agg((F.sum("n_read") / F.sum("n_all")).alias("read_share"))
    return best.join(share, "query_id", "left")
