"""N-gram Jaccard join by chosen paths.

A text is the set of its word 5-grams; texts of equal sets form one set class, so copies cost one row. Each set is
embedded as SLOTS minimum hashes, each by a hash function of its own, whatever the set's size: two sets share each with
probability J, their Jaccard similarity, and independently of the others, also where they have few shingles.

A run splits all sets on the token of a slot of its own. A bucket of more than SMALL sets is split again, on CHILDREN
slots that its path chooses and has not used, unless splitting leaves more than half of it together: what is mostly alike
is searched as it is. Runs are repeated until `target_recall` is reached: runs_for() gives their number from the recall
and the depth of splitting that the runs really came to.

Leaves are searched by brute force, a leaf of many or of large sets as a grid of blocks, so none is capped. Two sets meet
in the first leaf, in the order of runs, that both are in, and are compared there alone, so that nothing has to be made
distinct over runs. A first look at the embeddings (floor_for(): as many equal slots as a pair at the threshold has, but
for half of the allowed misses) tells which sets of a leaf have a partner; for these the texts are fetched and all their
pairs in the leaf compared exactly, as matrix products. A leaf returns a row for each set, never for each pair: how many
documents it is linked to, and a set that it hangs together with by links. The classes are the components of these, found
by minimum labels and pointer jumping over written tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, own_prefix, score_texts, sorted_groups, text_key

WIDTH, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.99999
SLOTS, SMALL, CHILDREN, DEPTH = 64, 768, 2, 8
#: A block of a leaf: so many sets, and so many shingles, at most on average; a cell is two blocks.
BLOCK, WEIGHT, COLUMNS = 384, 2_000_000, 8192
_WORD = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: The slots' hash functions: odd multipliers of 32-bit tokens, which are hashes already.
_SLOT = np.random.default_rng(12).integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)


class _Words(dict):
    """Word to 64-bit hash; starts anew when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[4]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width words (lower-case letters and digits). A text of fewer words
    has one shingle of all its words; one without words has none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(w) < width:
        w = np.concatenate([w, np.full(width - len(w), 1, np.uint64)])
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = _mix(h + w[j : j + n] * _ODD[j % 5])
    return np.unique(h)


def embedding(s: np.ndarray) -> np.ndarray:
    """SLOTS sampled tokens of a non-empty set: its least hash under each slot's function."""
    token = s.astype(np.uint32)
    least = [(token[at : at + 256, None] * _SLOT).min(axis=0) for at in range(0, len(token), 256)]
    return np.minimum.reduce(least).view(np.int32)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tk1, tk2, rid (16 bytes: the set), n, sig for every row."""

    def run(texts: list) -> dict:
        rid, n, sig = [], [], []
        for t in texts:
            s = shingle_set(t, width)
            n.append(len(s))
            if not len(s):
                rid.append(None)
                sig.append(None)
                continue
            rid.append(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s + _ODD[0]))], np.uint64).tobytes())
            sig.append(embedding(s))
        return {"rid": rid, "n": pa.array(n, pa.int32()), "sig": pa.array(sig, pa.list_(pa.int32()))}

    keyed = docs.select("doc_id", *text_key(F.col("text")), "text")
    return score_texts(keyed, run, "rid binary, n int, sig array<int>", keep_text=False)


def runs_for(target_recall: float, threshold: float = THRESHOLD, depth: int = 0) -> int:
    """Runs after which a pair at the threshold is missed with (1 - target_recall) / 2 at most, where buckets were split
    depth times. Of a pair's copies one at least has to stay together, a branching process."""
    stays = 1.0
    for _ in range(depth):
        stays = 1 - (1 - threshold * stays) ** CHILDREN
    return min(SLOTS, max(1, math.ceil(math.log((1 - target_recall) / 2) / math.log(1 - threshold * stays))))


def floor_for(target_recall: float, threshold: float = THRESHOLD) -> int:
    """The most equal slots that a pair at the threshold has but for a probability of (1 - target_recall) / 2."""
    below, k = 0.0, 0
    while (below := below + math.comb(SLOTS, k) * threshold**k * (1 - threshold) ** (SLOTS - k)) <= (1 - target_recall) / 2:
        k += 1
    return k


def _path(run: Column, *chosen: Column) -> Column:
    """A leaf's key: the run in the highest bits, so that keys go by run, and a hash of the path."""
    return F.shiftleft(run.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*chosen), 8))


def _leaves(spark: SparkSession, reps: DataFrame, runs: range) -> tuple[DataFrame, int]:
    """(rid, key, m, w) of all leaves of two sets at least, m their sets and w their shingles, and how often splitting
    went on."""
    slots = np.random.default_rng(11).permutation(SLOTS)
    first = F.array(*[F.struct(_path(F.lit(r), F.lit(r), F.get("sig", F.lit(int(slots[r])))).alias("key"), F.array(F.lit(int(slots[r]))).alias("used")) for r in runs])
    level = reps.select("rid", "n", F.explode(first).alias("x")).select("rid", "n", "x.*")
    size = (F.count("*").alias("m"), F.sum("n").alias("w"))
    counts, out = level.groupBy("key").agg(*size).where("m > 1"), None
    for depth in range(DEPTH + 1):
        sized = materialise(spark, level.join(materialise(spark, counts, f"path-counts-{depth}"), "key"), f"path-level-{depth}")
        big = sized.where(F.col("m") > SMALL)
        ends = (sized.where(F.col("m") <= SMALL), big)
        if big.isEmpty() or depth == DEPTH:
            split = None
        else:
            free = F.array_except(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.col("used"))
            place = F.pmod(F.xxhash64("key"), F.size("free"))
            slot = F.transform(F.sequence(F.lit(0), F.lit(CHILDREN - 1)), lambda c: F.get("free", F.pmod(place + c * 7, F.size("free")).cast("int")))
            run = F.shiftright("key", 56)
            child = F.transform("slot", lambda p: F.struct(_path(run, F.col("key"), p, F.get("sig", p)).alias("key"), F.concat("used", F.array(p)).alias("used")))
            kids = big.join(reps.select("rid", "sig"), "rid").withColumn("free", free).withColumn("slot", slot)
            kids = kids.select("rid", "n", F.col("key").alias("parent"), F.col("m").alias("of"), F.explode(child).alias("x")).select("rid", "n", "parent", "of", "x.*")
            kids = materialise(spark, kids, f"path-kids-{depth}")
            made = materialise(spark, kids.groupBy("parent", "of", "key").agg(*size), f"path-made-{depth}")
            split = made.groupBy("parent", "of").agg(F.max("m").alias("most")).where(F.col("most") * 2 <= F.col("of")).select("parent")
            ends = (ends[0], big.join(split.withColumnRenamed("parent", "key"), "key", "left_anti"))
        for end in ends:
            end = end.select("rid", "key", "m", "w")
            out = end if out is None else out.unionByName(end)
        if split is None or split.isEmpty():
            return out, depth
        level = kids.join(split, "parent", "left_semi").select("rid", "n", "key", "used")
        counts = made.join(split, "parent", "left_semi").where("m > 1").select("key", "m", "w")
    raise AssertionError


def _grid(rows: DataFrame) -> DataFrame:
    """rows (rid, key, m, w) with cell and half: a leaf that is more than a block becomes a grid of block pairs. half: 0
    where a block meets itself, else 1 or 2 by the row's side."""
    g = F.greatest(F.lit(1), F.when(F.col("m") > SMALL, F.ceil(F.col("m") / BLOCK)).otherwise(1), F.least(F.col("m"), F.ceil(F.col("w") / WEIGHT))).cast("long")
    own = F.pmod(F.xxhash64("rid"), g)
    spread = rows.withColumn("__b", own).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), g - 1)))
    half = F.when(F.col("__b") == F.col("__j"), 0).when(F.col("__b") < F.col("__j"), 1).otherwise(2)
    return spread.withColumns({"cell": F.xxhash64("key", F.least("__b", "__j"), F.greatest("__b", "__j")), "half": half}).drop("__b", "__j", "m", "w")


def _agreement(sig: np.ndarray) -> np.ndarray:
    """In how many slots each two rows agree."""
    if len(sig) <= 64:
        return (sig[:, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.uint8)
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for column in np.ascontiguousarray(sig.T):
        out += column[:, None] == column[None, :]
    return out


def _due(cell: pa.Table, near: np.ndarray) -> np.ndarray:
    """near without a row and itself, rows of the same side of a grid's cell, and rows that meet in an earlier leaf."""
    due, half = near.copy(), cell.column("half").to_numpy()
    np.fill_diagonal(due, False)
    if half.any():
        due &= half[:, None] != half[None, :]
    if not due.any():
        return due
    keys = cell.column("keys").combine_chunks()
    flat, ends = keys.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(keys).to_numpy())
    row = np.searchsorted(ends, np.arange(len(flat)), side="right")
    early = flat < cell.column("key")[0].as_py()
    flat, row = flat[early], row[early]
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.append(0, np.flatnonzero(flat[1:] != flat[:-1]) + 1)
    for a, b in zip(starts, np.append(starts[1:], len(flat)), strict=True):
        if b - a > 1:
            due[np.ix_(row[a:b], row[a:b])] = False
    return due


def _partners(rows: DataFrame, floor: int) -> DataFrame:
    """The rows (cell, key, half, rid, keys, sig, sorted by cell) that have a partner in their cell by the embeddings,
    without sig."""
    kept = ["cell", "key", "half", "rid", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, "cell"):
            m = cell.num_rows
            if m < 2:
                continue
            near = _agreement(cell.column("sig").combine_chunks().flatten().to_numpy().reshape(m, SLOTS)) >= floor
            some = _due(cell, near).any(axis=1)
            if some.any():
                yield from cell.filter(pa.array(some)).select(kept).to_batches()

    return rows.mapInArrow(run, "cell long, key long, half int, rid binary, keys array<bigint>")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets have in common."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    token, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n > 1
    column = (np.cumsum(common) - 1)[at]
    keep = common[at]
    row, column, width = row[keep], column[keep], int(common.sum())
    out = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        x = np.zeros((m, min(COLUMNS, width - start)), np.float32)
        x[row[lo:hi], column[lo:hi] - start] = 1
        out += x @ x.T
    return out


def _links(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """rid, linked (documents of other sets at the threshold or above, of those that meet here first), root (a set of the
    cell that it hangs together with by links). rows: cell, key, half, rid, keys, size, text, sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, "cell"):
            if cell.num_rows < 2:
                continue
            rid, size = cell.column("rid").to_pylist(), cell.column("size").to_numpy()
            sets = [shingle_set(t, width) for t in cell.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], np.float64)
            both = _shared(sets)
            link = _due(cell, both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9)
            linked = link @ size
            root = [None] * len(rid)
            some = rest = np.flatnonzero(linked)
            while len(rest):
                front, first, rest = rest[:1], rid[rest[0]], rest[1:]
                root[front[0]] = first
                while len(front):
                    hit = link[front][:, rest].any(axis=0)
                    front, rest = rest[hit], rest[~hit]
                    for i in front:
                        root[i] = first
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([rid[i] for i in some], pa.binary()), pa.array(linked[some].astype(np.int64)), pa.array([root[i] for i in some], pa.binary())], names=["rid", "linked", "root"])

    return rows.mapInArrow(run, "rid binary, linked long, root binary")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """v, label (the least vertex of its component) for links (a, b) of any orderable type."""
    both = materialise(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "cc-edges")
    label = written = materialise(spark, both.groupBy("v").agg(F.least("v", F.min("u")).alias("label")), "cc-0")
    for step in range(1, 100):
        seen = both.join(label.select(F.col("v").alias("u"), F.col("label").alias("l")), "u").select("v", "l", F.lit(None).alias("was"))
        own = label.select("v", F.col("label").alias("l"), F.col("label").alias("was"))
        closer = own.unionByName(seen).groupBy("v").agg(F.min("l").alias("label"), F.max("was").alias("was"))
        jump = label.select(F.col("v").alias("label"), F.col("label").alias("far"))
        after = materialise(spark, closer.join(jump, "label", "left").select("v", "was", F.least("label", F.coalesce("far", "label")).alias("label")), f"cc-{step}")
        discard(written)
        label, written = after.select("v", "label"), after
        if after.where(F.col("was") != F.col("label")).isEmpty():
            return label
    raise RuntimeError("components have not settled after 100 rounds of pointer jumping")


def jaccard_classes(spark: SparkSession, docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, tk1, tk2 (content key), class_id, n_links, keeper.

    class_id: the smallest doc_id of the connected component of links; n_links: how many other rows are at the threshold
    or above, copies included, each link found with a probability of target_recall at least; keeper: this row's (doc_id,
    content key) is the least of its class. Null texts and texts without words have no links and are classes of their own.
    Repeated rows count as copies. A null doc_id sorts first for keeper and is never a class_id unless the class has no
    other id. Very long texts count whole: a leaf of large sets is searched in smaller blocks. An empty table gives no
    rows. Other columns of docs are not read, so their names cannot clash.
    """
    prints = materialise(spark, _prints(docs, width), "path-prints")
    reps = prints.where(F.col("rid").isNotNull()).groupBy("rid").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "tk1", "tk2")).alias("least"), F.first("sig").alias("sig"))
    reps = materialise(spark, reps, "path-reps")
    leaves, done, depth = None, 0, 0
    while (need := runs_for(target_recall, threshold, depth)) > done:
        more, deep = _leaves(spark, reps, range(done, need))
        leaves, done, depth = more if leaves is None else leaves.unionByName(more), need, max(depth, deep)
    own = leaves.groupBy("rid").agg(F.collect_list(F.struct("key", "m", "w")).alias("x")).select("rid", F.array_sort("x.key").alias("keys"), F.explode("x").alias("x"))
    cells = _grid(own.select("rid", "keys", "x.*")).join(reps.select("rid", "sig"), "rid").select("cell", "key", "half", "rid", "keys", "sig")
    near = materialise(spark, _partners(cells.repartition("cell").sortWithinPartitions("cell"), floor_for(target_recall, threshold)), "path-near")

    chosen = near.select("rid").distinct().join(reps.select("rid", "size", "least.*"), "rid")
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text").alias("d")
    s = chosen.alias("s")
    on = (F.col("d.tk1") == F.col("s.tk1")) & (F.col("d.tk2") == F.col("s.tk2")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    # a shuffle at any size: the sets that have partners grow with the corpus
    texts = keyed.join(s.hint("merge"), on).select("rid", "size", "text").dropDuplicates(["rid"])
    meet = near.join(texts.hint("merge"), "rid").select("cell", "key", "half", "rid", "keys", "size", "text")
    links = materialise(spark, _links(meet.repartition("cell").sortWithinPartitions("cell"), width, threshold), "path-links")
    discard(near)

    label = components(spark, links.where(F.col("root") != F.col("rid")).select(F.col("root").alias("a"), F.col("rid").alias("b")).distinct())
    degree = links.groupBy("rid").agg(F.sum("linked").alias("linked"))
    of = reps.join(label.withColumnRenamed("v", "rid"), "rid", "left").join(degree, "rid", "left")
    of = of.select("rid", F.coalesce("label", "rid").alias("label"), "least_id", "least", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    heads = of.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("least").alias("head"))
    info = materialise(spark, of.join(heads, "label").select("rid", "class_id", "head", "n_links"), "path-classes")
    out = prints.select("doc_id", "tk1", "tk2", "rid").join(info, "rid", "left")
    keeper = F.col("rid").isNull() | F.col("head").eqNullSafe(F.struct("doc_id", "tk1", "tk2"))
    return out.select("doc_id", "tk1", "tk2", F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), keeper.alias("keeper"))


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """docs with one row of each class: the least (doc_id, content key), and of rows equal in both one. Null texts and
    texts without words all stay; an empty table stays empty; all columns pass through."""
    classes = jaccard_classes(spark, docs, width, threshold, target_recall)
    own = own_prefix(docs)
    t1, t2, worded = f"{own}t1", f"{own}t2", f"{own}worded"
    heads = classes.where("keeper").select("doc_id", "tk1", "tk2").distinct().alias("h")
    k1, k2 = text_key(F.col("text"))
    keyed = docs.withColumns({t1: k1, t2: k2, worded: F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))}).alias("d")
    on = (F.col(t1) == F.col("h.tk1")) & (F.col(t2) == F.col("h.tk2")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    kept = keyed.join(heads, on, "left_semi")
    single = kept.where(worded).dropDuplicates(["doc_id", t1, t2])
    return single.unionByName(kept.where(~F.col(worded))).drop(t1, t2, worded)
