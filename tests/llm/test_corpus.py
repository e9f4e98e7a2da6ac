"""Operators on pairs, lines and passages: against brute force, and on odd rows."""

import os
import random
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chosenpath, common, decontaminate, linededup

DOCS = "doc_id long, text string, source string"


def shingles(text, width=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def prose(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def altered(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randrange(6, 400))
        texts += [" ".join(altered(rng, base, rng.randrange(0, 1 + len(base) // 40))) for _ in range(rng.randrange(1, 6))]
    base = prose(rng, 150)
    texts += [" ".join(altered(rng, base, 1)) for _ in range(120)] + [" ".join(base)] * 40
    texts += [None, None, "", "", "...", "one two", "One, TWO!", " ".join(prose(rng, 20_000))]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0], None), (None, "alone here now", None)]


def brute_classes(rows):
    sets = [shingles(t) for _, t, _ in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((rows[i][0], least.get(find(i)) if sets[i] else rows[i][0], links[i]) for i in range(n)), key=key)


def test_jaccard_classes(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).withColumn("rid", F.lit("clash")).withColumn("class_id", F.lit(0))
    key = lambda r: tuple((x is not None, x) for x in r)
    want = brute_classes(rows)
    got = [tuple(r) for r in chosenpath.jaccard_classes(spark, df).select("doc_id", "class_id", "n_links").collect()]
    assert sorted(got, key=key) == want
    # small blocks: splits and grids
    for name, value in (("SMALL", 8), ("BLOCK", 6), ("WEIGHT", 3000)):
        monkeypatch.setattr(chosenpath, name, value)
    got = [tuple(r) for r in chosenpath.jaccard_classes(spark, df).select("doc_id", "class_id", "n_links").collect()]
    assert sorted(got, key=key) == want


def test_short_near_pairs(spark):
    """Pairs at 0.8 of 4 and 5, and of 9 and 9 shingles."""
    rng = random.Random(9)
    texts = []
    for _ in range(200):
        a, b = prose(rng, 8, 10**6), prose(rng, 13, 10**6)
        texts += [" ".join(a), " ".join([*a, "more"]), " ".join(b), " ".join([*b[:-1], "other"])]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = [tuple(r) for r in chosenpath.jaccard_classes(spark, spark.createDataFrame(rows, DOCS)).select("doc_id", "class_id", "n_links").collect()]
    want = brute_classes(rows)
    assert sum(n for _, _, n in want) == len(rows) and sorted(got) == want


def test_recall_by_length(spark):
    """Links at 0.80 to 0.85, of texts of all lengths: 0.99 of each kind at least, and no false one."""
    rng = random.Random(19)
    texts, kinds = [], []
    for low, high, kind in ((8, 10, "short"), (11, 30, "middle"), (100, 160, "long")):
        while kinds.count(kind) < 600:
            base = prose(rng, rng.randint(low, high), 10**7)
            other = base[: len(base) - rng.randint(0, 1 + len(base) // 8)] if rng.random() < 0.5 else altered(rng, base, 1 + len(base) // 100)
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            if 0.8 <= len(a & b) / len(a | b) <= 0.85:
                texts += [" ".join(base), " ".join(other)]
                kinds.append(kind)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.jaccard_classes(spark, df).collect()}
    for kind in ("short", "middle", "long"):
        pairs = [i for i, k in enumerate(kinds) if k == kind]
        assert sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in pairs) >= 0.99 * len(pairs), kind
    assert all(c in (i, i - i % 2) for i, (c, _) in got.items())


def test_runs_reach_the_target_recall():
    assert chosenpath.runs_for(0.99999) == 8 and chosenpath.runs_for(0.9) < chosenpath.runs_for(0.99) < chosenpath.runs_for(0.99999, depth=4)
    rng = np.random.default_rng(1)
    for target in (0.9, 0.99):
        for depth in (0, 2, 5):
            runs = chosenpath.runs_for(target, depth=depth)

            def stays(d):
                return d == 0 or any(rng.random() < 0.8 and stays(d - 1) for _ in range(chosenpath.CHILDREN))

            missed = sum(not any(rng.random() < 0.8 and stays(depth) for _ in range(runs)) for _ in range(4000)) / 4000
            assert missed <= (1 - target) / 2 + 0.01


def test_slots_agree_independently():
    """As many slots agree as of independent ones, at every size: no pair at 0.8 in 2,000 is under the floor."""
    rng = np.random.default_rng(4)
    for n, common in ((4, 4), (9, 8), (18, 16), (36, 32), (72, 64), (900, 800)):
        m = 5 if n == 4 else n
        agree = []
        for _ in range(2000):
            x = rng.integers(0, 2**64, n + m - common, dtype=np.uint64)
            agree.append((chosenpath.embedding(np.sort(x[:n])) == chosenpath.embedding(np.sort(x[n - common :]))).mean())
        assert min(agree) * chosenpath.SLOTS >= chosenpath.floor_for(chosenpath.TARGET_RECALL) and abs(np.mean(agree) - 0.8) < 0.01 and np.std(agree) < 0.055


def test_one_of_each(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, DOCS)
    kept = chosenpath.one_of_each(spark, df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    classes = {c for i, c, _ in brute_classes(rows) if c is not None}
    words = [t for t in texts if shingles(t)]
    assert len(words) == len(set(words)) and sum(1 for t in texts if t is None) == 2 and texts.count("") == 2
    with_words = {c for (i, t, _), c in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), [x[1] for x in brute_classes(rows)], strict=True) if shingles(t)}
    assert len(words) == len(with_words) and with_words - {None} <= classes
    assert chosenpath.one_of_each(spark, df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 180)]
    got = {r.v: r.label for r in chosenpath.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in parent}


def test_contaminated(spark):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, rng.randrange(5, 90)))) for i in range(60)]
    items += [(60, "too short"), (61, None), (None, "a b c d e f g"), (62, ""), (5, items[5][1]), (5, "quite another text of this item here"), (63, "Unique!"), (64, "one two three four")]
    docs = [(i, " ".join(prose(rng, 300)), "s") for i in range(20)]
    for i, (_, t) in enumerate(items[:60]):
        w = t.split()
        cut = w[: max(5, int(len(w) * rng.choice([0.6, 0.8, 0.85, 1])))]
        docs.append((100 + i, " ".join(prose(rng, 50) + cut + prose(rng, 50)), "s"))
    docs += [docs[25], (None, docs[30][1], "s"), (1, docs[31][1], "s"), (500, None, "s"), (501, "", "s"), (503, "it is too, short", "s"), (504, "so unique", "s"), (505, "now one two three four five", "s"), (506, "one two four three; short too", "s"), (507, "and quite another text of this item here it is", "s"), (502, " ".join(prose(rng, 30_000)) + " " + items[7][1].upper(), "s")]
    def item_set(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def runs(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}

    best = {}
    for d, t, _ in docs:
        for i, u in items:
            if t and u and i is not None and (s := item_set(u)) and len(s & runs(t)) >= 0.8 * len(s) - 1e-9:
                key, found = (d, hash(t), i), (len(s & runs(t)) / len(s), len(s), len(s & runs(t)))
                best[key] = max(best.get(key, found), found)
    want = {(*k, v[1], v[2]) for k, v in best.items()}
    assert {i for _, _, i, _, _ in want} >= {60, 63, 64}
    df = spark.createDataFrame(docs, DOCS).withColumn("h", F.lit("clash")).withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark, df, it)
    assert sorted(((r.doc_id is None, r.doc_id), r.item_id, r.n_item, r.n_found) for r in got.collect()) == sorted(((w[0] is None, w[0]), w[2], w[3], w[4]) for w in want)
    left = decontaminate.decontaminate(spark, df, it)
    bad = {w[1] for w in want}
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t, _ in docs if t is None or hash(t) not in bad)
    assert decontaminate.contaminated(spark, df, it.limit(0)).count() == 0 and decontaminate.contaminated(spark, df.limit(0), it).count() == 0
    assert decontaminate.decontaminate(spark, df, it.limit(0)).count() == len(docs)


def test_shuffled_when_the_benchmark_is_large(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "x a b c d e f y", "s"), (2, "other words here are many", "s")], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, items).collect()] == [(1, 1)]


def test_lines(spark):
    rng = random.Random(7)
    common, near, rare = "accept all cookies", "nearly everywhere", "seldom seen"
    rows = []
    for i in range(60):
        lines = [f"own line {i}", ""] + ([common] if i % 2 else []) + ([f" {near} "] if i % 20 < 9 else []) + ([rare] if i % 20 < 3 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 20}"))
    rows += [(90, common, "s1"), (91, None, "s1"), (92, "", None), (93, f"{common}\nkept", None), rows[1], rows[1], (94, "\n".join([common, "x"] * 3000), "s1")]
    spread = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" ") and s:
                spread.setdefault(x.strip(" "), set()).add(s)
    bad = {x for x, s in spread.items() if len(s) >= 10}
    assert bad == {common}

    def clean(t, copies=frozenset()):
        if t is None or t in copies:
            return t, 0
        lines = t.split("\n")
        left = [x for x in lines if x.strip(" ") not in bad]
        return "\n".join(left), len(lines) - len(left)

    df = spark.createDataFrame(rows, DOCS).withColumn("l1", F.lit("clash")).withColumn("n_chars", F.length("text"))
    got = linededup.remove_cross_site_lines(spark, df)
    assert sorted((r.doc_id, str(r.text), r.n_lines_removed) for r in got.collect()) == sorted((d, str(clean(t)[0]), clean(t)[1]) for d, t, _ in rows)
    assert got.where("n_chars <> length(text)").count() == 0
    assert linededup.remove_cross_site_lines(spark, df.limit(0)).count() == 0
    # a text that is on ten sites as a whole can stay; one that only puts such lines together doesn't
    more = rows + [(200 + i, f"{common}\n\n{common}", f"s{i}") for i in range(12)] + [(300 + i, f"{common}\n{common}\n{common}", f"s{i}") for i in range(9)]
    kept = linededup.remove_cross_site_lines(spark, spark.createDataFrame(more, DOCS), keep_copies=True)
    copies = {f"{common}\n\n{common}"}
    assert sorted((r.doc_id, str(r.text), r.n_lines_removed) for r in kept.collect()) == sorted((d, str(clean(t, copies)[0]), clean(t, copies)[1]) for d, t, _ in more)


def test_removal_is_linear_in_the_lines(spark):
    """Four times the lines take about four times as long, not sixteen."""
    import time

    took = {}
    for n in (6_000, 24_000):
        rows = [(i, "\n".join(f"line {j} of a long text" for j in range(n)), f"s{i}") for i in range(12)]
        df = spark.createDataFrame(rows, DOCS).coalesce(4)
        began = time.perf_counter()
        assert {r.n for r in linededup.remove_cross_site_lines(spark, df).select(F.length("text").alias("n")).collect()} == {0}
        took[n] = time.perf_counter() - began
    assert took[24_000] < 8 * took[6_000] + 5, took


def test_shared_folder():
    """No machine-local folder on a cluster; tables of a scope are gone at its end."""
    def session(master, folder=None):
        known = {"spark.checkpoint.dir": folder} if folder else {}
        conf = types.SimpleNamespace(get=lambda k, d=None: known.get(k, d), set=known.__setitem__)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getConf=lambda: types.SimpleNamespace(get=lambda k: None)))

    assert common.shared_dir(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert os.path.isdir(common.shared_dir(session("local[4]"))) and os.path.isdir(common.shared_dir(session("local")))
    for master in ("yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_scratch(spark):
    with common.scratch(spark):
        inner = common.materialise(spark, spark.range(3), "inner")
        kept = common.materialise(spark, spark.range(4), "kept", keep=True)
        assert inner.count() == 3
    place = lambda df: df._written.removeprefix("file:")
    assert not os.path.exists(place(inner)) and kept.count() == 4
    common.discard(kept)
    assert not os.path.exists(place(kept))
