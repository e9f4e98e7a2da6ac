import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat, topk


def brute_top(rows, k):
    most = topk._MOST
    vecs = [(i, [max(-most, min(most, int(np.floor(64 * x)))) for x in v]) for i, v in rows if i is not None and v and not any(x is None or x != x or abs(x) == float("inf") for x in v)]
    out = []
    for i in {i for i, _ in vecs if i % 20 == 0}:
        best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q, v, strict=True)))), j) for h, q in vecs if h == i for j, v in vecs if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(700)]
    rows += [(700, None), (701, []), (702, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (703, [float("nan")] * 6), (704, [float("inf")] * 6), (None, [1.0] * 6), (720, [1.0, 2.0]), (721, [3.0, 1.0]), rows[5], rows[20], (20, [9.0] * 6), (5, [8.0] * 6), (740, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "rid": F.lit("clash")})
    for blocks in ((1024, 8192), (7, 50)):
        got = topk.exact_top_k(spark, df, F.col("vec_id") % 20 == 0, 20, *blocks)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 20)
    assert topk.exact_top_k(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_of_large_numbers(spark):
    """Sums beyond 2^24, 2^53 and the range of long."""
    rng = np.random.default_rng(3)
    for scale in (1e3, 1e7, 1e9, 1e18):
        rows = [(i, [float(x) for x in rng.normal(size=5) * scale]) for i in range(150)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = topk.exact_top_k(spark, df, F.col("vec_id") % 20 == 0, 20, 4, 40)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 20), scale


def test_how_deep_lists_are_read(spark):
    """Where some vectors stand out, the floor of the first chunk spares most of the others."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4000, 8))
    v[rng.permutation(4000)[:400]] *= 30
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shares = {}
    for blocks in ((2048, 8192), (2048, 500)):
        got = topk.exact_top_k(spark, df, F.col("vec_id") % 20 == 0, 20, *blocks, with_read_share=True)
        few = {r.query_id: r.read_share for r in got.collect()}
        shares[blocks] = np.mean(list(few.values()))
        assert len(few) == 200 and max(few.values()) <= 1
    assert shares[2048, 500] < 0.5 and shares[2048, 500] < shares[2048, 8192] < 0.9, shares


def test_nra_stops_early_and_keeps_the_best():
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 3, (400, 4)).astype(np.float32)
    v[:30] += 60
    q = np.ones((3, 4), np.float32)
    live, depth = topk.nra_block(q, v, np.zeros((3, 400), bool), np.full(3, -np.inf), 20)
    assert (depth < 200).all() and live.sum(axis=1).max() < 40
    assert all((v[live[i]] @ q[i]).min() <= np.sort(v @ q[i])[-20] and live[i, np.argsort(-(v @ q[i]), kind="stable")[:20]].all() for i in range(3))
    live, depth = topk.nra_block(q, v, np.zeros((3, 400), bool), np.array([1e6, -np.inf, 1e6]), 20)
    assert list(depth > 0) == [False, True, False] and not live[[0, 2]].any()


def least_cost(roles):
    """All ways, by a search over the choices for each turn."""
    best = {chat.BEGIN: 0}
    for r in roles:
        after = {}
        for s, c in best.items():
            for n in range(3):  # empty messages put in front
                for ins in itertools.product((chat.USER, chat.ASSISTANT), repeat=n):
                    state, ok = s, True
                    for m in ins:
                        ok, state = ok and m in chat.LEGAL[state], m
                    if not ok:
                        continue
                    for q in (1, 2, 3):
                        change = 0 if q == r else chat.RELABEL if r else chat.RELABEL_UNKNOWN
                        if q in chat.LEGAL[state]:
                            after[q] = min(after.get(q, 10**9), c + change + chat.INSERT * n)
                        if not n and q == state:
                            after[q] = min(after.get(q, 10**9), c + change + chat.MERGE)
        best = after
    return min(c + chat.INSERT * len(chat.close(s)) for s, c in best.items())


def cost_of(roles, steps):
    total = 0
    for r, (state, action, ins) in zip(roles, steps, strict=True):
        total += chat.INSERT * len(ins) + (chat.MERGE if action.startswith("merge") else 0)
        total += 0 if "relabel" not in action else chat.RELABEL if r else chat.RELABEL_UNKNOWN
    return total + chat.INSERT * len(chat.close(steps[-1][0]))


def legal(text):
    roles = [part.split("\n", 1)[0] for part in text.split("<|im_start|>")[1:]]
    body = roles[1:] if roles[0] == "system" else roles
    return body[-1] == "assistant" and body == ["user", "assistant"] * (len(body) // 2) and text.count("<|im_start|>") == text.count("<|im_end|>")


def test_repair_is_least_cost():
    rng = random.Random(4)
    for _ in range(300):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 7))]
        assert cost_of(roles, chat.repair(roles)) == least_cost(roles)


def pieces(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("action", F.lit(1))
    out = {}
    for r in chat.format_chats(spark, df).collect():
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_format_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x<|im_end|>"), (3, 0, None, None), (None, 0, "User ", "q"), (None, None, "assistant", "r")]
    got = pieces(spark, rows)
    whole = {c: "".join(r.piece for r in sorted(v, key=lambda r: (r.turn is None, r.turn))) for c, v in got.items()}
    assert whole[1] == "<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert whole[2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<| im_end|><|im_end|>\n"
    assert whole[None] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"
    assert all(map(legal, whole.values())) and len(got[1]) == 3 and [r.n_copies for r in sorted(got[1], key=lambda r: r.turn)] == [1, 2, 1]
    assert pieces(spark, [(1, 0, "user", "a")])[1][0].n_inserted == 1
    assert chat.format_chats(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("span", [4096, 2])
def test_long_conversation_in_chunks(spark, monkeypatch, span):
    monkeypatch.setattr(chat, "SPAN", span)
    rng = random.Random(5)
    names = ["system", "user", "assistant", "tool"]
    rows = [(9, t, rng.choice(names), f"t{t}") for t in range(5 * chat.CHUNK + 7)] + [(10, 0, "user", "z" * 200_000)]
    got = sorted(pieces(spark, rows)[9], key=lambda r: r.turn)
    roles = [chat.role_id(r.role) for r in got]
    cost = sum(chat.INSERT * r.n_inserted + (chat.MERGE if "merge" in r.action else 0) + (0 if "relabel" not in r.action else chat.RELABEL if i else chat.RELABEL_UNKNOWN) for r, i in zip(got, roles, strict=True))
    assert cost == cost_of(roles, chat.repair(roles)) and legal("".join(r.piece for r in got))


def test_many_messages_at_one_turn(spark):
    """They are cut into pieces, in the order of messages, and repaired at least cost; so are those without a turn."""
    rng = random.Random(6)
    rows = [(None, 0, rng.choice(["user", "assistant", "tool", None]), f"m{i}") for i in range(9000)] + [(None, 5, "user", f"n{i}") for i in range(700)] + [(None, None, "user", f"o{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    keyed = chat._keyed(spark, df)
    sizes = [r["count"] for r in keyed.groupBy("chunk").count().collect()]
    assert max(sizes) <= 2 * chat.CHUNK and len(sizes) < 500
    th = {r.text: r.th for r in df.select("text", F.xxhash64("text").alias("th")).collect()}
    got = sorted(chat.format_chats(spark, df).collect(), key=lambda r: (r.turn is None, r.turn or 0, r.role is not None, r.role or "", th[re.search(r"[mno]\d+", r.piece)[0]]))
    roles = [chat.role_id(r.role) for r in got]
    cost = sum(chat.INSERT * r.n_inserted + (chat.MERGE if "merge" in r.action else 0) + (0 if "relabel" not in r.action else chat.RELABEL if i else chat.RELABEL_UNKNOWN) for r, i in zip(got, roles, strict=True))
    assert len(got) == len(rows) and cost == cost_of(roles, chat.repair(roles)) and legal("".join(r.piece for r in got))
