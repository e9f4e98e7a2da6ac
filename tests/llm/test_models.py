"""Trained operators: held-out accuracy, and odd rows."""

import random
import re
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import langid, mixing, quality, toxicity
from tablewright.llm.common import bounded_sample, crc_mod

SOUNDS = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "über", "ung", "ein"], "cc": ["ción", "ña", "que", "os"]}


def sentence(rng, lang, n=40):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SOUNDS)), rng.randint(3, 80)), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 %% !!", "cc"), (1003, sentence(rng, "bb", 20_000), "bb"), (None, sentence(rng, "cc"), "cc"), (1004, sentence(rng, "aa"), None), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_langid(spark, docs):
    rest = crc_mod(F.col("doc_id"), 4)
    net = langid.fit(docs, F.coalesce(rest != 2, F.lit(False)))
    got = langid.identify(docs.withColumn("score", F.lit("old")), net).withColumn("held", rest == 2).collect()
    held = [r for r in got if r.held and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) and len(held) > 60
    odd = {r.doc_id: r for r in got}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1000, 1001, 1002))
    assert odd[1003].lang_pred == "bb" and odd[None].lang_pred == "cc" and odd[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    assert langid.identify(docs.limit(0), net).count() == 0
    assert langid.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_identification_against_loops(spark, docs):
    """The network written as loops over bytes, filters and places, for whole texts of several windows."""
    rng = np.random.default_rng(3)
    net = langid.ByteCNN(["p", "q", "r"], {w: rng.normal(size=(w, 256, 4)).astype(np.float32) for w in (2, 3)}, rng.normal(size=(8, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    few = docs.where("length(text) < 1500").limit(25)
    for r in langid.identify(few, net).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        raw = [b + 32 if 65 <= b <= 90 else b for b in r.text.encode()]
        p, total = np.zeros(3), 0
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            window = part + [0] * (langid.WINDOW - len(part))
            best = [max(sum(float(t[j, window[i + j], f]) for j in range(w)) for i in range(langid.WINDOW - w + 1)) for w, t in net.tables.items() for f in range(4)]
            z = np.array([sum(max(0.0, b) * float(net.out[k, c]) for k, b in enumerate(best)) + float(net.bias[c]) for c in range(3)])
            e = np.exp(z - z.max())
            p, total = p + len(part) * e / e.sum(), total + len(part)
        p /= total
        assert r.lang_pred == net.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-3


def test_many_languages_and_a_bound_on_them(spark):
    rows = [(i, f"{'abcdefgh'[i % 8] * 3} text {i}", "abcdefgh"[i % 8]) for i in range(400)] + [(1000 + i, "aaa more", "a") for i in range(50)]
    df = spark.createDataFrame(rows + [rows[0]] * 30, "doc_id long, text string, lang string")
    assert langid.fit(df, F.lit(True), max_docs=40).langs == list("abcdefgh")
    assert langid.fit(df, F.lit(True), max_docs=40, max_langs=3).langs == ["a", "b", "c"]


def test_convolution_gradient_learns_exactly():
    x = np.zeros((40, langid.WINDOW), np.uint8)
    x[:20, 100:104], x[20:, 7:11] = list(b"abcd"), list(b"abdc")
    net = langid.train(x, np.repeat([0, 1], 20), ["p", "q"], epochs=30)
    assert (net.log_proba(x).argmax(axis=1) == np.repeat([0, 1], 20)).all()


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(300)}" if rng.random() < 0.1 else rng.choice(["ba", "de", "ko", "mu", "ri", "so"]) for _ in range(30)]
        toxic = rng.random() < 0.15
        if toxic:
            words[rng.randrange(30)] = rng.choice(["Nasty,", "VILE", "hateful!"])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, None, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "ba " * 50_000 + "vile"), (None, "so vile"), rows[3], rows[3]]
    labels += [(None, None, 1), (4, None, None), labels[0]]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab, F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(False)))
    got = toxicity.score(docs, model).collect()
    for r in got:
        bad = any(w in (r.text or "").lower() for w in ("nasty", "vile", "hateful"))
        assert r.predicted == int(bad) == int(r.score >= 0.7), r.text
    assert len(got) == len(rows) and toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs, lab.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}


def test_pu_risk_is_corrected():
    """Positives hidden in the unlabelled rows must not lower the score of their word."""
    positive = [{"bad", "x"}] * 50
    unlabelled = [{"bad", "x"}] * 40 + [{"x"}] * 360
    model = toxicity.train(positive, unlabelled, 0.1)
    assert model.score("bad x") > 0.9 and model.score("x") < 0.1


def test_minimised_risk_against_a_grid():
    """The non-negative risk as it is written down: no weight and bias of a grid has less, where the correction binds and
    where it doesn't."""
    def risk(model, positive, unlabelled, prior, decay=2e-5):
        rows = lambda c: (np.array([[float(0 in t)] for t in c]), np.array(list(c.values()), float) / sum(c.values()))
        (xp, wp), (xu, wu) = rows(positive), rows(unlabelled)
        w, b = np.array([model[0]]), model[1]
        zp, zu = xp @ w + b, xu @ w + b
        return prior * (wp @ np.logaddexp(0, -zp)) + max(0.0, wu @ np.logaddexp(0, zu) - prior * (wp @ np.logaddexp(0, zp))) + decay / 2 * w @ w

    for hits, prior in ((30, 0.3), (60, 0.5), (10, 0.2)):
        positive, unlabelled = Counter({(0,): 80, (): 20}), Counter({(0,): hits, (): 200 - hits})
        model = toxicity.minimise(["x"], positive, unlabelled, prior, steps=4000, rate=0.02)
        got = risk((model.weights["x"], model.bias), positive, unlabelled, prior)
        best = min(risk((w, b), positive, unlabelled, prior) for w in np.arange(-2, 12, 0.25) for b in np.arange(-8, 4, 0.25))
        assert got <= best + 0.02, (hits, got, best)


def test_scores_against_plain_words(spark):
    """Scores from a plain reading of words and their beginnings."""
    model = toxicity.WordModel({"vile": 2.0, "nast-": 1.0, "nast+": 0.5, "kind": -3.0}, -1.0)
    texts = ["Vile", "nasty", "nasty nastier", "vile kind", "", None, "nothing", "VILE! nasty-nastiest kind"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        w = set(re.findall("[a-z]+", (r.text or "").lower()))
        starts = [x[:4] for x in w if len(x) > 4]
        z = -1 + 2 * ("vile" in w) + ("nast" in starts) + 0.5 * (starts.count("nast") > 1) - 3 * ("kind" in w)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_prior_can_be_given(spark):
    rows = [(i, f"{'bad' if i % 4 == 0 else 'some'} w{i} x{i} y{i} z{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    only = spark.createDataFrame([(i, 1) for i in range(0, 400, 8)], "doc_id long, toxic int")
    # all labels are positive: their share says nothing of the rows
    assert toxicity.fit(docs, only, F.lit(True), prior=0.25).score("some word") < 0.2


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(10, 80))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), int(good and rng.random() < 0.2)))
    rows += [(1000, None), (1001, ""), (1002, "lorem ipsum, " * 20_000), (None, "lorem dolor. sit amet, ipsum lorem dolor sit amet"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tail": F.lit("old"), "ts": F.timestamp_micros(F.lit(5))})
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1), labels[0]], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.graded(lab))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.rate(docs, model).collect()
    truth = {i: q for i, q, _ in labels}
    right = [r.selected == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert sum(right) >= 0.97 * len(right) and len(got) == len(rows)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail <= 1 for r in got)
    kept = quality.keep_selected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.selected for r in got)
    assert quality.rate(docs.limit(0), model).count() == 0
    assert quality.rate(docs, quality.fit(docs, quality.graded(lab.limit(0)))).count() == len(rows)


def test_ratings_against_loops(spark):
    """Hashed features and tail probabilities, written as loops."""
    rng = np.random.default_rng(4)
    model = quality.OrdinalModel(rng.normal(size=quality.WIDTH).astype(np.float32), np.array([-0.5, 0.7]))
    texts = ["Some words, and Some more words: 12!", "é\n\tüb", "ab", "", None, "x " * 5000]

    def classed(b):
        return 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b == 10 else 4 if b == 32 else 5 if b >= 128 else 6 + b % 10

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.rate(df, model).collect():
        raw, z, n = list((r.text or "").encode()), 0.0, Counter()
        for i in range(len(raw) - 2):
            a, b, c = raw[i : i + 3]
            n[((a * 65536 + b * 256 + c) * 2654435761 >> 15) % quality.HASHED] += 1
            n[quality.HASHED + classed(a) * 256 + classed(b) * 16 + classed(c)] += 1
        for k, m in n.items():
            z += float(model.weights[k]) * (m / (len(raw) - 2)) ** 0.5
        w = (r.text or "").split()
        at = quality.HASHED + quality.SHAPED
        if w:
            z += float(model.weights[at + min(15, int(len(set(w)) / len(w) * 16))])
        z += float(model.weights[at + 16 + min(15, len(raw).bit_length())])
        tails = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert abs(r.expected_grade - sum(tails)) < 1e-4 and abs(r.tail - tails[0]) < 1e-4 and r.selected == (r.tail >= 0.5)


def test_ordinal_likelihood_against_a_grid():
    x = np.array([[0.0], [1.0], [0.0], [1.0], [0.0], [1.0], [1.0]], np.float32)
    y = np.array([0, 2, 1, 2, 0, 1, 2])
    model = quality.train(x, y, 3, steps=3000, rate=0.02, decay=0)

    def loss(w, a, b):
        z = x[:, 0] * w
        t = [np.ones(7), 1 / (1 + np.exp(a - z)), 1 / (1 + np.exp(b - z)), np.zeros(7)]
        return -np.mean([np.log(t[g][i] - t[g + 1][i]) for i, g in enumerate(y)])

    best = min(loss(w, a, a + d) for w in np.arange(0, 8, 0.25) for a in np.arange(-3, 4, 0.25) for d in np.arange(0.25, 6, 0.25))
    assert loss(model.weights[0], *model.thresholds) <= best + 0.01


def test_bounded_sample(spark):
    df = spark.range(5000)
    assert bounded_sample(df, F.col("id"), 100).distinct().count() == 100 and bounded_sample(df, F.col("id"), 9000).count() == 5000
    assert bounded_sample(df.limit(0), F.col("id"), 5).count() == 0


def test_mixing(spark, docs):
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    targets = {"aa": 0.5, "bb": 0.3, "cc": 0.2, "none": 0.4}
    got = mixing.mix_rates(spark, docs.withColumn("mix_rate", F.lit("old")), labelled, targets).collect()
    assert len(got) == docs.count()
    total = sum(r.n_tokens for r in got)
    for lang, share in (("aa", 0.5), ("bb", 0.3), ("cc", 0.2)):
        mass = sum(r.mix_rate * r.n_tokens for r in got if r.domain == lang)
        assert abs(mass / total - share) < 0.02, lang
    assert all(r.mix_rate >= 0 for r in got)
    out = mixing.mixed(spark, docs.withColumn("mix_rate", F.lit("old")), labelled, targets)
    assert out.columns == [*docs.columns, "mix_rate"] and out.count() == docs.count() and out.where("mix_rate is null").count() == 0
    assert {r.mix_rate for r in mixing.mix_rates(spark, docs, labelled.limit(0), targets).collect()} == {1.0}
    assert mixing.mix_rates(spark, docs.limit(0), labelled, targets).count() == 0


def test_rates_are_the_projected_gradient(spark, docs):
    """The same iteration in numpy, on the posteriors that Spark made."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    targets = {"aa": 0.7, "bb": 0.2, "cc": 0.1}
    domains, model = mixing.fit_domains(spark, docs, labelled)
    rows = mixing.posteriors(docs, domains, model).collect()
    p, n = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows], float)
    want, r = np.array([targets[d] for d in domains]), np.ones(len(n))
    gram = (p * n[:, None]).T @ p / n.sum()
    weight = np.linalg.inv(gram + mixing.RIDGE * np.trace(gram) / len(domains) * np.eye(len(domains)))
    for _ in range(mixing.ROUNDS):
        miss = (p * (r * n)[:, None]).sum(axis=0) / n.sum() - want
        if abs(miss).max() <= mixing.CLOSE:
            break
        r = np.maximum(0, r - p @ (weight @ miss))
    got = {(x.doc_id, x.tk1): x for x in mixing.mix_rates(spark, docs, labelled, targets).collect()}
    assert all(abs(got[x.doc_id, x.tk1].mix_rate - y) < 1e-6 and got[x.doc_id, x.tk1].miss <= mixing.CLOSE for x, y in zip(rows, r, strict=True))


def test_posteriors_are_naive_bayes(spark, docs):
    """Model and posteriors against the same in numpy, from the hashed words."""
    labelled = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    domains, model = mixing.fit_domains(spark, docs, labelled)
    bucket = F.transform(mixing.words(F.coalesce("text", F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(mixing.BUCKETS)).cast("int"))
    rows = docs.select("doc_id", "lang", "text", bucket.alias("b")).collect()
    counts = np.zeros((len(domains), mixing.BUCKETS))
    for r in rows:
        if r.doc_id is not None and r.doc_id % 2 == 0 and r.lang:
            np.add.at(counts[domains.index(r.lang)], r.b, 1)
    lp = np.log((counts + mixing.SMOOTH) / (counts.sum(axis=1, keepdims=True) + mixing.SMOOTH * mixing.BUCKETS))
    assert np.allclose(np.array([r.lp for r in model.orderBy("bucket").collect()]).T, lp)
    want = []
    for r in rows:
        s = lp[:, r.b].sum(axis=1) * min(1, mixing.TEMPER / max(1, len(r.b)))
        e = np.exp(s - s.max())
        want.append((len(r.b), *(e / e.sum()).round(9)))
    assert sorted(want) == sorted((x.n_tokens, *np.round(x.p, 9)) for x in mixing.posteriors(docs, domains, model).collect())


def test_overlapping_posteriors_reach_the_targets(spark):
    rng = np.random.default_rng(5)
    p = 0.5 + rng.uniform(-0.03, 0.03, 3000)
    rows = spark.createDataFrame([(i, int(n), [float(x), float(1 - x)]) for i, (x, n) in enumerate(zip(p, rng.integers(1, 50, 3000), strict=True))], "doc_id long, n_tokens long, p array<double>")
    for goal, tolerance in ((0.51, 1e-4), (0.9, None)):
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            got, left = mixing.fit_rates(spark, rows, ["a", "b"], {"a": goal, "b": 1 - goal})
        rates = got.select("rate", "n_tokens", "p").collect()
        total = sum(r.n_tokens for r in rates)
        mass = [sum(r.rate * r.n_tokens * r.p[k] for r in rates) / total for k in (0, 1)]
        assert all(r.rate >= 0 for r in rates) and abs(max(abs(mass[0] - goal), abs(mass[1] - 1 + goal)) - left) < 1e-9
        assert left <= tolerance if tolerance else left > 0.1 and said
