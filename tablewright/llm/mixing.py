"""Mixing to target weights with soft domain membership.

A labelled table names the domain of some documents. A multinomial naive Bayes model over hashed words learns from it and
gives each document a posterior p[d] over the domains. Document rates r >= 0 are fitted so that the expected domain
tokens, the sums over documents of r * tokens * p[d], match the target shares of all tokens: projected gradient on the
squared misses. The misses are weighed by the inverse of the posteriors' Gram matrix, so that domains whose posteriors
overlap don't slow the descent, and the gradient is taken in the token-weighted inner product: the objective's curvature
is then at most 1 and step 1 converges, in one round where no rate is held at 0. A round needs one row of sums, which the
driver reads. It goes on until the misses are below CLOSE or fall no more; what is left is returned with the rates, and
told by a warning, as some targets are out of reach. Rates are an expression of the last rounds on a written column.

DataFrame functions only. Broadcast are the sampled labels (MAX_LABELLED rows) and the model (BUCKETS rows).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialise, own_prefix, text_key
from .decontaminate import words

BUCKETS, MAX_LABELLED, MAX_DOMAINS, SMOOTH, TEMPER = 4096, 4000, 64, 0.5, 40
#: Rounds at most, misses of share that count as none, the least fall of the objective in a round, rounds in an expression,
#: and the ridge of the Gram matrix, in its mean.
ROUNDS, CLOSE, LEAST_FALL, WRITTEN_EVERY, RIDGE = 200, 1e-5, 1e-3, 8, 1e-6


def _bucketed(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode_outer(words(F.col("text"))).alias("w")).select(*keep, F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("w").isNotNull().alias("real"))


def fit_domains(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The domains and, for each of BUCKETS word buckets, lp: log P(bucket | domain).

    docs: doc_id, text; labelled: doc_id, domain. Of rows that repeat an id the least domain counts; null domains and ids
    are left out. MAX_LABELLED rows by id hash are learned from; more than MAX_DOMAINS domains are refused.
    """
    known = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    sample = materialise(spark, bounded_sample(known, F.col("doc_id"), MAX_LABELLED), "mix-labels")
    domains = [r[0] for r in sample.select("domain").distinct().orderBy("domain").limit(MAX_DOMAINS + 1).collect()]
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not domains:
        return [], None
    own = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    rows = _bucketed(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "domain").where("real")
    counts = materialise(spark, rows.groupBy("bucket", own.alias("k")).agg(F.count("*").alias("c")), "mix-counts")
    totals = dict(counts.groupBy("k").agg(F.sum("c")).collect())
    sums = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("k") == k + 1, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(len(domains))])
    all_buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(sums, "bucket", "left")
    lp = [F.log((F.coalesce(f"c{k}", F.lit(0)) + SMOOTH) / (totals.get(k + 1, 0) + SMOOTH * BUCKETS)) for k in range(len(domains))]
    return domains, materialise(spark, all_buckets.select("bucket", F.array(*lp).alias("lp")), "mix-model")


def posteriors(docs: DataFrame, domains: list[str], model: DataFrame) -> DataFrame:
    """doc_id, tk1, tk2, n_tokens, p (one probability for each domain) for every row of docs.

    The mean log likelihood counts as TEMPER words at most, which keeps memberships soft; without words p is even.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *text_key(F.col("text")), "text")
    rows = _bucketed(keyed, "rid", "doc_id", "tk1", "tk2").join(F.broadcast(model), "bucket", "left")
    n = F.count_if("real")
    agg = rows.groupBy("rid", "doc_id", "tk1", "tk2").agg(n.alias("n_tokens"), *[F.sum(F.when(F.col("real"), F.get("lp", F.lit(k)))).alias(f"s{k}") for k in range(len(domains))])
    scale = F.when(F.col("n_tokens") > TEMPER, TEMPER / F.col("n_tokens")).otherwise(1.0)
    s = [F.coalesce(f"s{k}", F.lit(0.0)) * scale for k in range(len(domains))]
    top = F.greatest(*s) if len(s) > 1 else s[0]
    e = agg.select("doc_id", "tk1", "tk2", "n_tokens", F.array(*[F.exp(x - top) for x in s]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return e.select("doc_id", "tk1", "tk2", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a small positive definite matrix, by elimination."""
    n = len(m)
    rows = [[*m[i], *(float(i == j) for j in range(n))] for i in range(n)]
    for i in range(n):
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[n:] for r in rows]


def _dot(p: Column, w: list[float]) -> Column:
    return sum((F.get(p, F.lit(k)) * x for k, x in enumerate(w)), F.lit(0.0))


def fit_rates(spark: SparkSession, rows: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[DataFrame, float]:
    """rows (n_tokens, p and more) with rate, and the largest miss of a domain's share that is left."""
    d = range(len(domains))
    grams = rows.select("n_tokens", "p", F.posexplode("p").alias("k", "x")).groupBy("k").agg(*[F.sum(F.col("n_tokens") * F.col("x") * F.get("p", F.lit(j))) for j in d])
    gram = {r[0]: r[1:] for r in grams.collect()}
    total = sum(sum(r) for r in gram.values()) if gram else 0
    rows = rows.withColumn("rate", F.lit(1.0))
    if not total:
        return rows, 0.0
    gram = [[x / total for x in gram[k]] for k in d]
    share = [sum(r) for r in gram]
    want = [max(0.0, targets.get(name, 0.0)) if s > 1e-9 else 0.0 for name, s in zip(domains, share, strict=True)]
    want = [w / sum(want) for w in want] if sum(want) else share
    ridge = RIDGE * sum(gram[k][k] for k in d) / len(domains)
    weight = inverse([[x + ridge * (i == j) for j, x in enumerate(r)] for i, r in enumerate(gram)])
    rate, now, before, written = F.col("rate"), share, None, None
    for step in range(1, ROUNDS + 1):
        miss = [a - b for a, b in zip(now, want, strict=True)]
        push = [sum(w * m for w, m in zip(r, miss, strict=True)) for r in weight]
        squared = sum(a * b for a, b in zip(push, miss, strict=True))
        if max(map(abs, miss)) <= CLOSE or (before is not None and squared > before * (1 - LEAST_FALL)):
            break
        before = squared
        rate = F.greatest(F.lit(0.0), rate - _dot(F.col("p"), push))
        if step % WRITTEN_EVERY == 0:
            rows, old = materialise(spark, rows.withColumn("rate", rate), f"mix-rates-{step}"), written
            rate, written = F.col("rate"), rows
            if old is not None:
                discard(old)
        got = rows.agg(*[F.sum(rate * F.col("n_tokens") * F.get("p", F.lit(k))) for k in d]).first()
        now = [(x or 0.0) / total for x in got]
    left = max(abs(a - b) for a, b in zip(now, want, strict=True))
    if left > CLOSE:
        warnings.warn(f"the wanted shares of tokens are missed by up to {left:.2g}: {dict(zip(domains, now, strict=True))}", stacklevel=3)
    return rows.withColumn("rate", rate), left


def mix_rates(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, tk1, tk2, n_tokens, domain (likeliest), p_domain, mix_rate, miss for every row of docs (doc_id, text).

    targets: the wanted share of tokens of each domain; shares of domains that were not learned or that hold no tokens
    are spread over the others, and learned domains without a target get 0. miss, the same in all rows, is the largest
    difference that is left between a wanted share and the expected one; more than CLOSE means that the targets are out of
    reach of these posteriors. Null, empty and wordless texts have 0 tokens and an even posterior; they are rated like any
    other but weigh nothing. Of equally likely domains the first by name is named. Without labels every rate is 1 and the
    domain null. Repeated rows are rated alike. Very long texts count whole. An empty table gives no rows. Other columns
    of docs are not read, so their names cannot clash.
    """
    domains, model = fit_domains(spark, docs, labelled)
    if not domains:
        n = F.size(words(F.coalesce("text", F.lit("")))).cast("long")
        none = (F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("p_domain"), F.lit(1.0).alias("mix_rate"), F.lit(0.0).alias("miss"))
        return docs.select("doc_id", *text_key(F.col("text")), n.alias("n_tokens"), *none)
    rows, left = fit_rates(spark, materialise(spark, posteriors(docs, domains, model), "mix-posteriors"), domains, targets)
    best = F.array_max("p")
    domain = F.get(F.array(*map(F.lit, domains)), (F.array_position("p", best) - 1).cast("int"))
    return rows.select("doc_id", "tk1", "tk2", "n_tokens", domain.alias("domain"), best.alias("p_domain"), F.col("rate").alias("mix_rate"), F.lit(left).alias("miss"))


def mixed(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """docs with mix_rate (how often a document should be drawn); a column of this name is replaced, all others pass
    through. Every row stays, null, empty and repeated ones too; an empty table stays empty."""
    rates = mix_rates(spark, docs, labelled, targets).select("doc_id", "tk1", "tk2", "mix_rate").dropDuplicates(["doc_id", "tk1", "tk2"]).alias("r")
    k1, k2 = text_key(F.col("text"))
    t1, t2 = own_prefix(docs) + "t1", own_prefix(docs) + "t2"
    d = docs.drop("mix_rate").withColumns({t1: k1, t2: k2}).alias("d")
    on = (F.col(t1) == F.col("r.tk1")) & (F.col(t2) == F.col("r.tk2")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
    return d.join(rates, on, "left").select("d.*", "r.mix_rate").drop(t1, t2)
