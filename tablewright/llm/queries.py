"""The registered queries opN_<name> and their SQL: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chosenpath, decontaminate, langid, linededup, mixing, quality, surrogate, topk, toxicity
from .common import crc_mod, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, table(spark, sf_dir, "conversations"))


def op3_chosenpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.jaccard_classes(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = linededup.remove_cross_site_lines(spark, docs)
    return out.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"), F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("kept_md5"))


#: A stand-in for a secret that a user of op7 passes in.
SURROGATE_KEY = "example key"
#: The wanted shares of tokens of op5's domains, the languages.
LANG_TARGETS = {"en": 0.4, "fr": 0.25, "de": 0.2, "es": 0.15}


def labelled_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of op5: the language of the documents that labels covers."""
    rated = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(rated, "doc_id", "left_semi")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mix_rates(spark, table(spark, sf_dir, "documents"), labelled_langs(spark, sf_dir), LANG_TARGETS)
    return rates.select("doc_id", "n_tokens", "domain", "p_domain", "mix_rate", "miss")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 4)
    net = langid.fit(docs, F.coalesce(rest != 2, F.lit(False)))
    out = langid.identify(docs.select("doc_id", "text"), net, keep_text=False)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogate.pseudonymise(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return out.select("doc_id", "n_entities", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(rest != 1, F.lit(False)))
    out = toxicity.score(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.rate(docs.select("doc_id", "text"), model, keep_text=False)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_found", "containment")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_chat": op2_chat,
    "op3_chosenpath": op3_chosenpath,
    "op4_linededup": op4_linededup,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_surrogate": op7_surrogate,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_chat": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, count(*) AS n_copies, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text) AS i,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS FIRST, role DESC NULLS LAST, text DESC) = 1 AS last, coalesce(list_position(['system', 'user', 'assistant'], lower(trim(role))), 0) AS k
  FROM conversations GROUP BY conv_id, turn, role, text
), x AS (
  -- c: least cost with the message as system, user and assistant; p: the states up to there
  SELECT conv_id, CAST(0 AS BIGINT) AS i, [0, 1000000, 1000000, 1000000] AS c, [[0], [0], [0], [0]] AS p
  FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL
  SELECT conv_id, i, [1000000, least(1000000, list_min(t1) + f1), list_min(t2) + f2, list_min(t3) + f3],
    [[0], list_append(p[list_position(t1, list_min(t1))], 1), list_append(p[list_position(t2, list_min(t2))], 2), list_append(p[list_position(t3, list_min(t3))], 3)]
  FROM (
    SELECT x.conv_id, m.i, x.p, [c[1], c[2] + 1, 1000000, 1000000] AS t1, [c[1], c[2], c[3] + 1, c[4]] AS t2, [c[1] + 2, c[2] + 2, c[3], c[4] + 1] AS t3,
      CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 0 ELSE 3 END AS f1, CASE WHEN k = 0 THEN 1 WHEN k = 2 THEN 0 ELSE 3 END AS f2, CASE WHEN k = 0 THEN 1 WHEN k = 3 THEN 0 ELSE 3 END AS f3
    FROM x JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.i = x.i + 1)
), e AS (SELECT x.conv_id, [x.c[2] + 4, x.c[3] + 2, x.c[4]] AS c, x.p FROM x JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.i = x.i AND m.last),
b AS (SELECT conv_id, p[list_position(c, list_min(c)) + 1] AS p FROM e),
s AS (SELECT m.*, b.p[i] AS before, b.p[i + 1] AS after, ['system', 'user', 'assistant'][b.p[i + 1]] AS role_out FROM m JOIN b ON m.conv_id IS NOT DISTINCT FROM b.conv_id),
o AS (SELECT *, before = after AS joins, CASE WHEN after = 3 AND before < 2 THEN 1 ELSE 0 END AS filled, CASE WHEN NOT last THEN 0 WHEN after = 1 THEN 2 WHEN after = 2 THEN 1 ELSE 0 END AS closing,
  replace(coalesce(text, ''), '<|im_', '<| im_') AS body, '<|im_end|>' || chr(10) AS stop, '<|im_start|>user' || chr(10) AS asks, '<|im_start|>assistant' || chr(10) AS says FROM s)
SELECT conv_id, turn, role, role_out, CASE WHEN joins THEN CASE WHEN after = k THEN 'merge' ELSE 'merge_relabel' END WHEN after = k THEN 'keep' ELSE 'relabel' END AS action, CAST(filled + closing AS INTEGER) AS n_inserted, n_copies,
  CASE WHEN joins THEN chr(10) || chr(10) || body ELSE CASE WHEN before > 0 THEN stop ELSE '' END || CASE WHEN filled = 1 THEN asks || stop ELSE '' END || '<|im_start|>' || role_out || chr(10) || body END
  || CASE WHEN last THEN stop || CASE closing WHEN 2 THEN asks || stop || says || stop WHEN 1 THEN says || stop ELSE '' END ELSE '' END AS piece FROM o""",
    "op3_chosenpath": r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
x AS (SELECT r, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS x FROM t),
w AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS p FROM x),
g AS (SELECT r, concat_ws(' ', w, lead(w) OVER k, lead(w, 2) OVER k, lead(w, 3) OVER k, lead(w, 4) OVER k) AS s, lead(w, 4) OVER k IS NOT NULL OR p = 1 AS whole FROM w WINDOW k AS (PARTITION BY r ORDER BY p)),
u AS (SELECT DISTINCT r, s FROM g WHERE whole),
f AS (SELECT r, md5(string_agg(s, '|' ORDER BY s)) AS f, count(*) AS n FROM u GROUP BY r),
d AS (SELECT doc_id, f.f, min(f.r) OVER (PARTITION BY f.f) AS rep FROM documents JOIN t USING (text) LEFT JOIN f USING (r)),
c AS (SELECT rep, count(*) AS size, min(doc_id) AS least_id FROM d WHERE f IS NOT NULL GROUP BY rep),
q AS (SELECT r, s, n FROM u JOIN f USING (r) WHERE r IN (SELECT rep FROM c)),
e AS (SELECT a.r AS a, b.r AS b FROM q a JOIN q b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
k AS (SELECT rep AS v, rep AS l FROM c UNION SELECT e.b, k.l FROM k JOIN e ON k.v = e.a),
h AS (SELECT v, min(least_id) AS class_id FROM k JOIN c ON k.l = c.rep GROUP BY v),
z AS (SELECT c.rep, size - 1 + coalesce((SELECT sum(c2.size) FROM e JOIN c c2 ON c2.rep = e.b WHERE e.a = c.rep), 0) AS n_links FROM c)
SELECT d.doc_id, coalesce(h.class_id, d.doc_id) AS class_id, CAST(coalesce(z.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN h ON d.rep = h.v AND d.f IS NOT NULL LEFT JOIN z ON d.rep = z.rep AND d.f IS NOT NULL
UNION ALL SELECT doc_id, doc_id, 0 FROM documents WHERE text IS NULL""",
    "op4_linededup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
bad AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.r, l.line, l.pos, trim(l.line, ' ') <> '' AND b.line IS NOT NULL AS gone FROM l LEFT JOIN bad b ON trim(l.line, ' ') = b.line),
k AS (SELECT r, count_if(gone) AS gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(CAST(k.gone AS BIGINT), 0) AS n_lines_removed, length(k.kept) AS n_kept_chars, md5(k.kept) AS kept_md5
FROM d LEFT JOIN k ON d.r = k.r""",
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_chat": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, count(*) AS n_copies, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text) AS i,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS FIRST, role DESC NULLS LAST, text DESC) = 1 AS last, coalesce(list_position(['system', 'user', 'assistant'], lower(trim(role))), 0) AS k
  FROM conversations GROUP BY conv_id, turn, role, text
), x AS (
  -- c: least cost with the message as system, user and assistant; p: the states up to there
  SELECT conv_id, CAST(0 AS BIGINT) AS i, [0, 1000000, 1000000, 1000000] AS c, [[0], [0], [0], [0]] AS p
  FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL
  SELECT conv_id, i, [1000000, least(1000000, list_min(t1) + f1), list_min(t2) + f2, list_min(t3) + f3],
    [[0], list_append(p[list_position(t1, list_min(t1))], 1), list_append(p[list_position(t2, list_min(t2))], 2), list_append(p[list_position(t3, list_min(t3))], 3)]
  FROM (
    SELECT x.conv_id, m.i, x.p, [c[1], c[2] + 1, 1000000, 1000000] AS t1, [c[1], c[2], c[3] + 1, c[4]] AS t2, [c[1] + 2, c[2] + 2, c[3], c[4] + 1] AS t3,
      CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 0 ELSE 3 END AS f1, CASE WHEN k = 0 THEN 1 WHEN k = 2 THEN 0 ELSE 3 END AS f2, CASE WHEN k = 0 THEN 1 WHEN k = 3 THEN 0 ELSE 3 END AS f3
    FROM x JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.i = x.i + 1)
), e AS (SELECT x.conv_id, [x.c[2] + 4, x.c[3] + 2, x.c[4]] AS c, x.p FROM x JOIN m ON m.conv_id IS NOT DISTINCT FROM x.conv_id AND m.i = x.i AND m.last),
b AS (SELECT conv_id, p[list_position(c, list_min(c)) + 1] AS p FROM e),
s AS (SELECT m.*, b.p[i] AS before, b.p[i + 1] AS after, ['system', 'user', 'assistant'][b.p[i + 1]] AS role_out FROM m JOIN b ON m.conv_id IS NOT DISTINCT FROM b.conv_id),
o AS (SELECT *, before = after AS joins, CASE WHEN after = 3 AND before < 2 THEN 1 ELSE 0 END AS filled, CASE WHEN NOT last THEN 0 WHEN after = 1 THEN 2 WHEN after = 2 THEN 1 ELSE 0 END AS closing,
  replace(coalesce(text, ''), '<|im_', '<| im_') AS body, '<|im_end|>' || chr(10) AS stop, '<|im_start|>user' || chr(10) AS asks, '<|im_start|>assistant' || chr(10) AS says FROM s)
SELECT conv_id, turn, role, role_out, CASE WHEN joins THEN CASE WHEN after = k THEN 'merge' ELSE 'merge_relabel' END WHEN after = k THEN 'keep' ELSE 'relabel' END AS action, CAST(filled + closing AS INTEGER) AS n_inserted, n_copies,
  CASE WHEN joins THEN chr(10) || chr(10) || body ELSE CASE WHEN before > 0 THEN stop ELSE '' END || CASE WHEN filled = 1 THEN asks || stop ELSE '' END || '<|im_start|>' || role_out || chr(10) || body END
  || CASE WHEN last THEN stop || CASE closing WHEN 2 THEN asks || stop || says || stop WHEN 1 THEN says || stop ELSE '' END ELSE '' END AS piece FROM o""",
    "op3_chosenpath": r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
x AS (SELECT r, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS x FROM t),
w AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS p FROM x),
g AS (SELECT r, concat_ws(' ', w, lead(w) OVER k, lead(w, 2) OVER k, lead(w, 3) OVER k, lead(w, 4) OVER k) AS s, lead(w, 4) OVER k IS NOT NULL OR p = 1 AS whole FROM w WINDOW k AS (PARTITION BY r ORDER BY p)),
u AS (SELECT DISTINCT r, s FROM g WHERE whole),
f AS (SELECT r, md5(string_agg(s, '|' ORDER BY s)) AS f, count(*) AS n FROM u GROUP BY r),
d AS (SELECT doc_id, f.f, min(f.r) OVER (PARTITION BY f.f) AS rep FROM documents JOIN t USING (text) LEFT JOIN f USING (r)),
c AS (SELECT rep, count(*) AS size, min(doc_id) AS least_id FROM d WHERE f IS NOT NULL GROUP BY rep),
q AS (SELECT r, s, n FROM u JOIN f USING (r) WHERE r IN (SELECT rep FROM c)),
e AS (SELECT a.r AS a, b.r AS b FROM q a JOIN q b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
k AS (SELECT rep AS v, rep AS l FROM c UNION SELECT e.b, k.l FROM k JOIN e ON k.v = e.a),
h AS (SELECT v, min(least_id) AS class_id FROM k JOIN c ON k.l = c.rep GROUP BY v),
z AS (SELECT c.rep, size - 1 + coalesce((SELECT sum(c2.size) FROM e JOIN c c2 ON c2.rep = e.b WHERE e.a = c.rep), 0) AS n_links FROM c)
SELECT d.doc_id, coalesce(h.class_id, d.doc_id) AS class_id, CAST(coalesce(z.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN h ON d.rep = h.v AND d.f IS NOT NULL LEFT JOIN z ON d.rep = z.rep AND d.f IS NOT NULL
UNION ALL SELECT doc_id, doc_id, 0 FROM documents WHERE text IS NULL""",
    "op4_linededup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
bad AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.r, l.line, l.pos, trim(l.line, ' ') <> '' AND b.line IS NOT NULL AS gone FROM l LEFT JOIN bad b ON trim(l.line, ' ') = b.line),
k AS (
  SELECT r, count_if(gone) AS gone, count_if(NOT gone AND trim(line, ' ') <> '') AS stay, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY r
)
SELECT d.doc_id, CASE WHEN k.gone > 0 AND k.stay > 0 THEN CAST(k.gone AS BIGINT) ELSE 0 END AS n_lines_removed,
  length(CASE WHEN k.gone > 0 AND k.stay > 0 THEN k.kept ELSE d.text END) AS n_kept_chars,
  md5(CASE WHEN k.gone > 0 AND k.stay > 0 THEN k.kept ELSE d.text END) AS kept_md5
FROM d LEFT JOIN k ON d.r = k.r""",
    "op10_decontaminate": r"""
WITH t AS (SELECT DISTINCT doc_id, NULL::BIGINT AS item_id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT NULL, item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
r AS (SELECT row_number() OVER () AS r, * FROM t),
x AS (SELECT r, item_id IS NOT NULL AS item, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS x FROM r),
w AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS p FROM x),
g AS (SELECT r, w AS s1, w || ' ' || lead(w) OVER k AS s2, s2 || ' ' || lead(w, 2) OVER k AS s3, s3 || ' ' || lead(w, 3) OVER k AS s4, s4 || ' ' || lead(w, 4) OVER k AS s5 FROM w WINDOW k AS (PARTITION BY r ORDER BY p)),
q AS (SELECT r, len(x) AS k, array_to_string(x, ' ') AS s FROM x WHERE item AND len(x) BETWEEN 1 AND 4),
u AS (SELECT r, 5 AS k, s5 AS s FROM g WHERE s5 IS NOT NULL
  UNION SELECT r, k, s FROM (SELECT r, c.k, CASE c.k WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END AS s FROM g, (SELECT DISTINCT k FROM q) c) WHERE s IS NOT NULL AND r NOT IN (SELECT r FROM x WHERE item)),
i AS (SELECT u.r, k, s FROM u JOIN x USING (r) WHERE item UNION SELECT r, k, s FROM q),
n AS (SELECT r, count(*) AS n_item FROM i GROUP BY r),
f AS (SELECT u.r AS d, i.r AS i, count(*) AS n_found FROM u JOIN x ON u.r = x.r AND NOT item JOIN i ON u.k = i.k AND u.s = i.s GROUP BY ALL),
b AS (SELECT d, item_id, max(struct_pack(containment := n_found / n_item, n_item := n_item, n_found := n_found)) AS best FROM f JOIN n ON n.r = f.i JOIN r ON r.r = f.i WHERE n_found >= 0.8 * n_item GROUP BY d, item_id)
SELECT r.doc_id, b.item_id, best.n_item, best.n_found, best.containment FROM b JOIN r ON r.r = b.d""",
}
