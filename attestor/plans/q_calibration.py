"""Queries of thresholds and stable labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import calibration as K
from attestor.plans.registry import query
from attestor.plans.tables import Tables


@query("threshold_calibration", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
p AS (SELECT floor(list_inner_product(q.v, b.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(b.v, b.v))) * 10000 + 0.5) / 10000 AS t, q.label = b.label AS same FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
s AS (SELECT t, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS q FROM p GROUP BY t), r AS (SELECT *, coalesce(sum(p) OVER w, 0) AS pb, coalesce(sum(q) OVER w, 0) AS qb, sum(p) OVER () AS ps, sum(q) OVER () AS qs FROM s WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT sum(p * (qb + q / 2.0)) / (max(ps) * max(qs)) AS auc FROM r) SELECT t::DOUBLE AS threshold, (ps + qs - pb - qb)::BIGINT AS n, round(((ps - pb) / (ps + qs - pb - qb))::DOUBLE, 6) AS precision, round(((ps - pb) / ps)::DOUBLE, 6) AS recall, round(auc::DOUBLE, 6) AS auc FROM r, a""")
def _(t: Tables):
    whole = t.embeddings.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")))  # so that both engines have the same products
    scores = K.pair_scores(whole.where("vec_id % 100 = 0"), whole, "vec_id", "embedding", "label")
    curve = K.threshold_curve(scores, n=F.col("n"))
    return curve.select("threshold", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "auc")])


@query("label_alignment", """WITH RECURSIVE c AS (SELECT article_id % 6 AS new, (article_id + outlet_no) % 5 AS old, count(*) AS n FROM v_articles GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, new, old) AS i FROM c),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS news, []::BIGINT[] AS olds, []::STRUCT(new BIGINT, old BIGINT, n BIGINT)[] AS got UNION ALL
 SELECT r.i, CASE WHEN ok THEN list_append(news, new) ELSE news END, CASE WHEN ok THEN list_append(olds, old) ELSE olds END, CASE WHEN ok THEN list_append(got, {'new': new, 'old': old, 'n': n}) ELSE got END
 FROM (SELECT r.i, r.new::BIGINT AS new, r.old::BIGINT AS old, r.n, g.news, g.olds, g.got, NOT list_contains(news, r.new::BIGINT) AND NOT list_contains(olds, r.old::BIGINT) AS ok FROM g JOIN r ON r.i = g.i + 1) r),
t AS (SELECT unnest(got, recursive := true) FROM (SELECT got FROM g ORDER BY i DESC LIMIT 1)), l AS (SELECT new, row_number() OVER (ORDER BY new) AS place FROM (SELECT DISTINCT new FROM c) WHERE new NOT IN (SELECT new FROM t)),
f AS (SELECT old, row_number() OVER (ORDER BY old) AS place FROM (SELECT unnest(range(0, 12)) AS old) WHERE old NOT IN (SELECT old FROM t)) SELECT new, old, n FROM t UNION ALL SELECT new, old, 0 FROM l JOIN f USING (place)""")
def _(t: Tables):
    new = t.v_articles.select("article_id", (F.col("article_id") % 6).alias("cluster"))
    old = t.v_articles.select("article_id", ((F.col("article_id") + F.col("outlet_no")) % 5).cast("long").alias("cluster"))
    return K.align_labels(new, old, "article_id")
