"""The language model as queries; its SQL counts, weighs and calibrates in the same way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import language as L
from tidewell.sources import tables as T
from tidewell.sources.tables import DOCS, TOKEN

from .registry import query


def _texts(spark, sf):
    """Title and content of the documents with their language; a fifth is held out, a fifth calibrates."""
    return T.documents(spark, sf).select("doc_id", F.concat_ws("\n", "title", "content").alias("text"), "language", F.pmod("doc_id", F.lit(5)).alias("fold"))


def _detected(spark, sf):
    rows = _texts(spark, sf)
    model = L.fit(rows.where("fold > 1"), rows.where("fold = 1"))
    return model.detect(rows.withColumnRenamed("language", "labelled"))


_Z = "(m * sqrt(n) * {k})"
_SQL = f"""WITH {DOCS}, tw AS MATERIALIZED (SELECT doc_id, language, doc_id % 5 AS fold, w, count(*) AS n FROM (SELECT doc_id, language, unnest(regexp_extract_all(lower(title || chr(10) || content), '{TOKEN}')) AS w FROM docs) GROUP BY ALL),
wl AS (SELECT language, w, sum(n) AS n FROM tw WHERE fold > 1 AND language IS NOT NULL GROUP BY language, w), dw AS MATERIALIZED (SELECT w, unnest(list_transform(range(1, len(w) + 1), lambda i: substr('_' || w || '_', i, 3))) AS gram FROM (SELECT DISTINCT w FROM tw)),
gl AS MATERIALIZED (SELECT language, gram, sum(n) AS n FROM wl JOIN dw USING (w) GROUP BY language, gram), vo AS MATERIALIZED (SELECT gram FROM gl GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {L.VOCABULARY}),
ct AS (SELECT vo.gram, g.language, coalesce(gl.n, 0) AS n FROM vo CROSS JOIN (SELECT DISTINCT language FROM gl) g LEFT JOIN gl ON gl.gram = vo.gram AND gl.language = g.language),
lp AS MATERIALIZED (SELECT gram, language, ln((n + 1) / (sum(n) OVER (PARTITION BY language) + (SELECT count(*) FROM vo))) AS p FROM ct),
ws AS MATERIALIZED (SELECT w, lp.language, sum(p) AS s, count(*) AS k FROM dw JOIN lp USING (gram) GROUP BY w, lp.language),
ds AS MATERIALIZED (SELECT doc_id, fold, tw.language AS labelled, ws.language AS guess, sum(n * s) / sum(n * k) AS m, sum(n * k) AS n FROM tw JOIN ws USING (w) GROUP BY doc_id, fold, tw.language, ws.language),
ks AS (SELECT unnest({[float(k) for k in L.SHARPNESS]}) AS k),
ls AS (SELECT k, round(avg(-ln(greatest(c, 1e-12))), 9) AS loss FROM (SELECT k, labelled, guess, exp({_Z.format(k='k')} - max({_Z.format(k='k')}) OVER w) / sum(exp({_Z.format(k='k')} - t)) OVER w AS c FROM (SELECT *, max({_Z.format(k='k')}) OVER (PARTITION BY k, doc_id) AS t FROM ds, ks WHERE fold = 1) WINDOW w AS (PARTITION BY k, doc_id)) WHERE labelled = guess GROUP BY k),
sh AS (SELECT k FROM ls ORDER BY loss, k LIMIT 1),
pr AS (SELECT doc_id, guess, exp(z - t) / sum(exp(z - t)) OVER (PARTITION BY doc_id) AS c FROM (SELECT doc_id, guess, {_Z.format(k='k')} AS z, max({_Z.format(k='k')}) OVER (PARTITION BY doc_id) AS t FROM ds, sh)),
be AS (SELECT doc_id, guess, c FROM pr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, guess) = 1),
dt AS (SELECT docs.doc_id, docs.language AS labelled, docs.doc_id % 5 AS fold, CASE WHEN c >= {L.CONFIDENCE} THEN guess ELSE '{L.DEFAULT}' END AS language, coalesce(round(c, 6), 0) AS confidence FROM docs LEFT JOIN be USING (doc_id))"""


@query(f"{_SQL} SELECT doc_id, language, confidence FROM dt")
def language_model(spark, sf):
    """Language and confidence of every document, whole texts."""
    return _detected(spark, sf).select("doc_id", "language", "confidence")


@query(f"{_SQL} SELECT count(*) AS texts, round(avg(CASE WHEN labelled = language THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(confidence), 4) AS confidence FROM dt WHERE fold = 0")
def language_model_accuracy(spark, sf):
    """Held-out documents: how many, and how often the language is right beside how sure the model is."""
    right = F.when(F.col("labelled") == F.col("language"), 1.0).otherwise(0.0)
    return _detected(spark, sf).where("fold = 0").agg(F.count("*").alias("texts"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))
