"""Learned ranking as queries. Its SQL grows the same trees: each level of each tree is a few common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import learned as L
from tidewell.operators import search as S
from tidewell.sources import tables as T
from tidewell.sources.scratch import stored

from .registry import query
from .search_queries import _CHAIN, channels


def _rows(spark, sf):
    """Candidates with features and, where the document is labelled, its quality as the grade. Every second request, by
    its number, is held out of training."""
    docs, _, lex, vec = channels(spark, sf)
    labels = T.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("grade"))
    rows = L.features(lex, vec, S.rrf(lex, vec), docs).join(labels, "doc_id", "left")
    return stored(rows.withColumn("held_out", F.floor(F.col("query_id") / 100) % 2 == 1))


def _ranked(spark, sf):
    rows = _rows(spark, sf)
    return rows, L.rerank(rows.where("held_out"), L.train(rows.where("not held_out")))


def _sql() -> str:
    unit, n = float(1 << L.UNIT_BITS), len(L.FEATURES)
    near = lambda x, d: f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"
    values = ", ".join(near(f"CAST({f} AS DOUBLE)", L.DIGITS) for f in L.FEATURES)
    words = r"list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')"
    parts = [
        f"""ff AS MATERIALIZED (SELECT r.query_id, r.doc_id, r.score AS fused_score, coalesce(l.score, 0) AS lexical_score, coalesce(l.rank, 0) AS lexical_rank, coalesce(v.score, 0) AS vector_score, coalesce(v.rank, 0) AS vector_rank, len(content) AS length,
  len({words}) AS words, CASE WHEN len({words}) > 0 THEN CAST(len(list_distinct({words})) AS DOUBLE) / len({words}) ELSE 0 END AS distinct_share, len(tags) AS n_tags, grade, r.query_id // 100 % 2 = 0 AS train
  FROM rrf r LEFT JOIN lex l USING (query_id, doc_id) LEFT JOIN vec v USING (query_id, doc_id) JOIN docs USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(max(quality) AS DOUBLE) AS grade FROM labels GROUP BY doc_id) USING (doc_id) WHERE r.rank <= 200)""",
        f"fv AS MATERIALIZED (SELECT query_id, doc_id, fused_score, grade, train, [{values}] AS x FROM ff)",
        f"fl AS (SELECT unnest(range({n})) AS f, unnest(x) AS v FROM fv WHERE train AND grade IS NOT NULL)",
        f"cu AS MATERIALIZED (SELECT f, list_sort(list(DISTINCT v)) AS cuts FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r, count(*) OVER (PARTITION BY f) AS n FROM fl) JOIN (SELECT unnest(range(1, {L.BINS})) AS k) ON r = ceil(k * n / {float(L.BINS)}) GROUP BY f)",
        f"""rw0 AS MATERIALIZED (SELECT query_id, doc_id, fused_score, grade, train AND grade IS NOT NULL AS train, train AS seen, 0.0::DOUBLE AS s, list(len(list_filter(cuts, lambda c: c < v)) ORDER BY f) AS b
  FROM (SELECT query_id, doc_id, fused_score, grade, train, unnest(range({n})) AS f, unnest(x) AS v FROM fv) JOIN cu USING (f) GROUP BY query_id, doc_id, fused_score, grade, train)""",
    ]
    value = lambda g, h: f"(({g} / {unit}) * ({g} / {unit}) / ({h} / {unit} + {L.RIDGE}))"
    for t in range(L.TREES):
        parts += [
            f"""pl{t} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) - 1 AS place, pow(2, grade) - 1 AS gain, sum((pow(2, grade) - 1) / log2(best + 1)) OVER (PARTITION BY query_id) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS best FROM rw{t} WHERE train))""",
            f"""pr{t} AS MATERIALIZED (SELECT query_id, a, z, w * c AS p, w * c * (1 - c) AS q FROM (SELECT i.query_id, i.doc_id AS a, j.doc_id AS z, abs(i.gain - j.gain) * abs(1 / log2(i.place + 2) - 1 / log2(j.place + 2)) / i.ideal AS w, 1 / (1 + exp(i.s - j.s)) AS c
  FROM pl{t} i JOIN pl{t} j ON i.query_id = j.query_id AND i.grade > j.grade WHERE i.ideal > 0))""",
            f"gr{t} AS MATERIALIZED (SELECT query_id, doc_id, CAST(floor(sum(p) * {unit} + 0.5) AS BIGINT) AS g, CAST(floor(sum(q) * {unit} + 0.5) AS BIGINT) AS h FROM (SELECT query_id, a AS doc_id, p, q FROM pr{t} UNION ALL SELECT query_id, z, -p, q FROM pr{t}) GROUP BY query_id, doc_id)",
            f"nd{t}_0 AS MATERIALIZED (SELECT r.*, CASE WHEN train THEN coalesce(g, 0) END AS g, CASE WHEN train THEN coalesce(h, 0) END AS h, '' AS path, true AS more FROM rw{t} r LEFT JOIN gr{t} USING (query_id, doc_id))",
        ]
        for k in range(L.DEPTH):
            w = "(PARTITION BY path, f ORDER BY bin)"
            parts += [
                f"ce{t}_{k} AS (SELECT path, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT path, g, h, unnest(range({n})) AS f, unnest(b) AS bin FROM nd{t}_{k} WHERE train AND more) GROUP BY path, f, bin)",
                f"cs{t}_{k} AS (SELECT path, f, bin, CAST(sum(g) OVER {w} AS DOUBLE) AS g, CAST(sum(h) OVER {w} AS DOUBLE) AS h, sum(n) OVER {w} AS n, CAST(sum(g) OVER (PARTITION BY path, f) AS DOUBLE) AS tg, CAST(sum(h) OVER (PARTITION BY path, f) AS DOUBLE) AS th, sum(n) OVER (PARTITION BY path, f) AS tn FROM ce{t}_{k})",
                f"""sp{t}_{k} AS MATERIALIZED (SELECT path, f, bin FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY won DESC, f, bin) AS r FROM (SELECT path, f, bin, {near(f"{value('g', 'h')} + {value('(tg - g)', '(th - h)')} - {value('tg', 'th')}", 9)} AS won
  FROM cs{t}_{k} WHERE n >= {L.LEAST} AND tn - n >= {L.LEAST}) WHERE won > 1e-9) WHERE r = 1)""",
                f"nd{t}_{k + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (path, more), CASE WHEN sp.f IS NULL THEN x.path ELSE x.path || CASE WHEN x.b[CAST(sp.f AS INT) + 1] <= sp.bin THEN '0' ELSE '1' END END AS path, sp.f IS NOT NULL AS more FROM nd{t}_{k} x LEFT JOIN sp{t}_{k} sp ON sp.path = x.path AND x.more)",
            ]
        parts.append(f"lv{t} AS (SELECT path, {near(f'{L.RATE} * (CAST(sum(g) AS DOUBLE) / {unit}) / (CAST(sum(h) AS DOUBLE) / {unit} + {L.RIDGE})', 6)} AS add FROM nd{t}_{L.DEPTH} WHERE train GROUP BY path)")
        parts.append(f"rw{t + 1} AS MATERIALIZED (SELECT query_id, doc_id, fused_score, grade, train, seen, s + coalesce(add, 0) AS s, b FROM nd{t}_{L.DEPTH} LEFT JOIN lv{t} USING (path))")
    parts.append(f"lr AS MATERIALIZED (SELECT query_id, doc_id, {near('s', 6)} AS score, fused_score, grade FROM rw{L.TREES} WHERE NOT seen)")
    parts.append("lk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_score DESC, doc_id) AS rank FROM lr)")
    return f"WITH {_CHAIN}, {', '.join(parts)}"


_LEARNED = _sql()


def _ndcg(strategy: str, order: str) -> str:
    return f"""SELECT '{strategy}' AS strategy, round(avg(ndcg), 5) AS ndcg, count(*) AS queries FROM (SELECT query_id, round(coalesce(sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (WHERE place <= 10), 0) / sum((pow(2, grade) - 1) / log2(best + 1)) FILTER (WHERE best <= 10), 6) AS ndcg
  FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS place, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS best FROM lr WHERE grade IS NOT NULL) GROUP BY query_id HAVING sum(grade) > 0)"""


@query(f"{_LEARNED} SELECT * FROM lk")
def learned_rank(spark, sf):
    """Held-out requests in the order of a ranker fitted on the others."""
    return _ranked(spark, sf)[1]


@query(f"{_LEARNED} {_ndcg('learned', 'score DESC, fused_score DESC, doc_id')} UNION ALL {_ndcg('rrf', 'fused_score DESC, doc_id')}")
def learned_rank_eval(spark, sf):
    """Mean nDCG of held-out requests over their judged hits: the learned order, and the fused one."""
    rows, learned = _ranked(spark, sf)
    judged = rows.where("held_out and grade is not null")
    fused = S.ranked(rows.where("held_out").select("query_id", "doc_id", F.col("fused_score").alias("score")), S.MOST_K, F.desc("score"), F.col("doc_id"))
    score = lambda name, hits: L.ndcg(hits, judged).agg(F.lit(name).alias("strategy"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.count("*").alias("queries"))
    return score("learned", learned).unionByName(score("rrf", fused))
