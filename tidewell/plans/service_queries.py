"""Models, caches, the reconciler, evaluation runs and migrations as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.operators import evaluation, extras
from tidewell.operators import indexing as I
from tidewell.operators import search as S
from tidewell.operators import service as P
from tidewell.sources import tables as T
from tidewell.sources.scratch import folder
from tidewell.sources.tables import DOCS, EVENTS, OUTBOX, POINTS, REQUESTS, TOKEN
from tidewell.streaming import jobs

from .index_queries import _HASH, _JUDGED, _SCORES, NOW, judged_hits, judged_totals
from .registry import query
from .search_queries import _CAND, _CHAIN, _DOC_VECTORS, _EVERY, _WEIGHTED, _overlap, channels, every_vectors, models

MODELS = "md AS (SELECT model_name, row_number() OVER (ORDER BY count(*) DESC, model_name) = 1 AS is_default FROM points GROUP BY model_name)"


@query(f"WITH {POINTS}, {MODELS} SELECT model_name FROM md WHERE is_default")
def default_model(spark, sf):
    return P.default_model(models(spark, sf))


@query(f"""WITH {DOCS}, {POINTS}, {REQUESTS}, {MODELS}, vs AS (SELECT query_id, doc_id, round((max(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(query_vector AS DOUBLE[]))) + 1) / 2, 6) AS score
  FROM points JOIN md USING (model_name), rq WHERE is_default AND query_vector IS NOT NULL AND doc_id IN (SELECT doc_id FROM docs WHERE deleted_at IS NULL) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= 50""")
def cosine_active_model(spark, sf):
    return S.vector_search(T.points(spark, sf), T.requests(spark, sf), T.documents(spark, sf), models=models(spark, sf))


@query(f"WITH {DOCS}, {REQUESTS} SELECT query_id, docs.tenant_id, deleted_at IS NOT NULL AS deleted FROM rq JOIN docs ON docs.doc_id = rq.query_id")
def lookup_with_deleted(spark, sf):
    keys = T.requests(spark, sf).select("query_id", F.col("query_id").alias("doc_id"))
    return T.documents(spark, sf).join(S.small(keys), "doc_id").select("query_id", "tenant_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"WITH {DOCS}, {POINTS} SELECT point_id, doc_id, chunk_idx, model_name, tenant_id, language, array_to_string(tags, ',') AS tags, {_HASH} AS content_hash FROM points JOIN docs USING (doc_id) WHERE deleted_at IS NULL AND len(vector) = 64")
def point_payload(spark, sf):
    return P.point_payload(T.points(spark, sf), T.documents(spark, sf))


@query(f"WITH {DOCS}, {POINTS} SELECT point_id, {_HASH} AS content_hash FROM points JOIN docs USING (doc_id) WHERE deleted_at IS NULL AND len(vector) = 64 AND chunk_idx = 0")
def payload_field(spark, sf):
    """One field of the payload, for the fast path."""
    return P.point_payload(T.points(spark, sf), T.documents(spark, sf)).where("chunk_idx = 0").select("point_id", "content_hash")


@query(f"WITH {REQUESTS}, n AS (SELECT query_id, lower(nfc_normalize(query)) AS q FROM rq) SELECT query_id, 'qemb:m0:' || sha256(q) AS query_key, 'neg:m0:' || sha256(q) AS negative_key, len(q) > 12 AS too_long FROM n")
def query_keys(spark, sf):
    n = T.requests(spark, sf).select("query_id", P.normalized_query(F.col("query")).alias("q"))
    return n.select("query_id", P.query_key(F.col("q"), F.lit("m0")).alias("query_key"), P.query_key(F.col("q"), F.lit("m0"), "neg").alias("negative_key"), P.too_long(F.col("q"), 6).alias("too_long"))


@query(f"WITH {POINTS} SELECT point_id, len(vector) * 4 AS n_bytes, true AS same FROM points")
def vector_bytes(spark, sf):
    back = T.points(spark, sf).select("point_id", "vector", P.to_bytes("vector").alias("data"))
    return back.select("point_id", F.octet_length("data").cast("long").alias("n_bytes"), (P.from_bytes("data") == F.col("vector")).alias("same"))


_EMB = f"list_transform(range(16), lambda i: CAST(len(list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda t: substr(md5(t), 1, 1) = substr('0123456789abcdef', i + 1, 1))) AS DOUBLE))"
_UNIT = "list_transform({v}, lambda x: round(CASE WHEN list_inner_product({v}, {v}) > 0 THEN x / sqrt(list_inner_product({v}, {v})) ELSE x END, 6))"


@query(f"WITH {DOCS}, e AS (SELECT doc_id, {_EMB.replace('lower(text)', 'lower(content)')} AS v FROM docs) SELECT doc_id, {_UNIT.format(v='v')} AS vector FROM e")
def embed_texts(spark, sf):
    rows = P.embed_texts(T.documents(spark, sf).select("doc_id", F.col("content").alias("text")))
    return rows.select("doc_id", vectors.rounded(F.col("vector")).alias("vector"))


_CACHED = f"""k AS (SELECT 'hash:' || {_HASH} || ':m0' AS key, min(content) AS text, bool_or(language = 'fr' AND created_at > TIMESTAMP '{NOW}') AS held, bool_or(language = 'de') AS barred FROM docs GROUP BY 1), e AS (SELECT *, {_EMB} AS v FROM k),
o AS (SELECT key, CASE WHEN held THEN 'hit' WHEN barred THEN 'negative' WHEN list_sum(v) = 0 THEN 'failed' ELSE 'computed' END AS outcome FROM e)"""


def _cached(spark, sf):
    key = P.content_key(I.content_hash(F.col("title"), F.col("content")), F.lit("m0"))
    keyed = T.documents(spark, sf).withColumn("key", key).withColumn("text", F.col("content"))
    cache = keyed.where("language = 'fr'").groupBy("key").agg(F.max("created_at").alias("expires_at")).withColumn("vector", F.array(F.lit(1.0)))
    failed = keyed.where("language = 'de'").select("key", F.lit("2099-01-01 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    return P.embed_cached(keyed, cache, failed, NOW)


@query(f"WITH {DOCS}, {_CACHED} SELECT key, outcome FROM o")
def cached_embeddings(spark, sf):
    return _cached(spark, sf).select("key", "outcome")


@query(f"""WITH {DOCS}, {_CACHED} SELECT key, outcome, TIMESTAMP '{NOW}' + to_seconds(CASE WHEN outcome = 'computed' THEN 2592000 ELSE 60 + CAST('0x' || substr(md5(key), 1, 4) AS INT) % 21 - 10 END) AS expires_at FROM o WHERE outcome IN ('computed', 'failed')""")
def cache_expiry(spark, sf):
    kept, failed = P.cache_rows(_cached(spark, sf), NOW)
    return kept.select("key", F.lit("computed").alias("outcome"), "expires_at").unionByName(failed.select("key", F.lit("failed").alias("outcome"), "expires_at"))


@query(f"WITH {REQUESTS}, k AS (SELECT query, any_value(query_id % 3) AS r FROM (SELECT query, min(query_id) AS query_id FROM rq GROUP BY query) GROUP BY query) SELECT query_id, CASE WHEN len(query) > 12 THEN 'too_long' WHEN r = 0 THEN 'hit' WHEN r = 1 THEN 'negative' WHEN query = '' THEN 'failed' ELSE 'computed' END AS outcome FROM rq JOIN k USING (query)")
def embed_queries(spark, sf):
    asked = T.requests(spark, sf)
    known = asked.groupBy("query").agg(F.min("query_id").alias("query_id")).withColumn("key", P.query_key(F.col("query"), F.lit("m0"))).withColumn("expires_at", F.lit("2099-01-01 00:00:00").cast("timestamp_ntz"))
    cache = known.where("query_id % 3 = 0").select("key", F.array(F.lit(1.0)).alias("vector"), "expires_at")
    return P.embed_queries(asked, cache, known.where("query_id % 3 = 1").select("key", "expires_at"), "m0", NOW, most=6).select("query_id", "outcome")


@query(f"""WITH {OUTBOX}, {POINTS}, {MODELS} SELECT id, CASE WHEN md.model_name IS NULL THEN 'unknown_model' WHEN document_id IN (SELECT doc_id FROM points) THEN 'cache' ELSE 'embed' END AS source FROM ob LEFT JOIN (SELECT * FROM md WHERE is_default) md USING (model_name) WHERE op = 'upsert'""")
def document_vectors(spark, sf):
    return P.document_vectors(T.outbox(spark, sf), models(spark, sf), T.points(spark, sf))


_N = r"len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> ''))"


@query(f"""WITH {DOCS}, a AS (SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS same, CAST(CASE WHEN {_N} >= 512 THEN ceil({_N} / 462) ELSE 1 END AS BIGINT) AS n FROM docs)
SELECT doc_id, CASE WHEN same THEN 'skip' ELSE 'index' END AS action, CASE WHEN NOT same THEN n END AS n_chunks, unnest(CASE WHEN same THEN [NULL] ELSE ['docs', 'docs_new'] END) AS collection FROM a""")
def reconcile_plan(spark, sf):
    """Against stored hashes of which a third are of another text and a seventh are missing."""
    docs = T.documents(spark, sf)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" before"))).otherwise(F.col("content"))
    stored = docs.where("doc_id % 7 <> 0").select("doc_id", I.content_hash(F.col("title"), text).alias("content_hash"))
    return P.reconcile(docs, stored, ["docs", "docs_new"])


@query(f"WITH {REQUESTS}, {OUTBOX} SELECT query_id, query_id IN (SELECT document_id FROM ob WHERE status = 'pending') AS found FROM rq")
def pending_exists(spark, sf):
    asked = T.requests(spark, sf).select("query_id", F.col("query_id").alias("document_id"))
    return P.has_rows(asked, T.outbox(spark, sf).where("status = 'pending'"), "document_id").select("query_id", "found")


@query(f"WITH {DOCS}, a AS (SELECT tenant_id, count(*) AS n FROM docs WHERE deleted_at IS NULL AND doc_id % 2 = 0 GROUP BY 1), b AS (SELECT tenant_id, count(*) AS n FROM docs WHERE deleted_at IS NULL AND language = 'fr' GROUP BY 1) SELECT tenant_id, coalesce(b.n, a.n) AS doc_count FROM a FULL JOIN b USING (tenant_id)")
def doc_count_upsert(spark, sf):
    docs = T.documents(spark, sf)
    return P.merge_doc_counts(I.doc_counts(docs.where("doc_id % 2 = 0")), I.doc_counts(docs.where("language = 'fr'")))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def table_cardinality(spark, sf):
    return P.cardinalities({name: T.read(spark, sf, name) for name in ("documents", "events", "embeddings")})


@query(f"WITH {DOCS}, c AS (SELECT language, count(*) AS n FROM docs WHERE price < 2000 GROUP BY language) SELECT language, least(n, 101) AS n, n > 100 AS too_large FROM c WHERE language IN ('de', 'en', 'es', 'fr')")
def pushdown_probe(spark, sf):
    """Matching documents for each of four languages, counted up to one more than the bound of 100, which is the feature."""
    matching = {language: S.matching(T.documents(spark, sf), languages=(language,)).where(F.try_variant_get(F.try_parse_json("attributes"), "$.price", "double") < 2000) for language in ("de", "en", "es", "fr")}
    counted = P.cardinalities(matching, 101).where("n > 0")
    return counted.select(F.col("name").alias("language"), "n", (F.col("n") > 100).alias("too_large"))


@query(f"WITH {REQUESTS} SELECT query_id, CAST(greatest(k, trunc(5000 * k / 50)) AS BIGINT) AS cap FROM (SELECT query_id, 10 + query_id // 100 % 190 AS k FROM rq)")
def pushdown_cap(spark, sf):
    """How many ids may be handed on grows with the lexical k."""
    k = F.lit(10) + F.floor(F.col("query_id") / 100) % 190
    return T.requests(spark, sf).select("query_id", F.greatest(k, F.floor(5000 * k / 50)).cast("long").alias("cap"))


_MODE = "query_id // 100 % 2 = 0 AS rerank, query_id // 100 % 3 > 0 AS available, query_id // 100 % 5 = 4 AS breaker_open, query_id // 100 % 7 > 2 AS speculative, query_id // 100 % 4 = 1 AS late"


@query(f"WITH {REQUESTS}, f AS (SELECT query_id, {_MODE} FROM rq) SELECT query_id, CASE WHEN NOT rerank OR NOT available OR breaker_open THEN 'none' WHEN speculative THEN 'speculative' ELSE 'plain' END AS rerank_mode, rerank AND (NOT available OR breaker_open) AS rerank_degraded, late AS partial FROM f")
def rerank_dispatch(spark, sf):
    n = F.floor(F.col("query_id") / 100)
    flags = {"rerank": n % 2 == 0, "available": n % 3 > 0, "breaker_open": n % 5 == 4, "speculative": n % 7 > 2, "late": n % 4 == 1}
    return S.rerank_modes(T.requests(spark, sf).select("query_id", *[c.alias(k) for k, c in flags.items()]))


@query(f"""WITH {_CHAIN}, {_CAND}, ov AS ({_overlap('cand')}), r AS (SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM ov) SELECT * FROM r WHERE rank <= 10""")
def rerank_topk(spark, sf):
    docs, requests, lex, vec = channels(spark, sf)
    return S.rerank(S.rerank_candidates(lex, vec), requests, docs, S.token_overlap, 10).select("query_id", "doc_id", "rerank_score", "rank")


def _means(strategy: str, hits: str) -> str:
    return f"""SELECT '{strategy}' AS strategy, round(avg(recall), 5) AS recall, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr, count(*) AS queries FROM (
  SELECT query_id, round(coalesce(found / total, 0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, CAST(least(total, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr
  FROM tot LEFT JOIN (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM {hits} SEMI JOIN judged USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id) USING (query_id))"""


@query(f"""WITH {_EVERY}, {_CAND}, {_WEIGHTED}, {_JUDGED}, tot AS (SELECT query_id, count(*) AS total FROM judged GROUP BY query_id), ov AS ({_overlap('cand')}),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM wf), wm AS (SELECT wr.query_id, wr.doc_id, row_number() OVER (PARTITION BY wr.query_id ORDER BY rerank_score IS NULL, rerank_score DESC, wr.score DESC, wr.doc_id) AS rank FROM wr LEFT JOIN ov USING (query_id, doc_id))
{_means('rrf', 'rrf')} UNION ALL {_means('weighted', 'wr')} UNION ALL {_means('weighted+rerank', 'wm')}""")
def nightly_eval(spark, sf):
    """Three strategies in one job: means for each."""
    docs, requests, lex, vec = channels(spark, sf, every_vectors)
    truth, totals, mixed = judged_hits(spark, sf, lex, vec), judged_totals(spark, sf), S.weighted(lex, vec)
    reranked = S.apply_rerank(mixed, S.overlap_scores(S.rerank_candidates(lex, vec), requests, docs), 50)
    every = None
    for name, hits in (("rrf", S.rrf(lex, vec)), ("weighted", mixed), ("weighted+rerank", reranked)):
        one = evaluation.relevance(hits, truth, totals=totals).withColumn("strategy", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return evaluation.summary(every, "strategy")


# ---- evaluation runs: a run a day and strategy, scored by what the log of that day gives
RUNS = f"runs AS (SELECT 'd' || (user_id % 2) AS dataset, 's' || (user_id % 3) AS strategy, strftime(created_at, '%Y-%m-%d') AS run_at, round(avg(k % 10) / 10, 4) AS recall, round(avg(k % 7) / 10, 4) AS ndcg FROM ev GROUP BY ALL)"


def runs(spark, sf):
    key = lambda c, n: F.concat(F.lit(c), F.col("user_id") % n)
    grouped = T.events(spark, sf).groupBy(key("d", 2).alias("dataset"), key("s", 3).alias("strategy"), F.date_format("created_at", "yyyy-MM-dd").alias("run_at"))
    return grouped.agg(F.round(F.avg(F.col("k") % 10) / 10, 4).alias("recall"), F.round(F.avg(F.col("k") % 7) / 10, 4).alias("ndcg"))


@query(f"WITH {EVENTS}, {RUNS}, w AS (SELECT *, lag(recall) OVER w AS r, lag(ndcg) OVER w AS n FROM runs WINDOW w AS (PARTITION BY dataset, strategy ORDER BY run_at)) SELECT dataset, strategy, run_at, recall, ndcg, coalesce(round(r - recall, 9) > 0.02 OR round(n - ndcg, 9) > 0.01, false) AS release_blocked FROM w")
def regression_gate(spark, sf):
    return evaluation.gate(runs(spark, sf)).select("dataset", "strategy", "run_at", "recall", "ndcg", "release_blocked")


@query(f"WITH {EVENTS}, {RUNS} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, strategy ORDER BY run_at DESC) = 1")
def latest_runs(spark, sf):
    return P.latest_runs(runs(spark, sf)).select("dataset", "strategy", "run_at", "recall", "ndcg")


@query(f"WITH {EVENTS}, {RUNS} SELECT * FROM runs ORDER BY run_at DESC, dataset, strategy LIMIT 10")
def newest_runs(spark, sf):
    return P.newest_runs(runs(spark, sf)).select("dataset", "strategy", "run_at", "recall", "ndcg")


@query(f"WITH {EVENTS}, {RUNS} SELECT * FROM runs")
def saved_runs(spark, sf):
    """Runs appended to their table and read back."""
    path = folder(spark, "runs")
    made = runs(spark, sf)
    for which in ("d0", "d1"):
        made.where(F.col("dataset") == which).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("dataset", "strategy", "run_at", "recall", "ndcg")


@query(f"WITH {DOCS} SELECT DISTINCT tenant_id AS dataset, CASE WHEN doc_id_min % 2 = 0 THEN doc_id_min END AS first_doc FROM (SELECT tenant_id, min(doc_id) AS doc_id_min FROM docs GROUP BY tenant_id)")
def dataset_register(spark, sf):
    named = T.documents(spark, sf).groupBy(F.col("tenant_id").alias("dataset")).agg(F.min("doc_id").alias("first_doc"))
    return P.register(named.where("first_doc % 2 = 0"), T.documents(spark, sf).select(F.col("tenant_id").alias("dataset")))


@query(f"""WITH {REQUESTS}, j AS (SELECT query, unnest([query_id, query_id + 1, query_id // 200]) AS ref FROM rq), a AS (SELECT 'doc-' || ref AS ref, array_to_string(list_sort(list(DISTINCT query)), chr(10)) AS content, 'judged' AS category, 'normal' AS priority FROM j GROUP BY 1),
f AS (SELECT 'filler-' || i AS ref, 'filler text ' || i AS content, CASE WHEN i % 10 = 0 THEN 'ML' ELSE ['general', 'support', 'billing', 'internal'][i % 4 + 1] END AS category, CASE WHEN i % 5 = 0 THEN 'high' ELSE 'normal' END AS priority FROM range(200) t(i)) SELECT * FROM a UNION ALL SELECT * FROM f""")
def seed_corpus(spark, sf):
    ref = lambda c: F.concat(F.lit("doc-"), c)
    q = F.col("query_id")
    return P.seed_corpus(T.requests(spark, sf).select("query", F.array(ref(q), ref(q + 1), ref(F.floor(q / 200))).alias("relevant_doc_ids")), 200)


# ---- migrations: one for each queue row of a sort, with a history that its numbers give
_STATES = ("init", "canary_passed", "canary_failed", "backfilled", "promoted", "rolled_back", "cleaned")
MIGRATIONS = f"""mg AS (SELECT id AS migration_id, 'docs_' || tenant_id AS base, {list(_STATES)!r}[id % 7 + 1] AS status, 'docs_' || tenant_id || CASE WHEN id % 3 = 0 THEN '_new' ELSE '_v' || (2 + id % 3) END AS collection,
  CASE WHEN id % 2 = 0 THEN 'snap-' || id END AS snapshot_key, id % 101 AS backfilled, 100 AS total, updated_at AS made_at, CASE WHEN id % 7 >= 4 THEN updated_at END AS promoted_at, ['canary', 'promote', 'rollback', 'cleanup'][id % 4 + 1] AS step FROM ob WHERE status = 'dead' AND attempts >= 20)"""


def migrations(spark, sf):
    rows = T.outbox(spark, sf).where("status = 'dead' and attempts >= 20")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int"))
    base = F.concat(F.lit("docs_"), "tenant_id")
    return rows.select(
        F.col("id").alias("migration_id"), base.alias("base"), pick(_STATES, 7).alias("status"), F.concat(base, F.when(F.col("id") % 3 == 0, "_new").otherwise(F.concat(F.lit("_v"), 2 + F.col("id") % 3))).alias("collection"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("snap-"), "id")).alias("snapshot_key"), (F.col("id") % 101).alias("backfilled"), F.lit(100).alias("total"), F.col("updated_at").alias("made_at"),
        F.when(F.col("id") % 7 >= 4, F.col("updated_at")).alias("promoted_at"), pick(("canary", "promote", "rollback", "cleanup"), 4).alias("step"),
    )


@query(f"""WITH {OUTBOX}, {MIGRATIONS}, a AS (SELECT *, CASE step WHEN 'canary' THEN status IN ('init', 'canary_failed') WHEN 'promote' THEN status = 'backfilled' AND snapshot_key IS NOT NULL AND backfilled >= total ELSE status = 'promoted' END AS ok FROM mg)
SELECT migration_id, CASE WHEN ok THEN CASE step WHEN 'canary' THEN 'canary_passed' WHEN 'promote' THEN 'promoted' WHEN 'rollback' THEN 'rolled_back' ELSE 'cleaned' END ELSE status END AS status, ok AS accepted FROM a""")
def migration_steps(spark, sf):
    rows = migrations(spark, sf)
    return evaluation.advance(rows, F.col("step"))


@query(f"WITH {OUTBOX}, {MIGRATIONS} SELECT migration_id, status, CAST(backfilled AS DOUBLE) AS percent, status IN ('init', 'canary_passed', 'canary_failed', 'backfilled') AS running, snapshot_key IS NOT NULL AS snapshot FROM mg")
def migration_status(spark, sf):
    return P.migration_status(migrations(spark, sf))


@query(f"""WITH {OUTBOX}, {MIGRATIONS}, mm AS (SELECT * FROM mg WHERE base IN ('docs_t0', 'docs_t1') OR status NOT IN ('init', 'canary_passed', 'canary_failed', 'backfilled')), t AS (SELECT base, bool_or(status IN ('init', 'canary_passed', 'canary_failed', 'backfilled')) AS running, list(DISTINCT collection) AS taken FROM mm GROUP BY base),
n AS (SELECT base, running, list_filter(list_prepend(base || '_new', list_transform(range(2, len(taken) + 3), lambda k: base || '_v' || k)), lambda x: NOT list_contains(taken, x))[1] AS free FROM t) SELECT base, NOT running AS accepted, CASE WHEN NOT running THEN free END AS collection FROM n""")
def migration_begin(spark, sf):
    rows = migrations(spark, sf)
    return P.begin(rows.where(F.col("base").isin("docs_t0", "docs_t1") | ~F.col("status").isin(*P.UNFINISHED)))


@query(f"WITH {OUTBOX}, {MIGRATIONS} SELECT base, arg_max(collection, (promoted_at, migration_id)) AS collection, max(promoted_at) AS promoted_at FROM mg WHERE promoted_at IS NOT NULL GROUP BY base")
def latest_promoted(spark, sf):
    return P.latest_promoted(migrations(spark, sf))


@query(f"WITH {OUTBOX}, {MIGRATIONS}, l AS (SELECT base, arg_max(collection, (promoted_at, migration_id)) AS c FROM mg WHERE promoted_at IS NOT NULL GROUP BY base) SELECT doc_id, unnest([base, c]) AS collection FROM documents JOIN l ON base = 'docs_t' || (doc_id % 5)")
def dual_write_promoted(spark, sf):
    docs = T.documents(spark, sf).select("doc_id", F.concat(F.lit("docs_t"), F.col("doc_id") % 5).alias("base"))
    return P.dual_write(migrations(spark, sf), docs)


@query(f"WITH {OUTBOX}, {MIGRATIONS} SELECT snapshot_key, made_at, row_number() OVER (ORDER BY made_at DESC, snapshot_key) AS place FROM mg WHERE base = 'docs_t0' AND snapshot_key IS NOT NULL")
def snapshot_list(spark, sf):
    return P.snapshots(migrations(spark, sf), "docs_t0")


@query("SELECT * FROM (VALUES ('doc_id', 'string', 'bigint'), ('embedding', 'array<float>', NULL), ('lang', NULL, 'string'), ('n_chars', NULL, 'bigint'), ('source', NULL, 'string')) t(name, declared, found)")
def collection_drift(spark, sf):
    return P.drift_rows(T.read(spark, sf, "documents").selectExpr("cast(doc_id as long) doc_id", "text", "lang", "source", "cast(n_chars as long) n_chars"), {"doc_id": "string", "text": "string", "embedding": "array<float>"})


@query(f"WITH {EVENTS}, p AS (SELECT tenant_id, count(*) AS n FROM ev GROUP BY tenant_id), s AS (SELECT tenant_id, CASE WHEN n < 1000 THEN 0 WHEN n < 10000 THEN 1 ELSE 2 END AS s FROM p) SELECT ['ok', 'degraded', 'fail'][max(s) + 1] AS overall, count(*) FILTER (WHERE s > 0) AS not_ok FROM s")
def health_overall(spark, sf):
    counted = T.events(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("n"))
    return extras.overall(counted.withColumn("state", extras.health(F.col("n"))))


@query(f"WITH {EVENTS}, p AS (SELECT user_id, count(*) FILTER (WHERE kind = 'click') AS n FROM ev GROUP BY user_id) SELECT user_id, n AS click_count, [1.0::DOUBLE, CAST(n AS DOUBLE)] AS vector FROM p")
def profile_export(spark, sf):
    """Profiles written as JSON lines and read back."""
    counted = T.events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("kind") == "click").alias("click_count"))
    return extras.export(counted.withColumn("vector", F.array(F.lit(1.0), F.col("click_count").cast("double"))), folder(spark, "profiles"))


@query(f"""WITH {EVENTS}, e AS (SELECT event_id, user_id, epoch_ms(created_at) AS ms, event_type = 'error' AS bad, value FROM ev)
SELECT event_id, round(avg(CASE WHEN bad THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w, 6) AS error_rate, round(quantile_cont(CASE WHEN NOT bad THEN value END, 0.95) OVER w, 6) AS p95 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""")
def rolling_errors(spark, sf):
    """Error rate and 95th percentile of successes over each request's last thousand minutes."""
    e = T.events(spark, sf).select("event_id", "user_id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("ms"), (F.col("event_type") == "error").alias("bad"), "value")
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-60_000_000, 0)
    return e.select("event_id", F.round(F.avg(F.col("bad").cast("double")).over(w), 6).alias("error_rate"), F.round(F.percentile(F.when(~F.col("bad"), F.col("value")), 0.95).over(w), 6).alias("p95"))


@query(f"WITH {POINTS}, s AS (SELECT doc_id, list(vector ORDER BY chunk_idx) AS v, list(greatest(1.0, 3.0 - chunk_idx) ORDER BY chunk_idx) AS w FROM points GROUP BY doc_id), a AS (SELECT doc_id, list_transform(range(1, len(v[1]) + 1), lambda i: list_sum(list_transform(range(1, len(v) + 1), lambda j: CAST(v[j][i] AS DOUBLE) * CAST(w[j] AS DOUBLE))) / list_sum(list_transform(w, lambda x: CAST(x AS DOUBLE)))) AS v FROM s) SELECT doc_id, {_UNIT.format(v='v')} AS vector FROM a")
def section_vectors(spark, sf):
    return I.section_vectors(T.points(spark, sf)).select("doc_id", vectors.rounded(F.col("vector")).alias("vector"))


# ---- streams
@query(f"WITH {OUTBOX} SELECT id, document_id, op FROM ob WHERE status = 'pending'")
def stream_publish(spark, sf):
    return jobs.publish(spark, sf)


@query("SELECT 't' || (user_id % 5) AS tenant_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest FROM events WHERE event_type NOT IN ('view', 'click') AND event_id % 5 IN (0, 3) GROUP BY 1")
def stream_lag(spark, sf):
    return jobs.lag(spark, sf)
