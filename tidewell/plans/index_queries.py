"""Indexing, queue, evaluation, migration, profile and streaming operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import stats, vectors
from tidewell.operators import evaluation as V
from tidewell.operators import indexing as I
from tidewell.operators import profiles as P
from tidewell.operators import search as S
from tidewell.sources import tables as T
from tidewell.sources.tables import DOCS, EVENTS, OUTBOX, POINTS
from tidewell.streaming import jobs

from .registry import query
from .search_queries import _CHAIN, _DOC_VECTORS, _EVERY, active_vectors, channels, doc_vectors, every_vectors

NOW = "2024-01-20 00:00:00"
_HASH = "sha256(title || chr(10) || content)"


# ---- write path
@query(f"WITH {DOCS} SELECT doc_id, {_HASH} AS content_hash, 'hash:' || {_HASH} || ':m0' AS cache_key FROM docs")
def content_hash(spark, sf):
    h = I.content_hash(F.col("title"), F.col("content"))
    return T.documents(spark, sf).select("doc_id", h.alias("content_hash"), F.concat(F.lit("hash:"), h, F.lit(":m0")).alias("cache_key"))


def _stored(spark, sf):
    return T.documents(spark, sf).select("tenant_id", F.col("doc_id").alias("external_ref"), I.content_hash(F.col("title"), F.col("content")).alias("content_hash"), "deleted_at")


def _incoming(spark, sf):
    """The next load: a third of the texts changed, a seventh of the references new."""
    ref = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    return T.documents(spark, sf).select("tenant_id", ref.alias("external_ref"), I.content_hash(F.col("title"), text).alias("content_hash"))


_UP = f"""st AS (SELECT tenant_id, doc_id AS external_ref, {_HASH} AS h FROM docs WHERE deleted_at IS NULL), inc AS (SELECT tenant_id, CASE WHEN doc_id % 7 = 0 THEN doc_id + 10000000 ELSE doc_id END AS external_ref,
  sha256(title || chr(10) || CASE WHEN doc_id % 3 = 0 THEN content || ' changed' ELSE content END) AS content_hash FROM docs),
up AS (SELECT inc.*, CASE WHEN h IS NULL THEN 'inserted' WHEN h = content_hash THEN 'no_change' ELSE 'updated' END AS status FROM inc LEFT JOIN st USING (tenant_id, external_ref))"""


@query(f"WITH {DOCS}, {_UP} SELECT * FROM up")
def upsert_status(spark, sf):
    return I.upsert(_stored(spark, sf), _incoming(spark, sf))


@query(f"WITH {DOCS}, {_UP} SELECT tenant_id, external_ref, content_hash, 'upsert' AS op, 'pending' AS status, 0 AS attempts FROM up WHERE status <> 'no_change'")
def outbox_enqueue(spark, sf):
    return I.enqueue(I.upsert(_stored(spark, sf), _incoming(spark, sf)))


@query(f"""WITH {DOCS}, ids AS (SELECT CASE WHEN doc_id % 9 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM docs)
SELECT ids.doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN deleted_at IS NOT NULL THEN 'already_deleted' ELSE 'deleted' END AS outcome, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(deleted_at, TIMESTAMP '{NOW}') END AS deleted_at FROM ids LEFT JOIN docs d ON d.doc_id = ids.doc_id""")
def soft_delete(spark, sf):
    docs = T.documents(spark, sf)
    return I.soft_delete(docs, docs.select(F.when(F.col("doc_id") % 9 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id")), NOW)


_W = r"list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')"


@query(f"""WITH {DOCS}, n AS (SELECT doc_id, CAST(len({_W}) AS INT) AS n_tokens FROM docs)
SELECT doc_id, n_tokens, CASE WHEN n_tokens >= 512 THEN 'multi' WHEN n_tokens >= 200 THEN 'weighted' ELSE 'single' END AS strategy, CAST(CASE WHEN n_tokens >= 512 THEN ceil(n_tokens / 462) ELSE 1 END AS BIGINT) AS n_chunks,
  CASE WHEN n_tokens BETWEEN 200 AND 511 THEN '3.0,1.0' END AS weights FROM n""")
def chunk_plan(spark, sf):
    return I.chunk_plan(T.documents(spark, sf))


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, {_W} AS w FROM docs), a AS (SELECT doc_id, w, unnest(range(0, len(w), 462)) AS s FROM w WHERE len(w) >= 512)
SELECT doc_id, CAST(s // 462 AS INT) AS chunk_idx, array_to_string(w[s + 1:s + 512], ' ') AS text FROM a""")
def chunk_windows(spark, sf):
    return I.chunk_windows(T.documents(spark, sf))


_SHA = f"sha1(unhex('{I.URL_NAMESPACE}') || encode(doc_id || ':' || chunk_idx))"


@query(f"""WITH {POINTS}, h AS (SELECT doc_id, chunk_idx, {_SHA} AS h FROM points) SELECT doc_id, chunk_idx, CASE WHEN chunk_idx = 0 THEN CAST(doc_id AS VARCHAR)
  ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS point_id FROM h""")
def point_ids(spark, sf):
    return T.points(spark, sf).select("doc_id", "chunk_idx", I.point_id(F.col("doc_id"), F.col("chunk_idx")).alias("point_id"))


@query("SELECT vec_id AS point_id, vec_id // 2 AS doc_id, vec_id % 2 AS chunk_idx, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS rev FROM embeddings WHERE vec_id % 2 < CASE WHEN (vec_id // 2) % 4 = 0 THEN 1 ELSE 2 END")
def point_upsert_prune(spark, sf):
    points = T.points(spark, sf).select("point_id", "doc_id", "chunk_idx", F.lit(1).alias("rev"))
    again = points.where("point_id % 3 = 0").withColumn("rev", F.lit(2))
    keep = points.where("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("keep")).distinct()
    return I.prune_chunks(I.latest_points(points.unionByName(again), F.desc("rev")), keep)


@query(f"WITH {DOCS}, k AS (SELECT DISTINCT {_HASH} AS key FROM docs) SELECT key FROM k WHERE key NOT IN (SELECT {_HASH} FROM docs WHERE language = 'fr' AND created_at > TIMESTAMP '{NOW}') AND key NOT IN (SELECT {_HASH} FROM docs WHERE language = 'de')")
def cache_misses(spark, sf):
    keyed = T.documents(spark, sf).withColumn("key", I.content_hash(F.col("title"), F.col("content")))
    cache = keyed.where("language = 'fr'").select("key", F.col("created_at").alias("expires_at"))
    failed = keyed.where("language = 'de'").select("key", F.lit("2099-01-01 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    return I.cache_misses(keyed, cache, failed, NOW)


# ---- queue
@query(f"WITH {OUTBOX} SELECT id, attempts, CAST(least(10 * pow(2, attempts), 3600) AS BIGINT) AS delay_s FROM ob")
def backoff(spark, sf):
    return T.outbox(spark, sf).select("id", "attempts", stats.backoff(F.col("attempts")).alias("delay_s"))


_ETYPE = "CASE WHEN lower(last_error) LIKE '%qdrant%' OR lower(last_error) LIKE '%timeout%' THEN 'qdrant_unavailable' WHEN lower(last_error) LIKE '%embedding%' OR lower(last_error) LIKE '%model%' THEN 'embedding_failed' WHEN lower(last_error) LIKE '%payload%' OR lower(last_error) LIKE '%validation%' THEN 'payload_invalid' ELSE 'other' END"
_DIGEST = f"""dead AS (SELECT *, {_ETYPE} AS error_type FROM ob WHERE status = 'dead'),
digest AS (SELECT tenant_id, model_name, error_type, count(*) AS n, min(updated_at) AS first_seen, max(updated_at) AS last_seen, array_to_string(list(document_id ORDER BY updated_at DESC, id DESC)[1:10], ',') AS sample_doc_ids FROM dead GROUP BY ALL)"""


@query(f"WITH {OUTBOX}, {_DIGEST} SELECT * FROM digest")
def dead_digest(spark, sf):
    return I.dead_digest(T.outbox(spark, sf))


@query(f"""WITH {OUTBOX}, {_DIGEST} SELECT tenant_id, model_name, error_type, CAST(n + CASE WHEN error_type = 'other' THEN 0 ELSE 5 END AS BIGINT) AS n, CASE WHEN error_type = 'other' THEN first_seen ELSE TIMESTAMP '2023-12-31' END AS first_seen, last_seen,
  array_to_string(CASE WHEN error_type = 'other' THEN string_split(sample_doc_ids, ',') ELSE list_concat(['7', '8'], string_split(sample_doc_ids, ','))[1:10] END, ',') AS sample_doc_ids FROM digest""")
def digest_merge(spark, sf):
    new = I.dead_digest(T.outbox(spark, sf))
    at = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")
    old = new.where("error_type <> 'other'").select("tenant_id", "model_name", "error_type", F.lit(5).alias("n"), at.alias("first_seen"), at.alias("last_seen"), F.lit("7,8").alias("sample_doc_ids"))
    return I.merge_digest(old, new)


@query(f"""WITH {OUTBOX} SELECT count(*) FILTER (WHERE status IN ('pending', 'failed') AND next_retry_at <= TIMESTAMP '{NOW}') AS pending, count(*) FILTER (WHERE status IN ('pending', 'failed', 'in_progress') AND next_retry_at <= TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE) AS near_due,
  count(*) FILTER (WHERE status = 'dead') AS dead, coalesce(CAST(trunc(epoch(TIMESTAMP '{NOW}' - min(created_at) FILTER (WHERE status IN ('pending', 'failed')))) AS BIGINT), 0) AS oldest_s FROM ob""")
def outbox_lag(spark, sf):
    return I.outbox_counts(T.outbox(spark, sf), NOW)


@query(f"WITH {OUTBOX} SELECT id, document_id, 'in_progress' AS status FROM ob WHERE status IN ('pending', 'failed') AND next_retry_at <= TIMESTAMP '{NOW}' ORDER BY next_retry_at, id LIMIT 500")
def claim_batch(spark, sf):
    """The queue's batch of 500 is the feature."""
    return I.claim(T.outbox(spark, sf), NOW).select("id", "document_id", "status")


@query(f"""WITH {OUTBOX}, a AS (SELECT id, attempts, last_error, op = 'upsert' AS ok, CASE WHEN op = 'upsert' THEN attempts ELSE attempts + 1 END AS n FROM ob)
SELECT id, CASE WHEN ok THEN 'done' WHEN n >= 20 THEN 'dead' ELSE 'failed' END AS status, CAST(n AS INT) AS attempts, CASE WHEN NOT ok THEN substr(last_error, 1, 4096) END AS last_error, CASE WHEN NOT ok AND n < 20 THEN CAST(least(10 * pow(2, attempts), 3600) AS BIGINT) END AS delay_s FROM a""")
def status_transitions(spark, sf):
    return I.settle(T.outbox(spark, sf), F.col("op") == "upsert", F.col("last_error"))


@query(f"WITH {OUTBOX} SELECT id, {_ETYPE} AS digest_type, CASE WHEN lower(last_error) LIKE '%timeout%' THEN 'timeout' WHEN lower(last_error) LIKE '%connection%' THEN 'unavailable' WHEN lower(last_error) LIKE '%valid%' OR lower(last_error) LIKE '%payload%' THEN 'invalid' ELSE 'other' END AS class FROM ob")
def error_classes(spark, sf):
    return T.outbox(spark, sf).select("id", I.error_type(F.col("last_error")).alias("digest_type"), I.error_class(F.col("last_error")).alias("class"))


@query(f"WITH {OUTBOX}, l AS (SELECT document_id, arg_max(status, (updated_at, id)) AS raw FROM ob GROUP BY document_id) SELECT document_id, raw, CASE WHEN raw IN ('done', 'dead') THEN raw ELSE 'pending' END AS status FROM l")
def latest_status(spark, sf):
    return I.latest_status(T.outbox(spark, sf))


@query(f"WITH {OUTBOX} SELECT tenant_id, count(*) * 300 AS backlog, CASE WHEN count(*) * 300 > 100000 THEN 'reindex' WHEN count(*) * 300 > 50000 THEN 'throttled' ELSE 'normal' END AS status FROM ob WHERE status IN ('pending', 'failed') GROUP BY tenant_id")
def throttle_status(spark, sf):
    counted = T.outbox(spark, sf).where("status in ('pending', 'failed')").groupBy("tenant_id").agg((F.count("*") * 300).alias("backlog"))
    return counted.withColumn("status", I.throttle(F.col("backlog")))


@query(f"WITH {DOCS} SELECT tenant_id, count(*) AS doc_count FROM docs WHERE deleted_at IS NULL GROUP BY tenant_id")
def tenant_doc_count(spark, sf):
    return I.doc_counts(T.documents(spark, sf))


@query(f"""WITH {EVENTS}, s AS (SELECT tenant_id, sum(len(query_text)) AS s, count(*) AS c FROM ev WHERE kind = 'search' GROUP BY tenant_id), b AS (SELECT 't' || i AS tenant_id, 12.5 AS m, 40 AS n FROM range(3) t(i))
SELECT tenant_id, round((coalesce(m, 0) * coalesce(n, 0) + coalesce(s, 0)) / (coalesce(n, 0) + coalesce(c, 0)), 6)::DOUBLE AS avg_query_len, CAST(coalesce(n, 0) + coalesce(c, 0) AS BIGINT) AS total_searches FROM b FULL JOIN s USING (tenant_id)""")
def running_avg_query_len(spark, sf):
    before = spark.range(3).select(F.concat(F.lit("t"), "id").alias("tenant_id"), F.lit(12.5).alias("avg_query_len"), F.lit(40).cast("long").alias("total_searches"))
    return I.running_average(before, T.events(spark, sf).where("kind = 'search'"))


@query(f"WITH {DOCS}, {OUTBOX} SELECT 'bad_enum' AS \"check\", 0 AS n UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM docs GROUP BY tenant_id, doc_id HAVING count(*) > 1) UNION ALL SELECT 'orphan_queue_row', count(*) FROM ob WHERE document_id NOT IN (SELECT doc_id FROM docs)")
def constraint_violations(spark, sf):
    return I.violations(T.documents(spark, sf), T.outbox(spark, sf))


# ---- evaluation: relevant are the documents of good quality of the request's tenant
_JUDGED = "judged AS (SELECT query_id, d.doc_id FROM rq JOIN docs d USING (tenant_id) JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id WHERE quality = 1)"
_SCORES = f"""{_JUDGED}, tot AS (SELECT query_id, count(*) AS total FROM judged GROUP BY query_id),
g AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM rrf SEMI JOIN judged USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id),
sc AS (SELECT query_id, round(coalesce(found / total, 0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, CAST(least(total, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM tot LEFT JOIN g USING (query_id))"""


def good_documents(spark, sf):
    good = T.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    return T.documents(spark, sf).select("doc_id", "tenant_id").join(good, "doc_id", "left_semi")


def judged_totals(spark, sf):
    """query_id, total: how many documents are relevant, counted by tenant."""
    per = good_documents(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("total"))
    return T.requests(spark, sf).select("query_id", "tenant_id").join(per, "tenant_id").select("query_id", "total")


def judged_hits(spark, sf, *channels):
    """The relevant ones among the channels' hits: only what was retrieved is looked up, not a tenant's every document."""
    hits = None
    for c in channels:
        hits = c.select("query_id", "doc_id") if hits is None else hits.unionByName(c.select("query_id", "doc_id"))
    asked = hits.distinct().join(S.small(T.requests(spark, sf).select("query_id", "tenant_id")), "query_id")
    return asked.join(good_documents(spark, sf), ["doc_id", "tenant_id"], "left_semi").select("query_id", "doc_id")


def scores(spark, sf, vectors=active_vectors):
    _, _, lex, vec = channels(spark, sf, vectors)
    fused = S.rrf(lex, vec)
    return V.relevance(fused, judged_hits(spark, sf, lex, vec), totals=judged_totals(spark, sf))


for _metric, _from, _vectors in (("recall", _CHAIN, active_vectors), ("ndcg", _EVERY, every_vectors), ("mrr", _EVERY, every_vectors)):
    query(f"WITH {_from}, {_SCORES} SELECT query_id, CAST({_metric} AS DOUBLE) AS {_metric} FROM sc", f"{_metric}_at_10")(lambda spark, sf, m=_metric, v=_vectors: scores(spark, sf, v).select("query_id", m))


@query(f"WITH {_CHAIN}, {_SCORES} SELECT 'rrf' AS strategy, query_id, CAST(recall AS DOUBLE) AS recall, place FROM (SELECT *, row_number() OVER (ORDER BY recall, query_id) AS place FROM sc) WHERE place <= 3")
def worst_queries(spark, sf):
    return V.worst(scores(spark, sf).withColumn("strategy", F.lit("rrf"))).select("strategy", "query_id", "recall", "place")


@query(f"""WITH {_CHAIN}, {_JUDGED}, j AS (SELECT query_id, rq.tenant_id, count(*) AS n FROM judged JOIN rq USING (query_id) GROUP BY ALL), l AS (SELECT j.*, d.language FROM j JOIN docs d ON d.doc_id = j.query_id)
SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS relevant, round(avg(n), 6) AS avg_relevant, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, count(DISTINCT tenant_id) AS tenants FROM l""")
def dataset_stats(spark, sf):
    counted = judged_totals(spark, sf).withColumnRenamed("total", "n")
    named = T.documents(spark, sf).select(F.col("doc_id").alias("query_id"), "tenant_id", "language")
    return V.dataset_stats(counted.join(named, "query_id"))


# ---- migration
@query(f"WITH {POINTS}, o AS (SELECT doc_id, min_by(vector, chunk_idx) AS a FROM points GROUP BY doc_id), n AS (SELECT doc_id, max_by(vector, chunk_idx) AS b FROM points GROUP BY doc_id), c AS (SELECT list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) AS c FROM o JOIN n USING (doc_id)) SELECT round(avg(c), 6) AS avg_similarity, round(min(c), 6) AS min_similarity, round(max(c), 6) AS max_similarity, count(*) AS n, round(min(c), 6) >= 0.6 AND round(avg(c), 6) <= 0.95 AS passed FROM c")
def canary_stats(spark, sf):
    new = T.points(spark, sf).groupBy("doc_id").agg(F.max_by("vector", "chunk_idx").alias("vector"))
    return V.canary(doc_vectors(spark, sf), new)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) SELECT (r - 1) // 300 AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY 1")
def backfill_batches(spark, sf):
    return V.backfill(T.read(spark, sf, "documents").select("doc_id"), 300)


@query("SELECT doc_id, unnest(['docs_v1', 'docs_v2']) AS collection FROM documents")
def dual_write_targets(spark, sf):
    return V.write_targets(T.read(spark, sf, "documents"), ["docs_v1", "docs_v2"])


@query(f"WITH {EVENTS}, u AS (SELECT user_id, min(created_at) AS p FROM ev GROUP BY user_id) SELECT user_id AS migration_id, p + INTERVAL 7 DAYS <= TIMESTAMP '2024-01-08 12:00:00' AS allowed FROM u")
def cleanup_allowed(spark, sf):
    promoted = T.events(spark, sf).groupBy(F.col("user_id").alias("migration_id")).agg(F.min("created_at").alias("promoted_at")).withColumn("status", F.lit("promoted"))
    return V.cleanup_allowed(promoted, "2024-01-08 12:00:00")


# ---- profiles
def _ema(key: str, rate: str, name: str) -> str:
    """Moving averages along each key's clicks, one step a round."""
    return f"""WITH RECURSIVE {POINTS}, {EVENTS}, {_DOC_VECTORS}, cl AS (SELECT {key} AS k, CAST(vector AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY {key} ORDER BY created_at, event_id) - 1 AS i FROM ev JOIN dv ON dv.doc_id = clicked_doc_id WHERE kind = 'click'),
r AS (SELECT k, i, v AS s FROM cl WHERE i = 0 UNION ALL SELECT k, i, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) FROM (SELECT cl.k, cl.i, list_transform(list_zip(r.s, cl.v), lambda p: (1 - {rate}) * p[1] + {rate} * p[2]) AS m FROM r JOIN cl ON cl.k = r.k AND cl.i = r.i + 1)),
l AS (SELECT k, max_by(s, i) AS s, count(*) AS n FROM r GROUP BY k) SELECT {name}, list_transform(s, lambda x: round(x, 6)) AS vector, n AS click_count, n AS profile_version FROM l"""


@query(_ema("user_id", "(CASE WHEN cl.i < 10 THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END)", "k AS user_id"))
def ema_profiles(spark, sf):
    clicks = T.events(spark, sf).where("kind = 'click'")
    return P.profile_updates(clicks, doc_vectors(spark, sf), ["user_id"]).withColumn("vector", vectors.rounded(F.col("vector")))


_TIME = "'time:' || CASE WHEN hour(created_at) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(created_at) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(created_at) >= 18 THEN 'evening' ELSE 'night' END"


@query(_ema(f"{{'u': user_id, 'c': {_TIME}}}", "0.1::DOUBLE", "k.u AS user_id, k.c AS context_key"))
def context_profiles(spark, sf):
    clicks = T.events(spark, sf).where("kind = 'click'").withColumn("context_key", P.context_key(F.lit(None).cast("string"), P.time_of_day(F.col("created_at")), F.lit("web")))
    return P.profile_updates(clicks, doc_vectors(spark, sf), ["user_id", "context_key"], fast=0.1, slow=0.1).withColumn("vector", vectors.rounded(F.col("vector")))


@query(f"WITH {EVENTS} SELECT event_id, 'time:' || CASE WHEN hour(created_at) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(created_at) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(created_at) >= 18 THEN 'evening' ELSE 'night' END AS context_key FROM ev")
def context_keys(spark, sf):
    return T.events(spark, sf).select("event_id", P.context_key(F.lit(None).cast("string"), P.time_of_day(F.col("created_at")), F.lit("web")).alias("context_key"))


# ---- streams
@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return jobs.tumbling(spark, sf)


@query("SELECT strftime(h - to_hours(k), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h, unnest([0, 1]) AS k FROM events WHERE event_type = 'error') GROUP BY 1")
def stream_digest(spark, sf):
    return jobs.sliding_digest(spark, sf)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark, sf):
    return jobs.sessions(spark, sf)


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    return jobs.deduplicated(spark, sf)


@query("SELECT user_id % 5 AS tenant, count(*) AS searches, round(avg(value), 4) AS avg_value FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_running_avg(spark, sf):
    return jobs.running_averages(spark, sf)


@query()
def stream_breaker(spark, sf):
    return jobs.breaker(spark, sf)


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, created_at, event_id, event_type = 'purchase' AS settles, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS run FROM ev WHERE event_type IN ('error', 'purchase')),
n AS (SELECT *, count(*) FILTER (WHERE NOT settles) OVER (PARTITION BY user_id, run ORDER BY created_at, event_id) AS attempts FROM e),
l AS (SELECT user_id, bool_or(attempts >= 20) AS dead, arg_max(attempts, (created_at, event_id)) AS attempts, arg_max(settles, (created_at, event_id)) AS settled, epoch_us(max(created_at)) AS last FROM n GROUP BY user_id),
d AS (SELECT user_id, attempts, last + 1000000 * CAST(least(10 * pow(2, attempts - 1), 3600) AS BIGINT) AS due FROM l WHERE NOT dead AND NOT settled)
SELECT user_id, CAST(attempts AS INT) AS attempts, due FROM d WHERE due < (SELECT epoch_us(max(created_at)) - 60000000 FROM e)""")
def stream_retries(spark, sf):
    return jobs.retries(spark, sf)


@query()
def stream_profiles(spark, sf):
    """Profiles carried on click by click: the same as of all clicks at once."""
    return jobs.profiles(spark, sf, doc_vectors(spark, sf)).withColumn("vector", vectors.rounded(F.col("vector")))
