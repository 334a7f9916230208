"""The merge job as queries: a load of the documents, then one with changes, merged twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import indexing as I
from tidewell.sources import tables as T
from tidewell.sources.scratch import folder
from tidewell.sources.store import DocumentStore
from tidewell.sources.tables import DOCS

from .registry import query


def _load(spark, sf):
    return T.documents(spark, sf).withColumn("external_ref", F.col("doc_id").cast("string")).withColumn("updated_at", F.col("created_at"))


def _next(docs):
    """The next load: a third with other texts, a seventh under new references, every thirteenth deleted or back."""
    ref = F.when(F.col("doc_id") % 7 == 0, F.concat("external_ref", F.lit("-new"))).otherwise(F.col("external_ref"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    turned = F.when(F.col("deleted_at").isNull(), F.col("created_at"))
    return docs.withColumn("external_ref", ref).withColumn("content", text).withColumn("deleted_at", F.when(F.col("doc_id") % 13 == 0, turned).otherwise(F.col("deleted_at"))).where("doc_id % 5 <> 1")


def _merged(spark, sf):
    store, docs = DocumentStore(spark, folder(spark, "store")), _load(spark, sf)
    store.upsert(docs, "first")
    chunks = I.chunk_plan(docs.where("deleted_at is null")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks"))).alias("chunk_idx"))  # one more than there are
    store.write_points(chunks.join(docs.select("doc_id", "tenant_id", "external_ref"), "doc_id").withColumn("vector", F.array(F.col("chunk_idx").cast("float"))))
    for _ in range(2):
        store.upsert(_next(docs), "second")
    return store


_HASH = "sha256({0}title || chr(10) || {0}content)"
_STATES = f"""a AS (SELECT doc_id, tenant_id, CAST(doc_id AS VARCHAR) AS ref, title, content, deleted_at IS NULL AS alive FROM docs),
b AS (SELECT doc_id, tenant_id, CASE WHEN doc_id % 7 = 0 THEN doc_id || '-new' ELSE CAST(doc_id AS VARCHAR) END AS ref, title, CASE WHEN doc_id % 3 = 0 THEN content || ' changed' ELSE content END AS content, CASE WHEN doc_id % 13 = 0 THEN deleted_at IS NOT NULL ELSE deleted_at IS NULL END AS alive FROM docs WHERE doc_id % 5 <> 1),
c AS (SELECT b.*, a.alive AS was, a.ref IS NOT NULL AND a.alive AS stored, {_HASH.format('b.')} AS h, {_HASH.format('a.')} AS old FROM b LEFT JOIN a USING (tenant_id, ref)),
ch AS (SELECT *, CASE WHEN NOT stored THEN CASE WHEN alive THEN 'upsert' END WHEN NOT alive THEN 'delete' WHEN h <> old THEN 'upsert' END AS op FROM c)"""


@query(f"""WITH {DOCS}, {_STATES} SELECT tenant_id, ref AS external_ref, {_HASH.format('')} AS content_hash, true AS alive FROM a WHERE alive AND (tenant_id, ref) NOT IN (SELECT (tenant_id, ref) FROM ch WHERE op IS NOT NULL)
UNION ALL SELECT tenant_id, ref, h, alive FROM ch WHERE op IS NOT NULL""")
def upsert_job(spark, sf):
    """The documents after a load and a second one with changes, which is merged twice."""
    return _merged(spark, sf).documents().select("tenant_id", "external_ref", "content_hash", F.col("deleted_at").isNull().alias("alive"))


@query(f"""WITH {DOCS}, {_STATES} SELECT 'first' AS load, tenant_id, ref AS external_ref, 'upsert' AS op FROM a WHERE alive UNION ALL SELECT 'second', tenant_id, ref, op FROM ch WHERE op IS NOT NULL""")
def upsert_queue(spark, sf):
    """What both loads enqueued: each change once."""
    return _merged(spark, sf).queue().select("load", "tenant_id", "external_ref", "op")


_N = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
_CHUNKS = f"CAST(CASE WHEN {_N} >= 512 THEN ceil({_N} / 462) ELSE 1 END AS BIGINT)"


@query(f"""WITH {DOCS}, {_STATES}, p AS (SELECT tenant_id, ref, {_CHUNKS.format('content', 'content')} + 1 AS n FROM a WHERE alive), k AS (SELECT tenant_id, ref, CASE WHEN op = 'delete' THEN 0 ELSE {_CHUNKS.format('content', 'content')} END AS keep FROM ch WHERE op IS NOT NULL)
SELECT tenant_id, ref AS external_ref, least(n, coalesce(keep, n)) AS chunks FROM p LEFT JOIN k USING (tenant_id, ref) WHERE coalesce(keep, n) > 0""")
def upsert_points(spark, sf):
    """Vectors left by document: those of deleted documents and of chunks past the new text's are gone."""
    return _merged(spark, sf).points().groupBy("tenant_id", "external_ref").agg(F.count("*").alias("chunks"))
