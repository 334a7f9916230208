"""Engine tables over the Parquet inputs, as DataFrames and as SQL with the same columns.

Each adapter is declared once per dialect; operators see only the engine's columns. Scans stay prunable: adapters are
projections, so filters and column choices reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIMENT = "exp1"
#: Variant order matters: the first is the control.
VARIANTS = (("control", 0.5), ("a", 0.3), ("b", 0.2))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS tenant_id", "substring(text, 1, 40) AS title", "text AS content", "lang AS language",
        "array(lang, concat('b', n_chars % 5), concat('l', doc_id % 7)) AS tags",
        "concat('{\"category\":\"c', doc_id % 4, '\",\"price\":', n_chars, '}') AS attributes",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, doc_id) AS created_at",
        "if(doc_id % 20 = 7, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(1, doc_id), null) AS deleted_at",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS point_id", "vec_id div 2 AS doc_id", "vec_id % 2 AS chunk_idx", "embedding AS vector", "concat('m', label % 2) AS model_name", "label"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and click rows in one table, told apart by kind."""
    k = "cast(get_json_object(props, '$.k') as bigint)"
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts AS created_at", "user_id", "concat('t', user_id % 5) AS tenant_id", "event_type", "value", f"{k} AS k",
        "case event_type when 'view' then 'search' when 'click' then 'click' end AS kind",
        f"if(event_type = 'view', concat('q', {k} % 50), null) AS query_text",
        "if(event_type = 'view', cast(value as int), null) AS latency_ms",
        f"if(event_type = 'click', {k}, null) AS clicked_doc_id",
        f"if(event_type = 'click', 1 + {k} % 10, null) AS position",
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_type not in ('view', 'click')").selectExpr(
        "event_id AS id", "event_id % 1000 AS document_id", "if(event_type = 'error', 'delete', 'upsert') AS op",
        "element_at(array('pending', 'in_progress', 'done', 'failed', 'dead'), cast(event_id % 5 + 1 as int)) AS status",
        "cast(event_id % 25 as int) AS attempts",
        "element_at(array('Qdrant connection timeout', 'Embedding model failed', 'payload validation error', 'disk is full'), cast(event_id % 4 + 1 as int)) AS last_error",
        "ts - make_dt_interval(0, 1) AS created_at", "ts AS updated_at", "ts + make_dt_interval(0, 0, 0, event_id % 600) AS next_retry_at", "concat('t', user_id % 5) AS tenant_id", "concat('m', user_id % 2) AS model_name",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request for every document whose id is divisible by 100: its first two words, its tenant, its vector."""
    docs = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").selectExpr(
        "doc_id AS query_id", "source AS tenant_id", f"array_join(slice(regexp_extract_all(lower(text), r'{TOKEN}', 0), 1, 2), ' ') AS query", "0.5D AS alpha", "10 AS top_k"
    )
    vectors = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    return docs.join(vectors, "query_id", "left")


#: What a token is: letters and digits of the Latin and Cyrillic blocks, after lower-casing.
TOKEN = r"[a-z0-9\x{DF}-\x{24F}\x{400}-\x{4FF}]+"

# ---- the same in DuckDB's SQL
DOCS = r"""docs AS (SELECT doc_id, source AS tenant_id, substr(text, 1, 40) AS title, text AS content, lang AS language,
  [lang, 'b' || (n_chars % 5), 'l' || (doc_id % 7)] AS tags, 'c' || (doc_id % 4) AS category, CAST(n_chars AS DOUBLE) AS price,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, CASE WHEN doc_id % 20 = 7 THEN TIMESTAMP '2024-01-02' + to_hours(doc_id) END AS deleted_at FROM documents)"""
POINTS = "points AS (SELECT vec_id AS point_id, vec_id // 2 AS doc_id, vec_id % 2 AS chunk_idx, embedding AS vector, 'm' || (label % 2) AS model_name, label FROM embeddings)"
EVENTS = """ev AS (SELECT event_id, ts AS created_at, user_id, 't' || (user_id % 5) AS tenant_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'click' END AS kind,
  CASE WHEN event_type = 'view' THEN 'q' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 50) END AS query_text,
  CASE WHEN event_type = 'view' THEN CAST(trunc(value) AS INT) END AS latency_ms,
  CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS clicked_doc_id,
  CASE WHEN event_type = 'click' THEN 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 END AS position FROM events)"""
OUTBOX = """ob AS (SELECT event_id AS id, event_id % 1000 AS document_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
  ['pending', 'in_progress', 'done', 'failed', 'dead'][event_id % 5 + 1] AS status, CAST(event_id % 25 AS INT) AS attempts,
  ['Qdrant connection timeout', 'Embedding model failed', 'payload validation error', 'disk is full'][event_id % 4 + 1] AS last_error,
  ts - INTERVAL 1 HOUR AS created_at, ts AS updated_at, ts + to_seconds(event_id % 600) AS next_retry_at, 't' || (user_id % 5) AS tenant_id, 'm' || (user_id % 2) AS model_name FROM events WHERE event_type NOT IN ('view', 'click'))"""
REQUESTS = rf"""rq AS (SELECT doc_id AS query_id, source AS tenant_id, array_to_string(regexp_extract_all(lower(text), '{TOKEN}')[1:2], ' ') AS query, 0.5 AS alpha, 10 AS top_k, embedding AS query_vector
  FROM documents LEFT JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) ON vec_id = doc_id WHERE doc_id % 100 = 0)"""


def variant_sql(user: str = "user_id", experiment: str = EXPERIMENT) -> tuple[str, str]:
    """Bucket and variant of a user as DuckDB expressions."""
    digits = f"list_transform(string_split(sha256({user} || ':{experiment}'), ''), lambda x: instr('0123456789abcdef', x) - 1)"
    bucket = f"list_reduce(list_prepend(0, {digits}), lambda a, c: (a * 16 + c) % 1000)"
    return bucket, f"CASE WHEN {bucket} < 500 THEN 'control' WHEN {bucket} < 800 THEN 'a' ELSE 'b' END"
