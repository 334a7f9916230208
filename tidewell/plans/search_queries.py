"""Search operators as queries over the engine tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import stats, text, vectors
from tidewell.operators import search as S
from tidewell.sources import tables as T
from tidewell.sources.scratch import stored
from tidewell.sources.tables import DOCS, POINTS, REQUESTS, TOKEN

from .registry import query

_ALL = f"{DOCS}, {POINTS}, {REQUESTS}"
_TOK = f"regexp_extract_all(lower(content), '{TOKEN}')"


def _tri(text_sql: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({text_sql}), '{TOKEN}'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


_LEX = rf"""
held AS (SELECT tenant_id, doc_id, unnest({_TOK}) AS token FROM docs WHERE deleted_at IS NULL),
want AS (SELECT query_id, tenant_id, len(list_distinct(regexp_extract_all(query, '{TOKEN}'))) AS n, unnest(list_distinct(regexp_extract_all(query, '{TOKEN}'))) AS token FROM rq),
tf AS (SELECT tenant_id, doc_id, token, count(*) AS tf FROM held SEMI JOIN want USING (tenant_id, token) GROUP BY ALL),
tm AS (SELECT query_id, doc_id, round(sum(tf / (tf + 1.0)) / any_value(n), 6) AS token_rank FROM tf JOIN want USING (tenant_id, token) GROUP BY query_id, doc_id HAVING count(*) = any_value(n)),
trd AS (SELECT tenant_id, doc_id, {_tri("title || ' ' || content")} AS d FROM docs WHERE deleted_at IS NULL), trq AS (SELECT query_id, tenant_id, {_tri('query')} AS q FROM rq),
ts AS (SELECT query_id, doc_id, round(CAST(len(list_intersect(d, q)) AS DOUBLE) / (len(d) + len(q) - len(list_intersect(d, q))), 6) AS similarity FROM trd JOIN trq USING (tenant_id) WHERE least(len(d), len(q)) > 0.3 * greatest(len(d), len(q))),
tg AS (SELECT * FROM ts WHERE similarity > 0.3),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, round(0.7 * coalesce(token_rank, 0) + 0.3 * coalesce(similarity, 0), 6) AS score FROM tm FULL JOIN tg USING (query_id, doc_id))) WHERE rank <= 50)"""
_VEC = """
vs AS (SELECT query_id, doc_id, round((max(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(query_vector AS DOUBLE[]))) + 1) / 2, 6) AS score FROM points, rq WHERE query_vector IS NOT NULL GROUP BY ALL),
md AS (SELECT model_name, row_number() OVER (ORDER BY count(*) DESC, model_name) = 1 AS is_default FROM points GROUP BY model_name),
vm AS (SELECT query_id, doc_id, round((max(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(query_vector AS DOUBLE[]))) + 1) / 2, 6) AS score FROM points JOIN md USING (model_name), rq WHERE is_default AND query_vector IS NOT NULL GROUP BY ALL),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vm WHERE doc_id IN (SELECT doc_id FROM docs WHERE deleted_at IS NULL)) WHERE rank <= 50)"""
_RRF = """
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_rank NULLS LAST, vector_rank NULLS LAST, doc_id) AS rank FROM
  (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 9) AS score, l.rank AS lexical_rank, v.rank AS vector_rank FROM lex l FULL JOIN vec v USING (query_id, doc_id)))"""
_DOC_VECTORS = "dv AS (SELECT doc_id, min_by(vector, chunk_idx) AS vector FROM points GROUP BY doc_id)"
_CHAIN = f"{_ALL}, {_LEX}, {_VEC}, {_RRF}, {_DOC_VECTORS}"
_EVERY_VEC = """
vs AS (SELECT query_id, doc_id, round((max(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(query_vector AS DOUBLE[]))) + 1) / 2, 6) AS score FROM points, rq WHERE query_vector IS NOT NULL GROUP BY ALL),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs WHERE doc_id IN (SELECT doc_id FROM docs WHERE deleted_at IS NULL)) WHERE rank <= 50)"""
#: The same with the points of every model in the vector channel.
_EVERY = f"{_ALL}, {_LEX}, {_EVERY_VEC}, {_RRF}, {_DOC_VECTORS}"


def models(spark, sf):
    """The models of the points; the one with most is the default and the only active one."""
    counted = T.points(spark, sf).groupBy("model_name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "model_name"))  # a row a model
    return counted.select("model_name", (place == 1).alias("is_default")).withColumn("is_active", F.col("is_default"))


def active_vectors(spark, sf):
    """The vector channel: points of active models and live documents."""
    return S.vector_search(T.points(spark, sf), T.requests(spark, sf), T.documents(spark, sf), models=models(spark, sf))


def every_vectors(spark, sf):
    """The vector channel over the points of every model."""
    return S.vector_search(T.points(spark, sf), T.requests(spark, sf), T.documents(spark, sf))


def channels(spark, sf, vectors=active_vectors):
    """Both channels, written once: fusion, reranking and assembly read them again."""
    docs, requests = T.documents(spark, sf), T.requests(spark, sf)
    return docs, requests, stored(S.lexical_search(docs, requests)), stored(vectors(spark, sf))


def doc_vectors(spark, sf):
    return T.points(spark, sf).groupBy("doc_id").agg(F.min_by("vector", "chunk_idx").alias("vector"))


def profiles(spark, sf):
    """A profile for each request that has a vector: that of the document after it."""
    return T.requests(spark, sf).where("query_vector is not null").select("query_id", F.col("query_vector").alias("profile_vector"))


# ---- scans and filters
_FIELDS = ("doc_id", "tenant_id", "title", "language")


def _filter(name, where, **filters):
    query(f"WITH {DOCS} SELECT doc_id, tenant_id, title, language FROM docs WHERE {where}", name)(lambda spark, sf: S.matching(T.documents(spark, sf), **filters).select(*_FIELDS))


_filter("filter_language", "language IN ('en', 'fr')", languages=("en", "fr"))
_filter("filter_tags_any", "list_has_any(tags, ['b1', 'l3'])", tags_any=("b1", "l3"))
_filter("filter_category", "category = 'c1'", category="c1")
_filter("filter_price_range", "price BETWEEN 1000 AND 5000", price_min=1000, price_max=5000)
_filter("filter_created_after", "created_at >= TIMESTAMP '2024-01-10'", created_after="2024-01-10 00:00:00")
_filter("tenant_isolation", "tenant_id = 'src0'", tenant="src0")
_filter("filter_combined", "tenant_id = 'src1' AND language = 'en' AND price >= 500 AND list_has_any(tags, ['b0', 'b2'])", tenant="src1", languages=("en",), price_min=500, tags_any=("b0", "b2"))


@query(f"WITH {DOCS} SELECT doc_id, tenant_id, title, language FROM docs WHERE deleted_at IS NULL")
def scan_live_docs(spark, sf):
    return S.live(T.documents(spark, sf)).select(*_FIELDS)


@query(f"WITH {DOCS}, {REQUESTS} SELECT rq.query_id, docs.doc_id, docs.title FROM rq JOIN docs ON docs.doc_id = rq.query_id AND docs.tenant_id = rq.tenant_id WHERE deleted_at IS NULL")
def point_lookup(spark, sf):
    keys = T.requests(spark, sf).select("query_id", F.col("query_id").alias("doc_id"), "tenant_id")
    return S.live(T.documents(spark, sf)).join(S.small(keys), ["doc_id", "tenant_id"]).select("query_id", "doc_id", "title")


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) < '1a' ORDER BY h LIMIT 500")
def hash_sample(spark, sf):
    """About a tenth by hash, in order of the hash, 500 at most: the sample is the feature."""
    h = F.md5(F.col("doc_id").cast("string"))
    return T.read(spark, sf, "documents").select("doc_id", h.alias("h")).where(F.substring("h", 1, 2) < "1a").orderBy("h").limit(500)


@query(f"WITH {DOCS} SELECT doc_id, substr(content, 1, 200) AS snippet, title || chr(10) || substr(content, 1, 200) AS rerank_text FROM docs")
def snippet(spark, sf):
    cut = F.substring("content", 1, S.SNIPPET)
    return T.documents(spark, sf).select("doc_id", cut.alias("snippet"), F.concat_ws("\n", "title", cut).alias("rerank_text"))


# ---- text functions
@query("SELECT doc_id, nfc_normalize(text) AS normal FROM documents")
def nfc_normalize(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", text.nfc("text").alias("normal"))


# Made by hand, as the documents have no Cyrillic: what a token starts with decides.
SCRIPTS = "мир world", "миру3 3мир d'or -x", "ёлка élan 42", "aмир мирa", "ѐж"
_MADE = " UNION ALL ".join(f"SELECT {-k - 1} AS doc_id, '{t}' AS text".replace("d'or", "d''or") for k, t in enumerate(SCRIPTS))
_LATIN, _CYRILLIC = r"[A-Za-z\x{C0}-\x{24F}]", r"[\x{400}-\x{4FF}]"


@query(rf"""WITH t AS (SELECT doc_id, unnest(string_split_regex(trim(text, ' ' || chr(10)), '[ \n]+')) AS w FROM (SELECT doc_id, text FROM documents UNION ALL {_MADE})),
k AS (SELECT doc_id, CASE WHEN regexp_matches(w, '^{_LATIN}') THEN 'latin' WHEN regexp_matches(w, '^{_CYRILLIC}') AND NOT regexp_matches(w, '{_LATIN}') THEN 'cyrillic' WHEN regexp_matches(w, '^{_CYRILLIC}') THEN CASE WHEN regexp_matches(w, '^[^\x{{400}}-\x{{4FF}}]*{_LATIN}') THEN 'latin' ELSE 'neutral' END ELSE 'neutral' END AS kind FROM t WHERE w <> '')
SELECT doc_id, count(*) FILTER (WHERE kind = 'latin') AS latin, count(*) FILTER (WHERE kind = 'cyrillic') AS cyrillic, count(*) FILTER (WHERE kind = 'neutral') AS neutral FROM k GROUP BY doc_id""")
def script_split(spark, sf):
    made = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(SCRIPTS)], "doc_id long, text string")
    texts = T.read(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(made)
    words = texts.select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("w")).where("w <> ''")
    kind = text.script(F.col("w"))
    return words.groupBy("doc_id").agg(*[F.count_if(kind == name).alias(name) for name in ("latin", "cyrillic", "neutral")])


_BEST = ", ".join(f"{{n: len(list_filter(t, lambda w: list_contains({list(stop)!r}, w))), name: '{name}'}}" for name, stop in text.STOP_WORDS.items())


@query(rf"""WITH {DOCS}, t AS (SELECT doc_id, regexp_extract_all(lower(title || chr(10) || content), '{TOKEN}') AS t FROM docs), c AS (SELECT doc_id, [{_BEST}] AS c FROM t),
s AS (SELECT doc_id, list_sort(c, 'DESC')[1] AS best, list_sum(list_transform(c, lambda x: x.n)) AS total FROM c), r AS (SELECT doc_id, best.name AS name, CASE WHEN total > 0 THEN best.n / total ELSE 0.0 END AS share FROM s)
SELECT doc_id, CASE WHEN share >= 0.7 THEN name ELSE 'en' END AS language, CAST(round(CASE WHEN share >= 0.7 THEN share ELSE 0.0 END, 6) AS DOUBLE) AS confidence FROM r""")
def language_detect(spark, sf):
    return T.documents(spark, sf).select("doc_id", text.language(F.concat_ws("\n", "title", "content")).alias("l")).select("doc_id", "l.language", F.round("l.confidence", 6).alias("confidence"))


@query(rf"""WITH {DOCS}, {REQUESTS}, d AS (SELECT doc_id, list_distinct(list_append(regexp_extract_all(lower(content), '{TOKEN}'), 'i')) AS d FROM docs),
a AS (SELECT query_id, list_filter(list_distinct(regexp_extract_all(lower(query), '{TOKEN}')), lambda t: regexp_matches(t, '^{_LATIN}')) AS lat FROM rq), w AS (SELECT query_id, list_distinct(list_append(lat, 'i')) AS w FROM a WHERE len(lat) > 0)
SELECT query_id, doc_id FROM w, d WHERE len(list_intersect(w, d)) = len(w)""")
def mixed_script_match(spark, sf):
    """Requests with a Cyrillic word more: documents match by its Latin form."""
    asked = T.requests(spark, sf).select("query_id", F.concat_ws(" ", "query", F.lit("и")).alias("query"))
    docs = T.documents(spark, sf).withColumn("content", F.concat_ws(" ", "content", F.lit("i")))
    return S.mixed_match(docs, asked)


# ---- lexical
@query(f"WITH {_CHAIN} SELECT query_id, doc_id, token_rank FROM tm")
def token_and_match(spark, sf):
    return S.token_matches(S.live(T.documents(spark, sf)), T.requests(spark, sf))


@query(f"WITH {_CHAIN} SELECT query_id, doc_id, similarity FROM tg")
def trigram_similarity(spark, sf):
    return S.trigram_scores(S.live(T.documents(spark, sf)), T.requests(spark, sf))


@query(f"WITH {_CHAIN} SELECT query_id, doc_id, score, rank, title, substr(content, 1, 200) AS snippet FROM lex JOIN docs USING (doc_id)")
def lexical_topk(spark, sf):
    return S.lexical_search(T.documents(spark, sf), T.requests(spark, sf))


# ---- vector
@query(f"WITH {_CHAIN} SELECT query_id, doc_id, score, rank FROM vec")
def cosine_topk(spark, sf):
    return active_vectors(spark, sf)


@query(f"WITH {_CHAIN} SELECT query_id, doc_id, score FROM vs")
def chunk_max_agg(spark, sf):
    return S.every_score(T.points(spark, sf), T.requests(spark, sf))


@query(f"""WITH {_CHAIN}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs WHERE doc_id IN (SELECT doc_id FROM docs WHERE language = 'fr'))
SELECT query_id, doc_id, score, rank FROM f WHERE rank <= 50""")
def semi_pushdown(spark, sf):
    ids = S.matching(T.documents(spark, sf), languages=("fr",)).select("doc_id")
    return S.vector_search(T.points(spark, sf), T.requests(spark, sf), pushdown_ids=ids)


@query(f"""WITH {DOCS}, c AS (SELECT tenant_id, count(*) AS total, count(*) FILTER (WHERE language = 'fr' AND price < 2000) AS matching FROM docs GROUP BY tenant_id)
SELECT tenant_id, total, matching, CASE WHEN matching >= 0.1 * total THEN 'not_selective' WHEN matching > 5000 THEN 'too_large' ELSE 'used' END AS reason FROM c""")
def pushdown_decision(spark, sf):
    price = F.try_variant_get(F.try_parse_json("attributes"), "$.price", "double")
    counted = T.documents(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if((F.col("language") == "fr") & (price < 2000)).alias("matching"))
    return counted.withColumn("reason", F.when(F.col("matching") >= 0.1 * F.col("total"), "not_selective").when(F.col("matching") > 5000, "too_large").otherwise("used"))


@query(f"WITH {POINTS} SELECT point_id, doc_id, chunk_idx FROM points WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def point_retrieve(spark, sf):
    ids = T.read(spark, sf, "documents").where("lang = 'de'").select("doc_id")
    return T.points(spark, sf).join(ids, "doc_id", "left_semi").select("point_id", "doc_id", "chunk_idx")


@query(f"WITH {POINTS} SELECT point_id, round(sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS length, true AS finite FROM points")
def vector_validity(spark, sf):
    return T.points(spark, sf).select("point_id", F.round(vectors.norm(F.col("vector")), 6).alias("length"), vectors.finite(F.col("vector")).alias("finite"))


# ---- fusion and ranking
@query(f"WITH {_CHAIN} SELECT query_id, doc_id, score, lexical_rank, vector_rank, rank FROM rrf")
def rrf_fusion(spark, sf):
    _, _, lex, vec = channels(spark, sf)
    return S.rrf(lex, vec)


_MM = "CASE WHEN count(*) OVER w = 1 THEN 1.0 WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_WEIGHTED = f"""ln AS (SELECT query_id, doc_id, {_MM} AS s FROM lex WINDOW w AS (PARTITION BY query_id)), vn AS (SELECT query_id, doc_id, {_MM} AS s FROM vec WINDOW w AS (PARTITION BY query_id)),
wf AS (SELECT query_id, doc_id, round(0.5 * coalesce(ln.s, 0) + 0.5 * coalesce(vn.s, 0), 6) AS score FROM ln FULL JOIN vn USING (query_id, doc_id))"""


@query(f"WITH {_CHAIN}, {_WEIGHTED} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM wf")
def weighted_fusion(spark, sf):
    _, _, lex, vec = channels(spark, sf)
    return S.weighted(lex, vec)


_CAND = """cand AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ch, pos, doc_id) AS rank FROM
  (SELECT query_id, doc_id, min(ch) AS ch, min_by(pos, ch) AS pos FROM (SELECT query_id, doc_id, 0 AS ch, rank AS pos FROM lex UNION ALL SELECT query_id, doc_id, 1, rank FROM vec) GROUP BY query_id, doc_id)) WHERE rank <= 50)"""
_MOCK = "mock AS (SELECT query_id, doc_id, rank, round(1.1 - 0.1 * rank, 6) AS rerank_score FROM cand)"


@query(f"WITH {_EVERY}, {_CAND} SELECT * FROM cand")
def rerank_candidates(spark, sf):
    _, _, lex, vec = channels(spark, sf, every_vectors)
    return S.rerank_candidates(lex, vec)


@query(f"WITH {_EVERY}, {_CAND}, {_MOCK} SELECT query_id, doc_id, rank, CAST(rerank_score AS DOUBLE) AS rerank_score FROM mock")
def mock_rerank(spark, sf):
    _, _, lex, vec = channels(spark, sf, every_vectors)
    return S.mock_scores(S.rerank_candidates(lex, vec))


@query(f"""WITH {_CHAIN}, {_CAND}, {_MOCK}, m AS (SELECT rrf.query_id, rrf.doc_id, rrf.score AS fused, rerank_score, row_number() OVER (PARTITION BY rrf.query_id ORDER BY rerank_score IS NULL, rerank_score DESC, rrf.score DESC, rrf.doc_id) AS rank FROM rrf LEFT JOIN mock USING (query_id, doc_id))
SELECT query_id, doc_id, fused, CAST(rerank_score AS DOUBLE) AS rerank_score, CAST(coalesce(rerank_score, fused) AS DOUBLE) AS score, rank FROM m WHERE rank <= 10""")
def rerank_merge(spark, sf):
    _, _, lex, vec = channels(spark, sf)
    return S.apply_rerank(S.rrf(lex, vec), S.mock_scores(S.rerank_candidates(lex, vec)))


def _overlap(rows: str) -> str:
    """query_id, doc_id, rank and the plain scorer's score of such rows."""
    return f"""SELECT query_id, doc_id, x.rank AS rank, CAST(round(1 / (1 + exp(-(4 * len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{TOKEN}')), regexp_extract_all(lower(title || chr(10) || substr(content, 1, 200)), '{TOKEN}')))
  / greatest(len(list_distinct(regexp_extract_all(lower(query), '{TOKEN}'))), 1) - 2))), 6) AS DOUBLE) AS rerank_score FROM {rows} x JOIN rq USING (query_id) JOIN docs USING (doc_id)"""


_SPEC = """early AS (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 10), spec AS (SELECT * FROM early UNION ALL SELECT query_id, doc_id, rank FROM cand ANTI JOIN early USING (query_id, doc_id))"""


@query(f"WITH {_EVERY}, {_CAND}, {_SPEC} {_overlap('spec')}")
def speculative_rerank(spark, sf):
    docs, requests, lex, vec = channels(spark, sf, every_vectors)
    return S.speculative(lex, vec, lambda c: S.overlap_scores(c, requests, docs))


@query(f"""WITH {_EVERY}, c AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 6) AS b FROM rrf WHERE rank IN (1, 6) GROUP BY query_id)
SELECT query_id, CASE WHEN b IS NULL THEN false ELSE a - b < 0.005 END AS rerank FROM c""")
def cascade_gate(spark, sf):
    _, _, lex, vec = channels(spark, sf, every_vectors)
    return S.cascade_needed(S.rrf(lex, vec))


_PERS = """pf AS (SELECT query_id, query_vector AS p FROM rq WHERE query_vector IS NOT NULL),
ps AS (SELECT rrf.query_id, rrf.doc_id, round(CASE WHEN p IS NULL OR vector IS NULL THEN rrf.score ELSE 0.7 * rrf.score + 0.3 * list_cosine_similarity(CAST(p AS DOUBLE[]), CAST(vector AS DOUBLE[])) END, 6) AS score FROM rrf LEFT JOIN pf USING (query_id) LEFT JOIN dv USING (doc_id))"""


@query(f"WITH {_EVERY}, {_PERS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ps")
def personalize_scores(spark, sf):
    _, _, lex, vec = channels(spark, sf, every_vectors)
    return S.personalize(S.rrf(lex, vec), profiles(spark, sf), doc_vectors(spark, sf))


@query()
def mmr(spark, sf):
    _, _, lex, vec = channels(spark, sf)
    return S.mmr(S.rrf(lex, vec), doc_vectors(spark, sf))


@query(f"""WITH {_EVERY}, h AS (SELECT query_id, doc_id, vector FROM vec JOIN dv USING (doc_id) WHERE rank <= 10),
n AS (SELECT a.query_id, a.doc_id, max(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))) AS c FROM h a JOIN h b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id GROUP BY ALL)
SELECT query_id, round(avg(1 - coalesce(c, 0)), 6) AS diversity FROM h LEFT JOIN n USING (query_id, doc_id) GROUP BY query_id""")
def diversity_score(spark, sf):
    return S.diversity_scores(every_vectors(spark, sf), doc_vectors(spark, sf))


@query(f"""WITH {REQUESTS}, s AS (SELECT source AS tenant_id, count(*) AS doc_count FROM documents GROUP BY source),
b AS (SELECT query_id, CASE WHEN doc_count IS NULL THEN 50 WHEN doc_count < 10000 THEN 30 WHEN doc_count > 1000000 THEN 100 ELSE 50 END AS base, len(query) AS n FROM rq LEFT JOIN s USING (tenant_id))
SELECT query_id, CAST(greatest(10, least(200, base + CASE WHEN n < 5 THEN 20 WHEN n > 20 THEN -10 ELSE 0 END)) AS INT) AS k_lexical, CAST(greatest(10, least(200, base + CASE WHEN n < 5 THEN -10 WHEN n > 20 THEN 20 ELSE 0 END)) AS INT) AS k_vector FROM b""")
def adaptive_k(spark, sf):
    counts = T.documents(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("doc_count"))
    lexical, vector = stats.adaptive_k(F.col("doc_count"), F.col("query"))
    return T.requests(spark, sf).join(counts, "tenant_id", "left").select("query_id", lexical.alias("k_lexical"), vector.alias("k_vector"))


@query(f"""WITH {_CHAIN} SELECT r.query_id, r.rank, r.doc_id, r.score, title, substr(content, 1, 200) AS snippet, l.rank AS lexical_rank, l.score AS lexical_score, v.rank AS vector_rank, v.score AS vector_score
FROM rrf r LEFT JOIN lex l USING (query_id, doc_id) LEFT JOIN vec v USING (query_id, doc_id) JOIN docs USING (doc_id) WHERE r.rank <= 10""")
def search_explain(spark, sf):
    docs, _, lex, vec = channels(spark, sf)
    return S.assemble(S.rrf(lex, vec).where("rank <= 10").select("query_id", "doc_id", "score", "rank"), lex, vec, docs)


@query(f"WITH {REQUESTS} SELECT query_id, query_vector IS NULL AS degraded FROM rq")
def degraded_flags(spark, sf):
    off = F.lit(False)
    return S.degraded(T.requests(spark, sf).select("query_id", F.col("query_vector").isNull().alias("vector_error"), off.alias("vector_disabled"), off.alias("vector_unhealthy"), off.alias("partial"), off.alias("lexical_error")))


@query()
def hybrid_search(spark, sf):
    """The whole read path: channels, fusion, personalisation, rerank and cut, diversity, text."""
    docs, requests, lex, vec = channels(spark, sf)
    personal = S.personalize(S.rrf(lex, vec), profiles(spark, sf), doc_vectors(spark, sf))
    cut = S.apply_rerank(personal, S.overlap_scores(S.rerank_candidates(lex, vec), requests, docs))
    diverse = S.mmr(cut, doc_vectors(spark, sf), top_k=10)
    return S.assemble(diverse.select("query_id", "doc_id", "score", "rank"), lex, vec, docs)


# ---- facets
_TOP = "SELECT query_id, field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY n DESC, value) AS r FROM {}) WHERE r <= 20"
_TAGS = "ft AS (SELECT query_id, 'tags' AS field, value, count(*) AS n FROM (SELECT query_id, unnest(tags) AS value FROM rrf JOIN docs USING (doc_id) WHERE rrf.rank <= 20 AND deleted_at IS NULL) GROUP BY ALL)"
_CATS = "fc AS (SELECT query_id, 'category' AS field, category AS value, count(*) AS n FROM rrf JOIN docs USING (doc_id) WHERE rrf.rank <= 20 AND deleted_at IS NULL GROUP BY ALL)"


@query(f"WITH {_EVERY}, {_TAGS} " + _TOP.format("ft"))
def facet_tags(spark, sf):
    docs, _, lex, vec = channels(spark, sf, every_vectors)
    return S.tag_facets(S.rrf(lex, vec).where("rank <= 20"), docs)


@query(f"WITH {_CHAIN}, {_CATS} " + _TOP.format("fc"))
def facet_category(spark, sf):
    docs, _, lex, vec = channels(spark, sf)
    return S.category_facets(S.rrf(lex, vec).where("rank <= 20"), docs)


@query(f"WITH {_CHAIN}, {_TAGS}, {_CATS} " + _TOP.format("(SELECT * FROM ft UNION ALL SELECT * FROM fc)"))
def facet_incremental(spark, sf):
    """Buckets of the first ten hits, merged with those of the next ten: the same as counting twenty."""
    docs, _, lex, vec = channels(spark, sf)
    fused, fields = S.rrf(lex, vec), ["tags", "category", "unknown"]
    return S.merge_facets(S.facets(fused.where("rank <= 10"), docs, fields, 1000), S.facets(fused.where("rank between 11 and 20"), docs, fields, 1000))
