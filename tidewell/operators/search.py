"""Search over a batch of requests: every operator is keyed by query_id, so one job answers all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions import vectors as V
from tidewell.sources.scratch import stored

SNIPPET, MATCH_SIMILARITY, RANK_WEIGHT, SIMILARITY_WEIGHT = 200, 0.3, 0.7, 0.3
MOST_K, RRF_K, RERANK_K = 200, 60, 50
#: Rows up to which a side is sent to every task; larger sides are joined by shuffle.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where a count of it stays under the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(hits: DataFrame, k: Column | int, *order: Column) -> DataFrame:
    """The first k rows of each request in this order, with rank. The constant bound lets Spark cut before the sort."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_K).where(F.col("rank") <= k)


def live(docs: DataFrame) -> DataFrame:
    return docs.where("deleted_at is null")


def matching(docs: DataFrame, tenant: str | None = None, languages=(), tags_any=(), category: str | None = None, price_min=None, price_max=None, created_after=None) -> DataFrame:
    """The filters that both channels share; an empty list means no filter, bounds are inclusive."""
    if tenant is not None:
        docs = docs.where(F.col("tenant_id") == tenant)
    if languages:
        docs = docs.where(F.col("language").isin(*languages))
    if tags_any:
        docs = docs.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags_any))))
    parsed = F.try_parse_json("attributes")
    if category is not None:
        docs = docs.where(F.try_variant_get(parsed, "$.category", "string") == str(category))
    price = F.try_variant_get(parsed, "$.price", "double")
    if price_min is not None:
        docs = docs.where(price >= price_min)
    if price_max is not None:
        docs = docs.where(price <= price_max)
    if created_after is not None:
        docs = docs.where(F.col("created_at") >= F.lit(created_after).cast("timestamp_ntz"))
    return docs


def selective(languages=(), tags_any=(), attributes=None, created_after=None) -> bool:
    return bool(languages or tags_any or attributes or created_after)


def pushdown_decision(total: int, matching_rows: int, enabled: bool = True, has_filters: bool = True, share: float = 0.1, most: int = 5000) -> str:
    """Why the ids of matching documents are or aren't handed to the vector channel."""
    if not enabled:
        return "disabled"
    if not has_filters:
        return "no_filters"
    if total and matching_rows / total >= share:
        return "not_selective"
    return "too_large" if matching_rows > most else "used"


def pushdown_cap(k_lexical: int, base_k: int = 50, most: int = 5000) -> int:
    return max(k_lexical, int(most * k_lexical / base_k))


# ---- lexical channel


def token_matches(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, doc_id, n_tokens, matched occurrences per token saturated: documents of the tenant that hold every token.

    An inverted join on (tenant, token): a document's wanted tokens are counted once and lie in its row. A request meets
    documents on its rarest token and looks up the others there, so pairs are neither gathered nor shuffled.
    """
    return _on_rarest(*_held(docs, requests))


def _held(docs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tenant_id, doc_id, held: a document's wanted tokens with their counts; query_id, tenant_id, wanted of the requests."""
    wanted = requests.select("query_id", "tenant_id", F.array_distinct(X.tokens(F.col("query"))).alias("wanted"))
    each = wanted.select("query_id", "tenant_id", "wanted", F.explode("wanted").alias("token"))
    words = docs.select("tenant_id", "doc_id", F.explode(X.tokens(F.col("content"))).alias("token"))
    needed = each.select("tenant_id", "token").distinct()
    counted = words.join(small(needed, TOKEN_ROWS), ["tenant_id", "token"]).groupBy("tenant_id", "doc_id", "token").agg(F.count("*").alias("tf"))
    return stored(counted.groupBy("tenant_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "tf"))).alias("held"))), wanted


def _on_rarest(held: DataFrame, wanted: DataFrame) -> DataFrame:
    each = wanted.withColumn("token", F.explode("wanted"))
    spread = held.select("tenant_id", F.explode(F.map_keys("held")).alias("token")).groupBy("tenant_id", "token").agg(F.count("*").alias("n"))
    # A token that no document has is left out: its request matches nothing, wherever it meets documents.
    rarest = each.join(spread, ["tenant_id", "token"]).groupBy("query_id", "tenant_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("wanted").alias("wanted"))
    met = held.select("tenant_id", "doc_id", "held", F.explode(F.map_keys("held")).alias("token")).join(small(rarest), ["tenant_id", "token"])
    return _token_rank(met)


def _token_rank(met: DataFrame) -> DataFrame:
    tf = F.transform("wanted", lambda t: F.try_element_at("held", t))
    full = met.select("query_id", "doc_id", tf.alias("tf")).where(F.forall("tf", lambda x: x.isNotNull()))
    saturated = F.aggregate("tf", F.lit(0.0), lambda total, x: total + x / (x + 1.0))
    return full.select("query_id", "doc_id", F.round(saturated / F.size("tf"), 6).alias("token_rank"))


def short_trigrams(docs: DataFrame, limit: int) -> DataFrame:
    """tenant_id, doc_id, d: the trigrams of title and content, null where there are more than the limit."""
    text = lambda content: F.concat_ws(" ", "title", content)
    # As a value and not as a filter: filters on `d` would be pushed down and work it out again.
    # Four characters a trigram: texts repeat theirs, and with two nearly every beginning passed and the whole was cut too.
    short = F.size(X.trigrams(text(F.substring("content", 1, 4 * limit)))) <= limit + 1
    whole = V.let(F.when(short, X.trigrams(text(F.col("content")))), lambda d: F.when(F.size(d) <= limit, d))
    return docs.select("tenant_id", "doc_id", whole.alias("d"))


def trigram_scores(docs: DataFrame, requests: DataFrame, above: float = MATCH_SIMILARITY) -> DataFrame:
    """query_id, doc_id, similarity: pairs of the tenant over the bound.

    Shared trigrams can't exceed the request's, so a document with many more can't match. A text has no fewer trigrams
    than its beginning (but for the word that the cut breaks), so long documents drop out on a beginning of a few words;
    the sets of the rest meet those of the requests in cells, as matrices. Pairs aren't shuffled, but for those that match.
    """
    asked = stored(requests.where("tenant_id is not null").select("query_id", "tenant_id", X.trigrams(F.col("query")).alias("d")).where("d is not null"))
    sizes = asked.agg(F.max(F.size("d")).alias("most"), F.count("*").alias("n")).first()
    limit = int((sizes.most or 0) / above) + 1
    # Behind explode, as a filter on `d` would cut the texts again.
    offered = short_trigrams(docs, limit).select("tenant_id", "doc_id", F.explode(F.array("d")).alias("d")).where("tenant_id is not null and size(d) > 0")
    tasks, parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-sizes.n // REQUEST_ROWS))
    shards = max(1, -(-tasks // parts))
    kinds = dict(requests.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("role"), "tenant_id", "query_id", F.lit(None).cast(kinds[1]).alias("doc_id"), "d")
    right = offered.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("role"), "tenant_id", F.lit(None).cast(kinds[0]).alias("query_id"), "doc_id", "d")
    dealt = left.unionByName(right).repartition(max(tasks, min(parts * shards, 100_000)), "part", "shard").sortWithinPartitions("part", "shard", "role", "tenant_id")
    shared = _shared(dealt, above, f"query_id {kinds[0]}, doc_id {kinds[1]}, n long, nq long, nd long")
    return shared.select("query_id", "doc_id", F.round(F.col("n") / (F.col("nq") + F.col("nd") - F.col("n")), 6).alias("similarity")).where(F.col("similarity") > above)


def _shared(dealt: DataFrame, above: float, schema: str) -> DataFrame:
    """query_id, doc_id, n shared of nq and nd, at some more than the bound, of rows of part, shard, role, tenant_id,
    query_id, doc_id, d that lie together by (part, shard): the cell's requests (role 0), then its documents by tenant."""

    def run(batches):
        key, cell = None, {}
        for batch in batches:
            part, shard, role = (np.asarray(batch.column(i)) for i in range(3))
            tenants = batch.column(3).to_pylist()
            cuts = [i for i in range(len(part)) if not i or (part[i], shard[i], role[i], tenants[i]) != (part[i - 1], shard[i - 1], role[i - 1], tenants[i - 1])]
            for low, high in zip(cuts, [*cuts[1:], len(part)]):
                if (part[low], shard[low]) != key:
                    key, cell = (part[low], shard[low]), {}
                lists = batch.column(6).slice(low, high - low)
                if not role[low]:
                    cell.setdefault(tenants[low], Sets(above)).ask(batch.column(4).slice(low, high - low), lists)
                elif tenants[low] in cell:
                    yield from cell[tenants[low]].matches(batch.column(5).slice(low, high - low), lists)

    return dealt.mapInArrow(run, schema)


#: Numbers of a matrix of sets, and documents that meet requests at a time.
SET_CELLS, SET_ROWS = 4_000_000, 1024


class Sets:
    """The sets of a tenant's requests, as matrices of ones, in blocks of about SET_CELLS numbers."""

    def __init__(self, above: float):
        self.above, self.asked, self.blocks = above, [], None

    def ask(self, ids: pa.Array, lists: pa.Array) -> None:
        self.asked.append((ids, lists))

    @staticmethod
    def _ones(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the sets, and their matrix over these terms."""
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        codes = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1))
        rows = np.repeat(np.arange(len(lists)), sizes)
        out = np.zeros((len(lists), len(terms)), np.float32)
        out[rows[codes >= 0], codes[codes >= 0]] = 1
        return sizes, out

    def _prepare(self) -> None:
        ids, lists = (pa.concat_arrays([a[i] for a in self.asked]) for i in (0, 1))
        ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
        self.blocks, low = [], 0
        while low < len(lists):
            high = low + 1
            # Rows times terms stay under the bound, or the block has one request.
            while high < min(len(lists), low + SET_ROWS) and (high + 1 - low) * (ends[high] - (ends[low - 1] if low else 0)) <= 4 * SET_CELLS:
                high += 1
            some = lists.slice(low, high - low)
            terms = some.flatten().unique()
            if len(terms):
                self.blocks.append((ids.slice(low, high - low), terms, *self._ones(some, terms)))
            low = high

    def matches(self, docs: pa.Array, lists: pa.Array):
        if self.blocks is None:
            self._prepare()
        for ids, terms, nq, asked in self.blocks:
            step = max(1, min(SET_ROWS, SET_CELLS // len(terms)))
            for at in range(0, len(docs), step):
                nd, held = self._ones(lists.slice(at, step), terms)
                n = held @ asked.T  # whole numbers, exact
                # A little under the bound, as the similarity is rounded later on.
                doc, request = np.nonzero(n > (self.above - 1e-5) * (nd[:, None] + nq[None] - n))
                if len(doc):
                    columns = [ids.take(pa.array(request)), docs.slice(at, step).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (n[doc, request], nq[request], nd[doc]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "n", "nq", "nd"])


def lexical_search(docs: DataFrame, requests: DataFrame, k: Column | int = 50) -> DataFrame:
    """query_id, doc_id, score, rank, title, snippet: token or trigram matches by the blend of both scores."""
    # Written once: requests may be cut from large texts, and several steps count and join them.
    docs, requests = live(docs), stored(requests.select("query_id", "tenant_id", "query"))
    docs = docs.join(small(requests.select("tenant_id").distinct()), "tenant_id", "left_semi")  # the others match nothing
    (held, wanted), similar = _held(docs, requests), stored(trigram_scores(docs, requests))
    # What has no similarity is scored by its tokens alone, so each task cuts to its best before pairs are shuffled. What has
    # one is looked up by itself. A document that k others precede by tokens alone, they precede in the end too.
    alone = F.round(RANK_WEIGHT * F.col("token_rank"), 6)
    best = ranked(_on_rarest(held, wanted).withColumn("alone", alone), k if isinstance(k, int) else MOST_K, F.desc("alone"), F.col("doc_id"))
    beside = similar.select("query_id", "doc_id").join(wanted.where("size(wanted) > 0"), "query_id").join(held, ["tenant_id", "doc_id"])
    tokens = best.select("query_id", "doc_id", "token_rank").unionByName(_token_rank(beside)).distinct()
    both = tokens.join(similar, ["query_id", "doc_id"], "full")
    score = F.round(RANK_WEIGHT * F.coalesce("token_rank", F.lit(0.0)) + SIMILARITY_WEIGHT * F.coalesce("similarity", F.lit(0.0)), 6)
    top = ranked(both.select("query_id", "doc_id", score.alias("score")), k, F.desc("score"), F.col("doc_id"))
    return top.join(docs.select("doc_id", "title", F.substring("content", 1, SNIPPET).alias("snippet")), "doc_id").select("query_id", "doc_id", "score", "rank", "title", "snippet")


def mixed_match(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id where a query of two scripts matches as it is or with either script written in the other."""
    parts = queries.select("query_id", X.tokens(F.col("query")).alias("t"))
    of = lambda name: F.filter("t", lambda w: X.script(w) == name)
    parts = parts.select("query_id", of("latin").alias("lat"), of("cyrillic").alias("cyr"))
    forms = F.array(
        F.concat("lat", "cyr"), F.concat(F.transform("lat", X.to_cyrillic), F.col("cyr")), F.concat("lat", F.transform("cyr", X.to_latin))
    )
    sets = F.transform(forms, lambda t: F.array_sort(F.array_distinct(t)))
    # Requests of the same forms match the same documents, so they are looked up as one.
    alike = parts.where("size(lat) > 0 and size(cyr) > 0").select("query_id", sets.alias("forms")).groupBy("forms").agg(F.collect_list(F.struct("query_id")).alias("q"))
    asked = stored(alike.select("forms", F.explode(F.expr(f"transform(sequence(0, size(q) - 1, {ALIKE}), i -> slice(q, i + 1, {ALIKE}))")).alias("queries")))
    needed = asked.select(F.explode(F.flatten("forms")).alias("token")).distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("token"))
    held = words.join(small(needed, TOKEN_ROWS), "token", "left_semi").groupBy("doc_id").agg(F.collect_set("token").alias("held"))
    rows, sizes = docs.count(), asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("queries")), F.lit(0)).alias("queries")).first()
    parts = max(1, -(-sizes.n // FORM_ROWS))
    shards = max(1, min(-(-rows * sizes.queries // (parts * MATCH_PAIRS)), 100_000 // parts))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(docs.dtypes)["doc_id"], dict(queries.dtypes)["query_id"]
    null = lambda kind: F.lit(None).cast(kind)
    left = asked.select(F.pmod(F.xxhash64("forms", "queries"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("role"), null(kinds[0]).alias("doc_id"), null("array<string>").alias("held"), "forms", "queries")
    right = held.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("role"), "doc_id", "held", null("array<array<string>>").alias("forms"), null(f"array<struct<query_id:{kinds[1]}>>").alias("queries"))
    dealt = left.unionByName(right).repartition(max(tasks, min(parts * shards, 100_000)), "part", "shard").sortWithinPartitions("part", "shard", "role")
    return _form_matches(dealt, f"query_id {kinds[1]}, doc_id {kinds[0]}")


#: Requests that are looked up as one, at most; different ones that a task holds; pairs of a request and a document that a
#: cell has; needed tokens that are sent to every task.
ALIKE, FORM_ROWS, MATCH_PAIRS, TOKEN_ROWS = 4096, 16_384, 32_000_000, 200_000
#: Documents and requests that meet at a time, and rows of a batch that is handed on.
DOC_BLOCK, FORM_BLOCK, OUT_ROWS = 1024, 2048, 262_144


def _form_matches(dealt: DataFrame, schema: str) -> DataFrame:
    """query_id, doc_id of rows of part, shard, role, doc_id, held, forms, queries that lie together by (part, shard): the
    cell's requests (role 0), then its documents (role 1). A pair comes once, whichever forms match."""

    def run(batches):
        key, cell = None, None
        for batch in batches:
            part, shard, role = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(shard) != 0) | (np.diff(role) != 0)]) if len(part) else []
            for low, high in zip(cuts, np.r_[cuts[1:], len(part)].astype(int)):
                if (part[low], shard[low]) != key:
                    key, cell = (part[low], shard[low]), Forms()
                if role[low]:
                    for at in range(low, high, DOC_BLOCK):
                        n = min(DOC_BLOCK, high - at)
                        yield from cell.matches(batch.column(3).slice(at, n), batch.column(4).slice(at, n))
                else:
                    cell.ask(batch.column(5).slice(low, high - low), batch.column(6).slice(low, high - low))

    return dealt.mapInArrow(run, schema)


class Forms:
    """Requests as sets of tokens, any of which may match. A token is a row of bits, one a document: those of a form's
    tokens are put together by and, those of a request's forms by or."""

    def __init__(self):
        self.asked, self.tokens, self.blocks = [], None, []

    def ask(self, forms: pa.Array, queries: pa.Array) -> None:
        self.asked.append((forms, queries))

    def _prepare(self) -> None:
        forms, queries = (pa.concat_arrays([a[i] for a in self.asked]) for i in (0, 1)) if self.asked else (None, None)
        if forms is None:
            self.tokens = pa.array([], pa.string())
            return
        words = forms.flatten().flatten().dictionary_encode()
        self.tokens, codes = words.dictionary, np.asarray(words.indices)
        width = len(forms[0])
        lengths = np.asarray(pc.list_value_length(forms.flatten())).reshape(-1, width)
        starts = (np.cumsum(lengths) - lengths.ravel()).reshape(-1, width)
        counts = np.asarray(pc.list_value_length(queries))
        firsts = np.cumsum(counts) - counts
        self.ids = queries.flatten().field(0)
        order = np.argsort(lengths.max(axis=1), kind="stable")  # those of a block have much the same number of tokens
        for at in range(0, len(order), FORM_BLOCK):
            rows = order[at : at + FORM_BLOCK]
            places = np.arange(lengths[rows].max())
            there = places < lengths[rows][..., None]
            # What a form doesn't have is a row of ones.
            index = np.where(there, codes[np.minimum(starts[rows][..., None] + places, len(codes) - 1)], len(self.tokens))
            self.blocks.append((index, counts[rows], firsts[rows]))

    def matches(self, docs: pa.Array, held: pa.Array):
        if self.tokens is None:
            self._prepare()
        codes = np.asarray(pc.fill_null(pc.index_in(held.flatten(), value_set=self.tokens), -1))
        rows = np.repeat(np.arange(len(docs)), np.asarray(pc.list_value_length(held)))
        grid = np.zeros((len(self.tokens) + 1, -(-len(docs) // 64) * 64), np.bool_)
        grid[codes[codes >= 0], rows[codes >= 0]] = True
        grid[-1] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        for index, counts, firsts in self.blocks:
            found = bits[index[:, :, 0]]
            for i in range(1, index.shape[2]):
                found &= bits[index[:, :, i]]
            found = np.bitwise_or.reduce(found, axis=1)
            some = np.flatnonzero(found.any(axis=1))
            request, doc = np.nonzero(np.unpackbits(found[some].view(np.uint8), axis=1, count=len(docs)))
            request = some[request]
            ends = np.cumsum(counts[request])
            low = 0
            while low < len(ends):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + OUT_ROWS, "right")))
                n, first = counts[request[low:high]], firsts[request[low:high]]
                at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(at)), docs.take(pa.array(np.repeat(doc[low:high], n)))], names=["query_id", "doc_id"])
                low = high


# ---- vector channel


def vector_search(points: DataFrame, requests: DataFrame, docs: DataFrame | None = None, k: Column | int = 50, pushdown_ids: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: exact cosine against all points, the best chunk of a document, scaled to 0..1.

    Points are cut to live documents, handed ids and active models first. The requests are the stated query set: they
    meet shards of documents, each shard giving its MOST_K best a request for the final ranking. Zero vectors score as
    a cosine of 0; points with null or non-finite components and those of another length than the request are left out.
    """
    asked = stored(requests.where("query_vector is not null").select("query_id", "query_vector"))
    rows = points.count()  # what filters leave is fewer; shards are sized by this
    offered = points.where(V.finite(F.col("vector")))
    if models is not None:
        offered = offered.join(small(models.where("is_active").select("model_name")), "model_name", "left_semi")
    offered = offered.select("doc_id", "vector")
    if pushdown_ids is not None:
        offered = offered.join(pushdown_ids.select("doc_id"), "doc_id", "left_semi")
    if docs is not None:
        offered = offered.join(live(docs).select("doc_id"), "doc_id", "left_semi")
    scored = best_of_shards(offered, asked, min(k, MOST_K) if isinstance(k, int) else MOST_K, rows)
    return ranked(scored, k, F.desc("score"), F.col("doc_id"))


#: Requests that a task holds at most, and points of a shard from which on another shard is worth it.
REQUEST_ROWS, SHARD_ROWS = 4096, 20_000
#: Requests that are scored at a time.
REQUEST_BLOCK = 256


def best_of_shards(offered: DataFrame, asked: DataFrame, most: int, rows: int) -> DataFrame:
    """query_id, doc_id, score: of each shard of documents the `most` best for each request. All chunks of a document
    are in one shard. A point is copied once for every REQUEST_ROWS requests, a request once for every shard. rows: how
    many points there are at most."""
    spark = offered.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-asked.count() // REQUEST_ROWS))
    shards = max(1, min(-(-tasks // parts), -(-rows // SHARD_ROWS)))
    vector = lambda c: F.transform(c, lambda x: x.cast("double"))
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("role"), F.col("query_id").alias("id"), vector("query_vector").alias("v"))
    right = offered.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("role"), F.col("doc_id").alias("id"), vector("vector").alias("v"))
    dealt = left.unionByName(right).repartition(max(tasks, min(parts * shards, 100_000)), "part", "shard").sortWithinPartitions("part", "shard", "role", "id")
    return best_of_cells(dealt, most)


def best_of_cells(dealt: DataFrame, most: int) -> DataFrame:
    """query_id, doc_id, score of rows of part, shard, role, id, v that lie together by (part, shard), sorted by role and
    id: for each cell's requests (role 0) the `most` best of its documents (role 1). A sixth column, if there is one, is
    the score under which a request takes nothing."""

    def run(batches):
        key, best = None, None
        for batch in batches:
            part, shard, role, ids = (np.asarray(batch.column(i)) for i in range(4))
            cuts = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(shard) != 0) | (np.diff(role) != 0)]) if len(ids) else []
            for low, high in zip(cuts, np.r_[cuts[1:], len(ids)].astype(int)):
                if (part[low], shard[low]) != key:
                    if best:
                        yield from best.rows()
                    key, best = (part[low], shard[low]), Best(most)
                vectors = batch.column(4).slice(low, high - low)
                if role[low]:
                    best.offer(ids[low:high], vectors)
                else:
                    floors = np.asarray(batch.column(5).slice(low, high - low)) if batch.num_columns > 5 else np.full(high - low, -np.inf)
                    best.ask(ids[low:high], vectors, floors)
        if best:
            yield from best.rows()

    return dealt.mapInArrow(run, "query_id long, doc_id long, score double")


class Best:
    """The best documents of one shard for some requests; points come in the order of their documents."""

    def __init__(self, most: int):
        self.most, self.asked, self.held = most, {}, {}

    @staticmethod
    def _units(vectors: pa.Array):
        """(rows, unit vectors as a matrix) for each length there is."""
        lengths = np.asarray(vectors.value_lengths())
        for width in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == width)
            m = np.asarray(vectors.take(pa.array(rows)).flatten()).reshape(len(rows), width)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            yield rows, width, m / np.where(n > 0, n, 1)

    def ask(self, ids: np.ndarray, vectors: pa.Array, floors: np.ndarray) -> None:
        for rows, width, m in self._units(vectors):
            self.asked.setdefault(width, []).append((ids[rows], m, floors[rows]))

    def offer(self, ids: np.ndarray, vectors: pa.Array) -> None:
        for rows, width, m in self._units(vectors):
            if width in self.asked:
                q = np.concatenate([a[1] for a in self.asked[width]])
                for at in range(0, len(rows), 4096):
                    docs = ids[rows[at : at + 4096]]
                    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
                    for part in range(0, len(q), REQUEST_BLOCK):
                        scores = np.maximum.reduceat(m[at : at + 4096] @ q[part : part + REQUEST_BLOCK].T, starts, axis=0)
                        self._keep((width, part), docs[starts], np.round((scores + 1) / 2, 6))

    def _keep(self, key: tuple[int, int], docs: np.ndarray, scores: np.ndarray) -> None:
        """The `most` best of what is held and what is new; a document that a cut parted counts by its better half."""
        docs = np.broadcast_to(docs[:, None], scores.shape)
        if len(scores) > 4 * self.most:
            # What is below the last of the best isn't sorted; ties with it stay. One more, as a document may be parted.
            last = np.partition(scores, len(scores) - self.most - 1, axis=0)[len(scores) - self.most - 1]
            rows = np.flatnonzero((scores >= last).any(axis=1))
            docs, scores = docs[rows], np.where(scores[rows] >= last, scores[rows], -np.inf)
        if key in self.held:
            old, had = self.held[key]
            docs, scores = np.concatenate([old, docs]), np.concatenate([had, scores])
        order = np.lexsort((-scores, docs), axis=0)
        docs, scores = np.take_along_axis(docs, order, 0), np.take_along_axis(scores, order, 0)
        scores[1:][docs[1:] == docs[:-1]] = -np.inf
        order = np.lexsort((docs, -scores), axis=0)[: self.most]
        self.held[key] = np.take_along_axis(docs, order, 0), np.take_along_axis(scores, order, 0)

    def rows(self):
        for (width, part), (docs, scores) in self.held.items():
            ids = np.broadcast_to(np.concatenate([a[0] for a in self.asked[width]])[None, part : part + REQUEST_BLOCK], docs.shape)
            floors = np.concatenate([a[2] for a in self.asked[width]])[None, part : part + REQUEST_BLOCK]
            there = (scores > -np.inf) & (scores >= floors)
            yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(docs[there]), pa.array(scores[there])], names=["query_id", "doc_id", "score"])


def grid(offered: DataFrame, asked: DataFrame, side: int | None = None) -> DataFrame:
    """Every asked row beside every offered row, as an equi-join over side * side cells, for a stated query set whose
    pairs are themselves the result. The cells are some twice the session's partitions unless given."""
    side = side or max(2, int((2 * int(offered.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5))
    left = offered.withColumn("_x", F.pmod(F.hash("doc_id"), F.lit(side))).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    right = asked.withColumn("_y", F.pmod(F.hash("query_id"), F.lit(side))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return left.join(right, ["_x", "_y"]).drop("_x", "_y")


#: Pairs of a request and a point that a cell of `every_score` has at most, and rows of a block that is scored at a time.
CELL_PAIRS, BLOCK = 8_000_000, 256


def every_score(points: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, doc_id, score: every document's best chunk for every request, cosines scaled to 0..1; all pairs are the
    result. Cells of requests and documents meet as matrices, and products are summed in the order of the components.

    Vectors with null or non-finite components or of another length than most requests' take the same way as columns.
    """
    offered, asked = points.select("doc_id", "vector"), stored(requests.where("query_vector is not null").select("query_id", "query_vector"))
    width = asked.agg(F.mode(F.size("query_vector"), True)).first()[0]
    if width is None:
        return offered.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    plain = lambda c: F.coalesce((F.size(c) == width) & V.finite(F.col(c)), F.lit(False))
    odd_docs, odd_asked = stored(offered.where(~plain("vector")).select("doc_id").distinct()), asked.where(~plain("query_vector"))
    some, others = not odd_docs.isEmpty(), not odd_asked.isEmpty()
    even, even_asked = offered.join(odd_docs, "doc_id", "left_anti") if some else offered, asked.where(plain("query_vector"))
    out = _met(even, even_asked, width)
    by_columns = lambda left, right: grid(left, right).select("query_id", "doc_id", V.cosine(F.col("vector"), F.col("query_vector")).alias("c")).groupBy("query_id", "doc_id").agg(F.max("c").alias("c")).select("query_id", "doc_id", F.round((F.col("c") + 1) / 2, 6).alias("score"))
    if some:
        out = out.unionByName(by_columns(offered.join(odd_docs, "doc_id", "left_semi"), asked))
    return out.unionByName(by_columns(even, odd_asked)) if others else out


def _met(offered: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    rows, n = offered.count(), asked.count()
    parts = max(1, -(-n // REQUEST_ROWS))
    shards = max(1, min(-(-rows * max(1, n // parts) // CELL_PAIRS), 100_000 // parts))
    tasks = int(offered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vector = lambda c: F.transform(c, lambda x: x.cast("double"))
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("role"), F.col("query_id").alias("id"), vector("query_vector").alias("v"))
    right = offered.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("role"), F.col("doc_id").alias("id"), vector("vector").alias("v"))
    dealt = left.unionByName(right).repartition(max(tasks, parts * shards), "part", "shard").sortWithinPartitions("part", "shard", "role", "id")

    def lengths(m):
        return np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) if m.shape[1] else np.zeros(len(m))

    def scored(asked_, docs, m):
        """Batches of all pairs of whole documents with the requests."""
        ids, q = (np.concatenate(a) for a in zip(*asked_))
        starts, mn, qn = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]), lengths(m), lengths(q)
        for at in range(0, len(q), BLOCK):
            some, total = q[at : at + BLOCK], np.zeros((len(m), min(BLOCK, len(q) - at)))
            for i in range(width):
                total += m[:, i, None] * some[None, :, i]
            both = mn[:, None] * qn[None, at : at + BLOCK]
            scaled = (np.maximum.reduceat(np.divide(total, both, out=np.zeros_like(total), where=both > 0), starts, axis=0) + 1) / 2 * 1e6
            whole = np.floor(scaled)
            score = (whole + (scaled - whole >= 0.5)) / 1e6  # half away from zero
            here = ids[at : at + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(here, len(starts))), pa.array(np.repeat(docs[starts], len(here))), pa.array(score.reshape(-1))], names=["query_id", "doc_id", "score"])

    def run(batches):
        key, asked_, docs, m = None, [], np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            part, shard, role, ids = (np.asarray(batch.column(i)) for i in range(4))
            cuts = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(shard) != 0) | (np.diff(role) != 0)]) if len(ids) else []
            for low, high in zip(cuts, np.r_[cuts[1:], len(ids)].astype(int)):
                if (part[low], shard[low]) != key:
                    if asked_ and len(docs):
                        yield from scored(asked_, docs, m)
                    key, asked_, docs, m = (part[low], shard[low]), [], docs[:0], m[:0]
                rows_ = np.asarray(batch.column(4).slice(low, high - low).flatten()).reshape(high - low, width)
                if not role[low]:
                    asked_.append((ids[low:high], rows_))
                elif asked_:
                    docs, m = np.r_[docs, ids[low:high]], np.concatenate([m, rows_])
                    # The last document may go on in what comes next.
                    while len(docs) > BLOCK and (end := int(np.searchsorted(docs, docs[BLOCK]))) and end < len(docs):
                        yield from scored(asked_, docs[:end], m[:end])
                        docs, m = docs[end:], m[end:]
                        if docs[0] == docs[-1]:
                            break
        if asked_ and len(docs):
            yield from scored(asked_, docs, m)

    return dealt.mapInArrow(run, "query_id long, doc_id long, score double")


# ---- fusion


def rrf(lexical: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks summed; ties by lexical rank, vector rank, id."""
    both = lexical.select("query_id", "doc_id", "rank", F.lit(0).alias("channel")).unionByName(vector.select("query_id", "doc_id", "rank", F.lit(1).alias("channel")))
    fused = both.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.when(F.col("channel") == 0, F.col("rank"))).alias("lexical_rank"), F.min(F.when(F.col("channel") == 1, F.col("rank"))).alias("vector_rank")
    )
    return ranked(fused, MOST_K, F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), F.col("doc_id"))


def min_max(hits: DataFrame, single: float = 1.0, flat: float = 0.0) -> DataFrame:
    """Scores to 0..1 within a request; a lone hit gets `single`, equal scores `flat`."""
    w = Window.partitionBy("query_id")
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    return hits.withColumn("scaled", F.when(n == 1, F.lit(single)).when(high == low, F.lit(flat)).otherwise((F.col("score") - low) / (high - low)))


def weighted(lexical: DataFrame, vector: DataFrame, alpha: float = 0.5) -> DataFrame:
    one = min_max(lexical).select("query_id", "doc_id", F.col("scaled").alias("l"))
    two = min_max(vector).select("query_id", "doc_id", F.col("scaled").alias("v"))
    fused = one.join(two, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.round(alpha * F.coalesce("l", F.lit(0.0)) + (1 - alpha) * F.coalesce("v", F.lit(0.0)), 6).alias("score"))
    return ranked(fused, MOST_K, F.desc("score"), F.col("doc_id"))


def fuse(lexical: DataFrame, vector: DataFrame, strategy: str = "rrf", alpha: float = 0.5, weighted_enabled: bool = True) -> DataFrame:
    if strategy == "weighted" and weighted_enabled:
        return weighted(lexical, vector, alpha)
    return rrf(lexical, vector).select("query_id", "doc_id", "score", "rank")


# ---- rerank, personalisation, diversity


def rerank_candidates(lexical: DataFrame, vector: DataFrame, k: int = RERANK_K) -> DataFrame:
    """Lexical hits, then vector hits not among them; the first k. Not the order of fusion."""
    both = lexical.select("query_id", "doc_id", F.lit(0).alias("channel"), "rank").unionByName(vector.select("query_id", "doc_id", F.lit(1).alias("channel"), "rank"))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("channel", F.col("rank").alias("at"))).alias("place"))
    return ranked(first, k, F.col("place.channel"), F.col("place.at"), F.col("doc_id")).select("query_id", "doc_id", "rank")


def mock_scores(candidates: DataFrame) -> DataFrame:
    """1.0, 0.9, 0.8 ... by rank: the stand-in for a model."""
    return candidates.select("query_id", "doc_id", "rank", F.round(F.lit(1.1) - 0.1 * F.col("rank"), 6).alias("rerank_score"))


def rerank(candidates: DataFrame, requests: DataFrame, docs: DataFrame, scorer, top_k: int | None = None) -> DataFrame:
    """query_id, doc_id, rank, rerank_score: a model's score of (query, title and snippet), through a sigmoid.

    scorer(query, text) gives a column: an expression, or a pandas UDF around a model. With top_k only the best stay.
    """
    text = F.concat_ws("\n", "title", F.substring("content", 1, SNIPPET))
    joined = candidates.join(small(requests.select("query_id", "query")), "query_id").join(docs.select("doc_id", text.alias("text")), "doc_id")
    scored = joined.select("query_id", "doc_id", "rank", F.round(1 / (1 + F.exp(-scorer(F.col("query"), F.col("text")))), 6).alias("rerank_score"))
    if top_k is None:
        return scored
    return ranked(scored.drop("rank"), top_k, F.desc("rerank_score"), F.col("doc_id")).select("query_id", "doc_id", "rank", "rerank_score")


def token_overlap(query: Column, text: Column) -> Column:
    """A plain scorer in a model's place: the share of query tokens in the text, from -2 to 2."""
    asked = F.array_distinct(X.tokens(query))
    return 4 * F.size(F.array_intersect(asked, X.tokens(text))) / F.greatest(F.size(asked), F.lit(1)) - 2


def overlap_scores(candidates: DataFrame, requests: DataFrame, docs: DataFrame) -> DataFrame:
    return rerank(candidates, requests, docs, token_overlap)


def rerank_modes(channels: DataFrame) -> DataFrame:
    """query_id, rerank_mode, rerank_degraded, partial: how a request is reranked once its channels are in."""
    blocked = ~F.col("available") | F.col("breaker_open")
    mode = F.when(~F.col("rerank"), "none").when(blocked, "none").when(F.col("speculative"), "speculative").otherwise("plain")
    return channels.select("query_id", mode.alias("rerank_mode"), (F.col("rerank") & blocked).alias("rerank_degraded"), F.col("late").alias("partial"))


def apply_rerank(fused: DataFrame, scores: DataFrame, top_k: int = 10) -> DataFrame:
    """Reranked documents first by their score, the rest after by the fused one; then the cut."""
    joined = fused.select("query_id", "doc_id", F.col("score").alias("fused")).join(scores.select("query_id", "doc_id", "rerank_score"), ["query_id", "doc_id"], "left")
    cut = ranked(joined, top_k, F.col("rerank_score").isNull(), F.desc("rerank_score"), F.desc("fused"), F.col("doc_id"))
    return cut.select("query_id", "doc_id", "fused", "rerank_score", F.coalesce("rerank_score", "fused").alias("score"), "rank")


def speculative(lexical: DataFrame, vector: DataFrame, score, first: int = 10) -> DataFrame:
    """Scores of the first lexical hits and then of the candidates not scored yet; together the same as at once."""
    early = score(lexical.where(F.col("rank") <= first).select("query_id", "doc_id", "rank"))
    rest = rerank_candidates(lexical, vector).join(early.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return early.unionByName(score(rest))


def cascade_needed(fused: DataFrame, gap: float = 0.005) -> DataFrame:
    """query_id, rerank: whether the first and the sixth score are too close to trust the fused order."""
    got = fused.where("rank in (1, 6)").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 6, F.col("score"))).alias("b"))
    return got.select("query_id", F.when(F.col("b").isNull(), F.lit(False)).otherwise(F.col("a") - F.col("b") < gap).alias("rerank"))


def personalize(fused: DataFrame, profiles: DataFrame, doc_vectors: DataFrame, weight: float = 0.3) -> DataFrame:
    """0.7 * fused + 0.3 * cosine(profile, document); without a profile or a vector the fused score stays as it is."""
    joined = fused.select("query_id", "doc_id", F.col("score").alias("fused")).join(small(profiles.select("query_id", "profile_vector")), "query_id", "left").join(doc_vectors.select("doc_id", "vector"), "doc_id", "left")
    score = F.when(F.col("profile_vector").isNull() | F.col("vector").isNull(), F.col("fused")).otherwise((1 - weight) * F.col("fused") + weight * V.cosine(F.col("profile_vector"), F.col("vector")))
    return ranked(joined.select("query_id", "doc_id", F.round(score, 6).alias("score")), MOST_K, F.desc("score"), F.col("doc_id"))


def diversity(vectors: np.ndarray, top: int = 10) -> float:
    """Mean over the first documents of 1 less the closest other's cosine; 1 for one, 0 for none."""
    v = np.asarray(vectors, dtype=float)[:top]
    if len(v) < 2:
        return float(len(v))
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return float((1 - s.max(axis=1)).mean())


def mmr_order(scores: np.ndarray, vectors: np.ndarray, lam: float, k: int) -> list[int]:
    """Greedy choice by lam * relevance - (1 - lam) * closest chosen; rows come by falling score."""
    low, high = scores.min(), scores.max()
    relevance = (scores - low) / (high - low) if high > low else np.full(len(scores), 0.5)
    u = vectors / np.where((n := np.linalg.norm(vectors, axis=1, keepdims=True)) > 0, n, 1)
    closest, chosen, open_ = np.zeros(len(scores)), [], np.ones(len(scores), bool)
    for _ in range(min(k, len(scores))):
        gain = np.where(open_, lam * relevance - (1 - lam) * closest, -np.inf)
        i = int(gain.argmax())
        open_[i] = False
        chosen.append(i)
        near = u @ u[i]
        closest = near if len(chosen) == 1 else np.maximum(closest, near)
    return chosen


def mmr(hits: DataFrame, doc_vectors: DataFrame, lam: float = 0.7, top_k: int = 20, threshold: float = 0.3, step: float = 0.1, floor: float = 0.5) -> DataFrame:
    """query_id, doc_id, score, rank, lambda_used. Groups hold a request's hits, at most MOST_K rows.

    Hits without a vector drop out, except a lone hit. While the choice is less diverse than the threshold, lambda sinks.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True])
        if len(pdf) > 1:
            pdf = pdf[pdf["vector"].notna()]
        order, used = list(range(len(pdf))), lam
        if len(pdf) > 1:
            scores, vectors = pdf["score"].to_numpy(float), np.stack(pdf["vector"].to_list()).astype(float)
            order = mmr_order(scores, vectors, used, top_k)
            while len(order) > 1 and diversity(vectors[order]) < threshold and used > floor + 1e-9:
                used = max(floor, used - step)
                order = mmr_order(scores, vectors, used, top_k)
        out = pdf.iloc[order][["query_id", "doc_id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
        out["lambda_used"] = round(used, 6)
        return out

    joined = hits.select("query_id", "doc_id", "score").join(doc_vectors.select("doc_id", "vector"), "doc_id", "left")
    return joined.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, score double, rank int, lambda_used double")


def diversity_scores(hits: DataFrame, doc_vectors: DataFrame, top: int = 10) -> DataFrame:
    """query_id, diversity over the first hits, by a join of at most `top` rows a request with themselves."""
    first = hits.where(F.col("rank") <= top).join(doc_vectors.select("doc_id", "vector"), "doc_id").select("query_id", "doc_id", "vector")
    other = first.select("query_id", F.col("doc_id").alias("other"), F.col("vector").alias("w"))
    near = first.join(other, "query_id").where("doc_id <> other").groupBy("query_id", "doc_id").agg(F.max(V.cosine(F.col("vector"), F.col("w"))).alias("c"))
    return first.join(near, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.avg(1 - F.coalesce("c", F.lit(0.0))), 6).alias("diversity"))


# ---- facets


def tag_facets(hits: DataFrame, docs: DataFrame, top_n: int = 20) -> DataFrame:
    counted = hits.select("query_id", "doc_id").join(live(docs).select("doc_id", F.explode("tags").alias("value")), "doc_id").groupBy("query_id", "value").agg(F.count("*").alias("n"))
    return _top(counted, "tags", top_n)


def category_facets(hits: DataFrame, docs: DataFrame, top_n: int = 20) -> DataFrame:
    category = F.try_variant_get(F.try_parse_json("attributes"), "$.category", "string")
    counted = hits.select("query_id", "doc_id").join(live(docs).select("doc_id", category.alias("value")), "doc_id").where("value is not null").groupBy("query_id", "value").agg(F.count("*").alias("n"))
    return _top(counted, "category", top_n)


def _top(counted: DataFrame, field: str, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "value")
    return counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("query_id", F.lit(field).alias("field"), "value", "n")


FACETS = {"tags": tag_facets, "category": category_facets}


def facets(hits: DataFrame, docs: DataFrame, fields: list[str], top_n: int = 20) -> DataFrame | None:
    """All asked facets as one table; fields without an aggregate are ignored, None when none is left."""
    made = [FACETS[f](hits, docs, top_n) for f in fields if f in FACETS]
    out = made[0] if made else None
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def merge_facets(before: DataFrame, delta: DataFrame, top_n: int = 20) -> DataFrame:
    """Earlier buckets and those of new documents, added up."""
    summed = before.unionByName(delta).groupBy("query_id", "field", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("query_id", "field").orderBy(F.desc("n"), "value")
    return summed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_n).drop("r")


# ---- results


def assemble(ranking: DataFrame, lexical: DataFrame, vector: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with title, snippet and the explanation: ranks and scores of both channels."""
    lex = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    vec = vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    text = docs.select("doc_id", "title", F.substring("content", 1, SNIPPET).alias("snippet"))
    out = ranking.join(lex, ["query_id", "doc_id"], "left").join(vec, ["query_id", "doc_id"], "left").join(text, "doc_id", "left")
    return out.select("query_id", "rank", "doc_id", "score", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), "lexical_rank", "lexical_score", "vector_rank", "vector_score")


def degraded(channels: DataFrame) -> DataFrame:
    """query_id, degraded: the vector channel off or unhealthy, a partial answer, or an error of either channel."""
    return channels.select("query_id", (F.col("vector_disabled") | F.col("vector_unhealthy") | F.col("partial") | F.col("lexical_error") | F.col("vector_error")).alias("degraded"))
