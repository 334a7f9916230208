"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all sizes; a target stops at three
times its source's size and the excess is shared again by weight. The level at which that settles comes from the
sources sorted by cap over weight: those whose cap lies below the level stop at it, the others get weight times level.

Sampling: each document expects target / source_size copies. Within its source, in the order of a key, the expected
copies are summed up, one random offset is added, and the document is emitted once for each integer boundary that its
share crosses. The order goes by size, so that a source's words come out near its target and not its documents only.
The sums run at two levels: within (source, size class, shard), and over those groups' totals, of which a source has
SHARDS for each size class at most; so a source with a third of all rows is spread over many tasks.

Sizes are counted once, into a narrow table in the shared folder; texts take part in no window, aggregate or sort.
To emit the mix, the narrow rows that are taken meet their texts again by file and place in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import materialize, table

#: Expected copies are whole numbers of 2**-SCALE_BITS, so sums are exact and reruns agree.
SCALE_BITS = 20
SHARDS = 64
MAX_COPIES = 3
WEIGHTS = (5, 2, 1)
# Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text"):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def size_class():
    """Rises with the size: its length in binary digits and the four digits after the first."""
    return F.expr("case when size < 32 then size else length(bin(size)) * 16 + shiftright(size, length(bin(size)) - 5) - 16 end")


def _ordered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows written in this order, with `part` and `at`: the stretch of the order that each is in, and its place there.
    Stretches are as many as partitions, and sums over what comes before need a row of each only."""
    numbered = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(numbered.select(*rows.columns, F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), name)[0]


def _with_sums_before(ordered: DataFrame, **sums) -> DataFrame:
    """ordered with, under each name, the sum of a column over all rows before."""
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    ahead = parts.select("part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    return ordered.join(ahead, "part").withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).drop(*[f"_{k}" for k in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from (source, size). Sources may be many, say hosts: both orders, by code point and by
    cap over weight, are range-sorted and summed in two levels."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    by_name = _with_sums_before(_ordered(per_source, "sources", F.col("source").isNull(), F.col("source")), place="one").drop("part", "at", "one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = by_name.withColumn("weight", weight.cast("long")).withColumn("most", cap * F.col("source_size")).drop("place")
    by_level = _ordered(weighed, "levels", F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    total, every = by_level.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    tried = _with_sums_before(by_level, most_before="most", weight_before="weight").withColumn("left_over", total - F.col("most_before")).withColumn("left_weight", every - F.col("weight_before"))
    # The first source whose cap is not below its share, the caps before it taken off, sets the level.
    fits = tried.where(F.col("most") * F.col("left_weight") >= F.col("weight") * F.col("left_over"))
    level = fits.agg(F.min(F.struct("part", "at", "left_over", "left_weight")).alias("l")).first().l
    share = F.col("weight") * F.lit(level.left_over) / F.lit(level.left_weight) if level else F.lit(0.0)
    return by_level.select("source", "source_size", F.least(F.col("most").cast("double"), share).alias("target"))


def _narrow(docs: DataFrame, *key) -> DataFrame:
    """doc_id, source, size, shard, mark and the key's columns, without texts. Rows without an id are dealt by text."""
    text, number = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    shard = F.conv(F.substring(F.md5(F.coalesce(number.cast("string"), text).cast("binary")), 1, 2), 16, 10).cast("int") % SHARDS
    return docs.select(number.alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), shard.alias("shard"), F.unhex(F.md5(text.cast("binary"))).alias("mark"), *key)


def _allot(narrow: DataFrame, seed: int, *ties: str) -> DataFrame:
    """The narrow rows with source_size, target and copies."""
    goal = targets(narrow.select("source", "size")).withColumn(
        "per_copy", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_COPIES << SCALE_BITS), F.round(F.col("target") / F.col("source_size") * (1 << SCALE_BITS)).cast("long"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("")))), 1, 5), 16, 10).cast("long"))
    # 5 hexadecimal digits: an offset in [0, 2**SCALE_BITS)
    placed = narrow.withColumn("class", size_class())
    counted = placed.where("size > 0").groupBy("source", "class", "shard").agg(F.count("*").alias("n"))
    groups = Window.partitionBy("source").orderBy("class", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("ahead", F.coalesce(F.sum("n").over(groups), F.lit(0))).select("source", "class", "shard", "ahead")
    inside = Window.partitionBy("source", "class", "shard").orderBy("size", "doc_id", "mark", *ties)
    ranked = placed.where("size > 0").withColumn("rank", F.row_number().over(inside))
    joined = _by(_by(ranked, starts, "source", "class", "shard"), goal, "source")
    # The sum of expected copies up to a document is its place in the source times the copies each expects.
    upto = F.col("offset") + (F.col("ahead") + F.col("rank")) * F.col("per_copy")
    copies = F.shiftright(upto, SCALE_BITS) - F.shiftright(upto - F.col("per_copy"), SCALE_BITS)
    none = _by(placed.where("size = 0"), goal, "source")
    return joined.withColumn("copies", copies).drop("class", "shard", "mark", "ahead", "rank", "per_copy", "offset").unionByName(
        none.withColumn("copies", F.lit(0).cast("long")).drop("class", "shard", "mark", "per_copy", "offset")
    )


def with_copies(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of docs; other columns are left aside.

    Null text has size 0, takes no words and gets no copies; a null source is a source of its own, the last; repeated
    rows are documents of their own, and those alike in source, id and text share a shard; rows without an id are dealt
    by their text; very long texts are read once, to count; an empty table gives an empty result.
    """
    return _allot(materialize(_narrow(docs), "sizes")[0], seed)


def _by(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join that also matches null keys; the small side has a row a source or a group of it."""
    for k in keys:
        right = right.withColumnRenamed(k, f"_{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(right, condition).drop(*(f"_{k}" for k in keys))


def _as_files(docs: DataFrame) -> DataFrame:
    """docs as a plain scan of Parquet files, whose rows have a place: itself if it is one, else written out."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation"):
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
            return docs
        except Exception:  # a relation that isn't made of Parquet files
            pass
    return materialize(docs, "documents")[0]


def emit(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as the sampling emits it, 0 to MAX_COPIES times.

    Rows are told apart by their file and place, so repeated and missing ids, ties and clashing names don't matter. Of
    rows alike in source, id and text, which one is taken goes by a hash of all columns (maps and variants aside), so
    reruns agree. Texts without words aren't emitted; an empty table stays empty.
    """
    columns, docs = docs.columns, _as_files(docs)
    place = docs.metadataColumn("_metadata")
    key = [place["file_path"].alias("_file"), place["row_index"].alias("_row")]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    narrow, _ = materialize(_narrow(docs, F.xxhash64(*hashed).alias("_all"), *key), "sizes")
    taken = _allot(narrow, seed, "_all").where("copies > 0").select("_file", "_row", F.col("copies").cast("int").alias("_copies"))
    # The narrow side is hashed, so that texts cross the network once and are never sorted.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *key)
    met = rows.join(taken.hint("shuffle_hash"), ["_file", "_row"])
    copied = met.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    return copied.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document; see with_copies for awkward rows."""
    docs = table(spark, sf_dir, "documents")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The same by plain windows over whole sources.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 2) AS INT) % 64 AS shard, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight, 3 * source_size AS most FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight,
        row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, source IS NULL, source) AS place
      FROM w WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT left_over, left_weight FROM o WHERE most * left_weight >= weight * left_over ORDER BY place LIMIT 1),
t AS (SELECT o.source, o.source_size, least(CAST(most AS DOUBLE), CAST(weight * l.left_over AS DOUBLE) / CAST(l.left_weight AS DOUBLE)) AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3 * 1048576, CAST(round(target / source_size * 1048576) AS BIGINT)) ELSE 0 END AS per_copy,
        CAST('0x' || substr(md5('1|' || coalesce(source, '')), 1, 5) AS BIGINT) AS "offset" FROM t),
r AS (SELECT d.doc_id, d.size, d.source,
        row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN d.size < 32 THEN d.size ELSE length(format('{:b}', d.size)) * 16 + ((d.size >> (length(format('{:b}', d.size)) - 5)) - 16) END,
          d.shard, d.size, d.doc_id NULLS FIRST, md5(d.body)) AS place
      FROM d WHERE d.size > 0),
c AS (SELECT r.doc_id, r.size, p.source_size, p.target, (("offset" + place * per_copy) >> 20) - (("offset" + (place - 1) * per_copy) >> 20) AS copies
      FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
UNION ALL SELECT d.doc_id, d.size, p.source_size, p.target, 0, 0 FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size = 0
"""
