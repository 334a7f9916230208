"""Sharding by proportional stratified interleaving: every shard gets each source in the proportion of the whole.

Within each source rows are shuffled by a seeded digest and ranked; the rank r of n stands for the fraction (r + u) / n
of the source, where u in (0, 1) is drawn by the source's name, so that sources of one row or two don't all fall in the
same shard. All rows sorted by that fraction interleave the sources evenly, and cuts at equal counts give shards whose
sizes differ by one at most and whose share of a source is off by about a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .ordering import placed

SHARDS, SEED = 8, 13


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source of every row.

    The law is `rows`: counts of shards are at most one apart, so equal texts go where their own ids fall. A null text
    has no bytes (size 1, checksum 0); a null source is a source of its own, before the others; rows without an id are
    shuffled as one id, told apart by size and checksum; repeated rows take places of their own; an empty table gives
    none. Texts are read once, for size and checksum, and take part in no sort; other columns aren't read.
    """
    text, number = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    narrow = docs.select(
        number.alias("doc_id"), F.octet_length(text).cast("long").alias("size0"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"), F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit("-"))).cast("binary"))).alias("key"),
    ).withColumn("size", F.col("size0") + 1).drop("size0")
    ranked = placed(narrow, "stratum", ["key", F.asc_nulls_first("doc_id"), "size", "text_crc32"], "strata").drop("key")
    # Equal fractions are equal doubles, as both sides of the division are whole.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "stratum").cast("binary")), 1, 4), 16, 10).cast("long")
    fraction = (2 * (65536 * F.col("place") + offset) + 1) / (131072.0 * F.col("members"))
    spread = ranked.select("doc_id", "size", "text_crc32", "source", "stratum", fraction.alias("fraction"), F.lit(0).alias("all"), "_row")
    whole = placed(spread, "all", ["fraction", "stratum"], "interleaved")
    at = F.expr(f"place * {shards} div members")
    begins = F.expr(f"(shard * members + {shards - 1}) div {shards}")
    cut = whole.withColumn("shard", at).withColumn("slot", F.col("place") - begins)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """Eight shards of all documents; see shard for awkward rows."""
    return shard(table(spark, sf_dir, "documents")).drop("source")


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in DuckDB's SQL: four bits at a time, the lower ones of a byte first."""
    steps = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        steps.append(c)
    nibbles = f"list_transform(string_split(regexp_replace(hex({text}), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: CAST(instr('0123456789ABCDEF', x) - 1 AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {nibbles}), lambda a, x: xor(a >> 4, {steps}[(xor(a, x) & 15) + 1])), 4294967295) END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce('=' || source, '') AS stratum, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents),
c AS (SELECT *, CAST(strlen(body) + 1 AS BIGINT) AS size, CAST({crc32_sql("body")} AS BIGINT) AS text_crc32 FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * (65536 * place + CAST('0x' || substr(md5('{SEED}|' || stratum), 1, 4) AS INT)) + 1) / (131072.0 * n), stratum) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * {SHARDS} // total AS INT) AS shard, CAST(pos - ((pos * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
