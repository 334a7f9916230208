"""A bounded, repeatable sample of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release

#: Labelled rows, and bytes of their texts, that a classifier is fitted on at most: the bounds of what reaches the driver.
#: A text of more than a MAX_SHARE-th of the bytes isn't fitted on, so that no text takes the place of many.
MAX_ROWS, MAX_BYTES, MAX_SHARE = 6000, 32_000_000, 32


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out_fold: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """Up to max_rows (text, label) pairs of max_bytes together, outside the held-out fold, the same ones on every run.

    Ids are chosen in order of a hash, so only chosen texts travel; the broadcast side has max_rows rows at most. Rows
    without a 0/1 label are left out; an id labelled twice counts once, by its larger label; an id with several texts
    counts once, by the text of the smallest hash. Texts of more than a MAX_SHARE-th of max_bytes are left out by
    themselves; of the others whole texts are taken in the same order until their bytes reach the bound. A null text counts
    as empty; empty tables give none.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out_fold)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(20240)), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    one = one.where(F.octet_length("text") <= max_bytes // MAX_SHARE)
    # No more than max_rows rows come to this window.
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id", F.lit(20240)), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id", "text", "label").collect()
    rows = [(r.text, r.label) for r in sorted(rows, key=lambda r: r.doc_id)]
    release(docs.sparkSession)
    return rows


def held_out(folds: int, held_out_fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold, F.lit(False)).alias("held_out")
