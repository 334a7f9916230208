"""A training corpus from `documents`: drop toxic texts, keep one of each near-duplicate group, redact personal data,
mix the sources to their target weights, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet to the
shared folder and read again before the next, so a lost executor never reaches back further than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe, mixing, ngram_join, pii, toxicity
from tidewell.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5; the lexicon is learned from labelled rows of this stage's input.
    Null and empty texts stay; an empty table or one without labels falls back on the default lexicon."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group linked by Jaccard >= 0.8 over five-word shingles.
    Texts without words link with nothing and stay."""
    return ngram_join.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars stays the length of the source text. Nulls stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the sampling emits it, 0 to 3 times. Texts without words aren't emitted."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row. A null text counts as empty."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The learned lexicon and the learned spans have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
