import hashlib
import struct
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import public_tokenizers
import pytest
from compare import SF_DIR
from pyspark.sql import functions as F
from test_joins import brute
from test_spans_and_mixing import redacted

from tidewell.llm import common, mixing, pii, toxicity


def test_stages(spark, awkward, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "bpe"]
    for start in (awkward, nothing):
        docs, columns = start, start.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR).cache()
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_run_against_plain_code(spark, tmp_path):
    """All five stages row by row: the lexicon and the spans are the operators' own, the rest is plain code and libraries."""
    import duckdb
    from tokenizers import Tokenizer

    words = [f"w{i}" for i in range(60)]
    more = [(90001, None, "en", "src1", 0), (90002, "", "en", "src1", 0), (90003, " \n", "en", None, 2), (90004, " ".join(words), "en", None, 9), (90005, " ".join([*words, "x"]), "en", "src2", 9), (90006, "Mail bob@example.org or +1 555 123 4567, token = \"04dbebab91ab85687d33eeaaf9ac699e1188aabb\" " * 40, "en", "src1", 9)]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("size", F.lit("clash"))
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")

    rows = docs.collect()
    model = toxicity.fit(docs, labels)
    kept = [r for r in rows if model.score(r.text or "")[0] < 0.5]
    least = brute([(r.doc_id, r.text) for r in kept], 5, 80)
    once = [r for r in kept if least[r.doc_id][1] == r.doc_id]
    assert len(rows) > len(kept) > len(once) and 90005 not in {r.doc_id for r in once}
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    texts = {r.doc_id: redacted(r.text, spans[r.doc_id]) for r in once}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, texts[r.doc_id], r.source) for r in once])
    taken = con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall()
    owner, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for doc, copies in taken:
        ids = owner.encode(texts[doc] or "", add_special_tokens=False).ids
        decoded = owner.decode(ids, skip_special_tokens=False)
        if copies:
            want[doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids)] = copies
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    assert got == want


def test_no_machine_local_scratch_on_a_cluster():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="app"))
    for master in ("spark://host:7077", "local-cluster[3,2,3000]", "yarn"):
        with pytest.raises(RuntimeError):
            common.scratch_root(session(master))
    assert common.scratch_root(session("local[4]")).startswith("file://")
