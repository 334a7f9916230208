"""The thirteen operators as registered queries, each over its whole table, with SQL where it can express them."""

from __future__ import annotations

from . import bpe, centroids, itq, licenses, manifest, mixing, ngram_join, pii, quality, sharding, tokencount, topk, toxicity

QUERIES = {
    "op1_bpe_encoding": bpe.op1_bpe_encoding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_token_counts": tokencount.op5_token_counts,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_embedding_dedup": itq.op7_embedding_dedup,
    "op8_pii": pii.op8_pii,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_quality": quality.op10_quality,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_exact_topk": topk.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op7_embedding_dedup": itq.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
