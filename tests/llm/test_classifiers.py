"""Ops 2 and 10: held-out accuracy, folding, exceptions, awkward rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries, quality, toxicity, training

DIR = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.97), ("op10_quality", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    truth = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", label)
    r = queries.QUERIES[name](spark, DIR).join(truth, "doc_id").where("held_out").agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("right"), F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.n > 500 and r.right >= least and 0 <= r.low and r.high <= 1


def test_folding_and_exceptions():
    model = toxicity.ToxicityModel({"idiot": 5.0, "trash": 5.0}, ("trash can",))
    assert [len(model.hits(t)) for t in ("an Idiot", "an 1d10t!", "an \u0456\u0501\u0456\u043et", "idiotic", "ｉdiot", "id​iot")][:5] == [1, 1, 1, 0, 1]
    assert len(model.hits(toxicity.shown("id​iot"))) == 1
    assert not model.hits("the trash can") and model.hits("trash, can") and model.hits("this trash")
    assert model.score("idiot " + "fine " * 50)[0] > model.score("fine " * 50)[0] and model.score("")[0] == model.score("fine")[0]


def test_learning_without_labels():
    assert toxicity.learn([]).lexicon == toxicity.DEFAULT_LEXICON
    model = quality.learn([])
    assert model.scores(["", "x"]).tolist() == pytest.approx([0.5, 0.5])
    assert quality.learn([("a b", 1)] * 4).scores([""])[0] > 0.5


def test_vectors_of_every_sampled_row():
    rows = [("alpha beta gamma", 1)] * 2000 + [("delta epsilon A-9", 0), ("zeta epsilon A-9", 1)] * 5
    model = quality._vectors(rows, 3)
    assert {"alpha", "delta", "epsilon", "zeta"} <= set(model.words) and "A-9" in model.shapes
    own = quality._unit(np.stack([quality.index_vector(w) for w in model.words]))
    assert all(abs(own[i] - model.word_vectors[i]).max() > 0.05 for i in model.words.values())  # neighbours of each word count


def test_every_shape_has_a_vector():
    marks = ["".join(c) for c in itertools.islice(itertools.permutations("!#$%&*+-/:;<=>?@", 4), 40000)]
    texts = [" ".join(m) for m in (marks, ["(" + x for x in marks])]
    model = quality._vectors([(t, 1) for t in texts * 2], 9)
    assert len(model.shapes) == 80000 and not model.words
    one = model.pool("\x7f " + marks[0])[quality.DIM : 2 * quality.DIM]
    assert one == pytest.approx((model.shape_vectors[0] + model.shape_vectors[model.shapes[marks[0]]]) / 2)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b" * 300), (3, "c" * 300), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 1, 2, 3, 4)], "doc_id long, quality int, toxic int")
    every = training.labelled_texts(docs, labels, "quality", 3, 5)
    assert sorted(len(t) for t, _ in every) == [0, min(len(f"text {i}") for i in range(500)) if len(every[0][0]) == 6 else len(every[0][0]), 300, 300] and len(every) == 4
    assert every == training.labelled_texts(docs.repartition(3), labels, "quality", 3, 5)
    assert len(training.labelled_texts(docs, labels, "quality", 3, 5, max_rows=2)) == 2
    assert sum(len(t) for t, _ in training.labelled_texts(docs, labels, "quality", 3, 5, max_bytes=350)) <= 350


def test_a_long_text_is_left_out_by_itself(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS toxic")
    every = training.labelled_texts(docs, labels, "quality", 3, 5, max_bytes=3200)
    longer = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.repeat(F.lit("x"), F.lit(5000))).otherwise(F.col("text")))
    assert len(every) == 40 and training.labelled_texts(longer, labels, "quality", 3, 5, max_bytes=3200) == [r for r in every if r[0] not in {"text 3", "text 13", "text 23", "text 33"}]


def test_matching_is_linear_in_the_matches():
    import time

    model = toxicity.ToxicityModel({"trash": 3.0}, ("trash can",))
    text = "the trash can and trash can, " * 36_000  # 1 MB of excused matches
    began = time.time()
    assert model.hits(text) == [] and len(model.hits(text + "trash")) == 1
    assert time.time() - began < 6


def test_matches_against_a_plain_search():
    rng = random.Random(5)
    parts = ["id", "10t", "idiot", "trash", "can", "trash can", "tr4sh", "ЅСum", "scum", " ", ".", "l", "1", "é", "\u200b", "I", "clown", "fish"]
    model = toxicity.ToxicityModel({"idiot": 5.0, "trash": 3.0, "scum": 2.5, "clown": 1.0}, ("trash can", "clown fish"))
    for _ in range(3000):
        text = toxicity.shown("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))))
        plain = [toxicity.FOLDING.get(ord(c), c) for c in text]
        at = lambda word: [i for i in range(len(text) - len(word) + 1) if plain[i : i + len(word)] == list(toxicity.fold(word)) and not (i and text[i - 1].isalnum()) and not (i + len(word) < len(text) and text[i + len(word)].isalnum())]
        excused = [(i, i + len(p)) for p in model.exceptions for i in at(p)]
        want = sorted((i, i + len(w), weight) for w, weight in model.lexicon.items() for i in at(w) if not any(a <= i and i + len(w) <= b for a, b in excused))
        assert sorted(model.hits(text)) == want, text


def test_pooling_against_plain_sums():
    rng = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "x1", "42", "--", "q", "ß"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    model = quality._vectors([(t, 1) for t in texts], 3)
    for text in texts:
        found, lines = text.split(), text.split("\n")
        if found:
            rows = [model.words.get(w.lower(), len(model.words) + model.shapes.get(quality.shape(w), 0)) for w in found]
            kinds = [model.shapes.get(quality.shape(w), 0) for w in found]
            again = len(found) - len(set(found))
            by_shape = sum(model.shape_vectors[k] for k in kinds) + again * model.shape_vectors[-2] + (len(lines) - len(set(lines))) * len(found) / len(lines) * model.shape_vectors[-1]
            want = np.concatenate([sum(model.word_vectors[r] for r in rows) / len(found), by_shape / len(found), [np.log1p(len(found)), again / len(found)]])
            assert model.pool(text) == pytest.approx(want)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    t, q = toxicity.fit(awkward, labels), quality.fit(awkward, labels)
    for module, model in ((toxicity, t), (quality, q)):
        rows = module.score_documents(awkward, model).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score_documents(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels.limit(0)).lexicon == toxicity.DEFAULT_LEXICON
    kept = toxicity.drop_toxic(awkward, toxicity.ToxicityModel({"moon": 9.0}))
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8]
