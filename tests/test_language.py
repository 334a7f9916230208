"""The language model against plain counts, its confidence, and rows without words."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from tidewell.operators import language as L


def grams(text):
    return [f"_{w}_"[i : i + 3] for w in re.findall("[a-z0-9ß-ɏЀ-ӿ]+", text.lower()) for i in range(len(w))]


def plain(train, calibration, texts, vocabulary):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in train:
        if lang is not None and text:
            counts[lang].update(grams(text))
            total.update(grams(text))
    known = {g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]}
    langs = sorted(counts)
    weight = {(l, g): math.log((counts[l][g] + 1) / (sum(counts[l][k] for k in known) + len(known))) for l in langs for g in known}

    def chances(text, k):
        gs = [g for g in grams(text or "") if g in known]
        if not gs:
            return None
        z = [sum(weight[l, g] for g in gs) / math.sqrt(len(gs)) * k for l in langs]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    def loss(k):
        got = [(chances(t, k), l) for t, l in calibration if l in langs]
        return round(sum(-math.log(max(c[langs.index(l)], 1e-12)) for c, l in got if c) / sum(1 for c, _ in got if c), 9)

    best = min(L.SHARPNESS, key=lambda k: (loss(k), k))
    return best, {t: (langs[c.index(max(c))], max(c)) if (c := chances(t, best)) else None for t in texts}


def test_model_against_plain_counts(spark):
    rng = random.Random(3)
    words = {"en": ["the", "house", "and", "with", "of"], "fr": ["la", "maison", "et", "avec", "où"], "ru": ["дом", "и", "с", "этот"]}
    make = lambda n: [(" ".join(rng.choice(words[lang if rng.random() < 0.8 else rng.choice(sorted(words))]) for _ in range(rng.randint(1, 12))), lang) for lang in (rng.choice(sorted(words)) for _ in range(n))]
    train, calibration = make(60) + [(None, "en"), ("", "fr"), ("the the", None)], make(30) + [("xx", "de"), (None, "en")]
    texts = [t for t, _ in make(20)] + ["zzz qqq", "the où дом", ""]
    frame = lambda rows: spark.createDataFrame(rows, "text string, language string").repartition(3)
    model = L.fit(frame(train), frame(calibration), 25)
    sharpness, want = plain(train, calibration, texts, 25)
    assert model.sharpness == sharpness and len(model.grams) == 25
    asked = spark.createDataFrame([(t, "xx") for t in texts] + [(None, "yy")], "text string, tenant string")
    rows = model.detect(asked, default=F.col("tenant"), confidence=0.8).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.text is None or want[r.text] is None:
            assert (r.language, r.confidence) == (r.tenant, 0.0)
        else:
            guess, chance = want[r.text]
            assert r.confidence == pytest.approx(chance, abs=2e-6) and r.language == (guess if chance >= 0.8 else "xx")


def test_memory_of_words_is_bounded(monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "REMEMBERED", 2)
    model = L.LanguageModel(["a", "b"], {"_x_": 0}, np.array([[-1.0, -2.0]]))
    assert [model.word(w).tolist() for w in ("x", "yy", "x", "z", "x")] == [[-1, -2, 1], [0, 0, 0], [-1, -2, 1], [0, 0, 0], [-1, -2, 1]] and len(model._seen) <= 2


def test_without_training_rows(spark):
    none = spark.createDataFrame([], "text string, language string")
    r = L.fit(none, none).detect(spark.createDataFrame([("a",)], "text string")).first()
    assert (r.language, r.confidence) == ("en", 0.0)


def test_held_out_accuracy(spark):
    from tidewell.plans.catalogue import QUERIES

    r = QUERIES["language_model_accuracy"](spark, SF_DIR.replace("sf0.001", "sf0.1")).first()
    print(r)
    assert r.texts > 1500 and r.accuracy > 0.97
