"""Language of texts: naive Bayes over character trigrams of words, fitted on labelled documents, with a calibrated confidence.

Counting goes by words: words are counted by language where they lie, and only distinct words are cut into trigrams. A
text's scores are sums of its words', which each task works out once a word.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidewell.functions import text as X
from tidewell.sources.scratch import Scratch

#: Trigrams that the model knows: the most frequent ones over all languages; all rows are counted.
VOCABULARY = 4096
#: From which confidence on a guess is taken; what is taken otherwise.
CONFIDENCE, DEFAULT = 0.7, "en"
#: How sharply scores are told apart; the one with the least loss on the calibration texts is taken.
SHARPNESS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: Words whose scores a task remembers.
REMEMBERED = 200_000
#: Words that are looked up at a time.
SLICE = 200_000


def grams_of(word: Column) -> Column:
    """The trigrams of a word between marks: as many as it has letters."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit("_"), word, F.lit("_")), i, F.lit(3)))


@dataclass
class LanguageModel:
    languages: list[str]
    grams: dict[str, int]
    weights: np.ndarray  # log chance of each trigram (rows) in each language
    sharpness: float = 1.0
    _seen: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def word(self, word: str) -> np.ndarray:
        """Sums of the known trigrams' weights by language, and their number."""
        if (got := self._seen.get(word)) is None:
            padded = f"_{word}_"
            rows = [r for i in range(len(word)) if (r := self.grams.get(padded[i : i + 3])) is not None]
            got = np.append(self.weights[rows].sum(axis=0), len(rows)) if rows else np.zeros(len(self.languages) + 1)
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[word] = got
        return got

    def sums(self, text: Column) -> Column:
        """array<double>: a text's sums by language, and the number of known trigrams."""
        model, width = self, len(self.languages) + 1

        @F.arrow_udf(ArrayType(DoubleType()))
        def run(words: pa.Array) -> pa.Array:
            ends = np.cumsum(np.asarray(words.value_lengths().fill_null(0)))
            out, row = np.zeros((len(words), width)), 0
            while row < len(words):  # some texts at a time, so that what is held doesn't grow with the batch
                last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE, "right")))
                part = words.slice(row, last - row)
                coded = part.flatten().dictionary_encode()
                sums = np.array([model.word(w) for w in coded.dictionary.to_pylist()]).reshape(-1, width)
                sizes = np.asarray(part.value_lengths().fill_null(0))
                some = np.flatnonzero(sizes)
                if len(some):
                    starts = np.cumsum(sizes) - sizes
                    out[row + some] = np.add.reduceat(sums[np.asarray(coded.indices)], starts[some], axis=0)
                row = last
            return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * width), pa.array(out.reshape(-1)))

        return run(X.tokens(text))

    def chances(self, sums: Column, sharpness: float | None = None) -> Column:
        """array<double> by language from such sums; null where no trigram is known. The mean log chance of a trigram
        counts with the square root of their number: neighbouring trigrams say much the same."""
        count, n = F.element_at(sums, -1), len(self.languages)
        scaled = F.transform(F.slice(sums, 1, n), lambda s: s / F.sqrt(count) * F.lit(float(sharpness or self.sharpness)))
        top = F.transform(F.array(scaled), lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))
        shares = F.transform(top, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
        return F.when(count > 0, F.element_at(shares, 1))

    def detect(self, texts: DataFrame, column: str = "text", default: Column | None = None, confidence: float = CONFIDENCE) -> DataFrame:
        """texts with `language` and `confidence`: the likeliest language, or the default where its chance stays under the
        bound; the chance stays as it is. A null or empty text, and one without known trigrams, gets the default with 0."""
        default = F.lit(DEFAULT) if default is None else default
        if not self.languages:
            return texts.withColumn("language", default).withColumn("confidence", F.lit(0.0))
        with_sums = texts.withColumn("_sums", self.sums(F.col(column))).withColumn("_chances", self.chances(F.col("_sums")))
        best = F.array_max("_chances")
        guess = F.element_at(F.array(*map(F.lit, self.languages)), F.array_position("_chances", best).cast("int"))
        return with_sums.withColumn("language", F.when(best >= confidence, guess).otherwise(default)).withColumn("confidence", F.coalesce(F.round(best, 6), F.lit(0.0))).drop("_sums", "_chances")


def fit(train: DataFrame, calibration: DataFrame, vocabulary: int = VOCABULARY) -> LanguageModel:
    """A model from (text, language) rows; the second table sets the sharpness. Rows without a language are left out.
    What reaches the driver is the vocabulary's counts by language."""
    with Scratch(train.sparkSession) as scratch:
        words = train.where("language is not null").select("language", F.explode(X.tokens(F.col("text"))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
        grams = scratch.stored(words.select("language", "n", F.explode(grams_of(F.col("word"))).alias("gram")).groupBy("language", "gram").agg(F.sum("n").alias("n")))
        top = grams.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(vocabulary).select("gram")
        rows = grams.join(F.broadcast(top), "gram").collect()
    languages, names = sorted({r.language for r in rows}), sorted({r.gram for r in rows})
    at = {g: i for i, g in enumerate(names)}
    counts = np.zeros((len(names), len(languages)))
    for r in rows:
        counts[at[r.gram], languages.index(r.language)] = r.n
    model = LanguageModel(languages, at, np.log((counts + 1) / (counts.sum(axis=0) + len(names))))
    if languages:
        summed = calibration.where(F.col("language").isin(languages)).select(model.sums(F.col("text")).alias("s"), F.array_position(F.array(*map(F.lit, languages)), F.col("language")).cast("int").alias("right"))
        loss = lambda k: F.round(F.avg(-F.log(F.greatest(F.element_at(model.chances(F.col("s"), k), F.col("right")), F.lit(1e-12)))), 9)
        losses = summed.where("element_at(s, -1) > 0").agg(*[loss(k).alias(f"l{i}") for i, k in enumerate(SHARPNESS)]).first()
        known = [(x, k) for x, k in zip(losses, SHARPNESS) if x is not None]
        model.sharpness = min(known)[1] if known else 1.0
    return model
