"""Text expressions that stay in the JVM; normalisation to NFC is the one Arrow UDF, as there is no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions.vectors import let
from tidewell.sources.tables import TOKEN

# Multi-letter transliterations first, then letters one to one.
_DIGRAPHS = (("щ", "shch"), ("ж", "zh"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("х", "kh"), ("ц", "ts"), ("ё", "yo"))
_CYRILLIC, _LATIN = "абвгдезийклмнопрстуфыэ", "abvgdezijklmnoprstufye"
_BACK_LATIN, _BACK_CYRILLIC = "abvgdezijklmnoprstufy", "абвгдезийклмнопрстуфы"
#: Frequent short words that tell languages apart where no model is given.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "with"), "fr": ("le", "la", "les", "des", "et", "un", "une", "dans"),
    "de": ("der", "die", "das", "und", "ist", "den", "mit", "von"), "es": ("el", "los", "las", "que", "una", "por", "para", "del"),
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, the word padded by two blanks before and one after."""
    # A line each, so that no piece reaches over two words; a piece has a letter at its end or before it.
    words = F.concat(F.lit("  "), F.array_join(F.array_distinct(tokens(text)), " \n  "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(words, F.lit(r"(?=([^\n]{2}[^\n ]|[^\n][^\n ] ))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


@F.pandas_udf(StringType())  # a type object: a worker that imports this has no session to parse a name
def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """Text in NFC. A text of characters below U+0300 is so already; only others go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    there = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(there, _normalized(F.when(there, text))).otherwise(text)


def script(token: Column) -> Column:
    """latin or cyrillic where a token starts with letters of that script alone, else neutral."""
    latin, cyrillic = token.rlike(r"^[^\x{400}-\x{4FF}]*[A-Za-z\x{C0}-\x{24F}]"), token.rlike(r"[\x{400}-\x{4FF}]")
    odd_start = token.rlike(r"^[^A-Za-z\x{C0}-\x{24F}\x{400}-\x{4FF}]")
    both = cyrillic & token.rlike(r"[A-Za-z\x{C0}-\x{24F}]")
    return F.when(odd_start | (both & ~latin), "neutral").when(latin, "latin").when(cyrillic, "cyrillic").otherwise("neutral")


def to_latin(text: Column) -> Column:
    out = text
    for letter, many in _DIGRAPHS:
        out = F.replace(out, F.lit(letter), F.lit(many))
    return F.translate(F.translate(out, "ъь", ""), _CYRILLIC, _LATIN)


def to_cyrillic(text: Column) -> Column:
    out = text
    for letter, many in _DIGRAPHS:
        out = F.replace(out, F.lit(many), F.lit(letter))
    return F.translate(out, _BACK_LATIN, _BACK_CYRILLIC)


def language(text: Column, default: str = "en", confidence: float = 0.7) -> Column:
    """struct<language, confidence>: share of the best language's stop words among all stop words found.

    Stands where a model would be plugged in; under the confidence the default is taken, with confidence 0.
    """
    every = [w for stop in STOP_WORDS.values() for w in stop]
    size = lambda h, stop: F.size(F.filter(h, lambda w: w.isin(*stop)))
    among = lambda h: F.array(*[F.struct(size(h, stop).alias("n"), F.lit(name).alias("name")) for name, stop in STOP_WORDS.items()])
    counts = let(F.filter(tokens(text), lambda w: w.isin(*every)), among)
    of = lambda c: F.struct(F.array_max(c).alias("best"), F.aggregate(c, F.lit(0), lambda n, x: n + x["n"]).alias("total"))

    def chosen(found: Column) -> Column:
        share = F.when(found["total"] > 0, found["best"]["n"] / found["total"]).otherwise(F.lit(0.0))
        return F.struct(F.when(share >= confidence, found["best"]["name"]).otherwise(F.lit(default)).alias("language"), F.when(share >= confidence, share).otherwise(F.lit(0.0)).alias("confidence"))

    return let(let(counts, of), chosen)
