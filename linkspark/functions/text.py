"""Text features as expressions: padded character n-grams, q-grams, blocking keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows(text: Column, n: int) -> Column:
    """All substrings of length n, in order; none if the text is shorter."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, low: int = 2, high: int = 4, lowercase: bool = True) -> Column:
    """n-grams of the text with one blank on either side; the padded text itself if it is too short for any."""
    padded = F.concat(F.lit(" "), F.lower(text) if lowercase else text, F.lit(" "))
    grams = F.concat(*[windows(padded, n) for n in range(low, high + 1)])
    return F.when(F.size(grams) == 0, F.array(padded)).otherwise(grams)


def first_chars(n: int = 1, lowercase: bool = True):
    return lambda x: F.array(F.substring(F.lower(x) if lowercase else x, 1, n))


def qgram_keys(q: int = 2):
    return lambda x: F.when(F.length(x) < q, F.array(x)).otherwise(F.array_distinct(windows(x, q)))


def whole_value(lowercase: bool = True):
    return lambda x: F.array(F.lower(x) if lowercase else x)


def phonetic_key():
    return lambda x: F.array(F.soundex(x))
