"""Row generators: one row per word, n-gram or mention.

The text column is dropped and every other column is carried, so callers select what they need
before tokenising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import blank_separated, normalise_handle, words
from postweave.params import at_least


def tokenize_words(df: DataFrame, text: str = "text", out: str = "word") -> DataFrame:
    """One row per lower-cased word."""
    return df.select(*_carried(df, text), F.explode(words(F.col(text))).alias(out))


def tokenize_ngrams(df: DataFrame, text: str = "text", n: int = 2, out: str = "ngram") -> DataFrame:
    """One row per run of ``n`` words of one text, joined by blanks; none for a shorter text.

    The n-grams are zipped from the word array shifted by 0 to n-1 places. Exploding the array
    inside a one-element array first keeps Catalyst from repeating the word regex for each shift.
    """
    at_least("n", n, 1)
    if n == 1:
        return tokenize_words(df, text, out)
    carried = _carried(df, text)
    listed = df.select(*carried, F.explode(F.array(words(F.col(text)))).alias("_words"))
    listed = listed.filter(F.size("_words") >= n)
    width = F.size("_words") - (n - 1)
    places = [f"_w{i}" for i in range(n)]
    shifted = [F.slice("_words", i + 1, width).alias(place) for i, place in enumerate(places)]
    zipped = listed.select(*carried, F.inline(F.arrays_zip(*shifted)))
    return zipped.select(*carried, F.concat_ws(" ", *places).alias(out))


def tokenize_whitespace(df: DataFrame, text: str = "text", out: str = "word") -> DataFrame:
    """One row per lower-cased piece between white space."""
    return df.select(*_carried(df, text), F.explode(blank_separated(F.col(text))).alias(out))


def extract_mentions(df: DataFrame, text: str = "text", out: str = "word") -> DataFrame:
    """One row per piece that holds an @, reduced to its letters a-z.

    Texts without an @ are passed over before they are split.
    """
    pieces = tokenize_whitespace(df.filter(F.col(text).contains("@")), text, out).filter(F.col(out).contains("@"))
    return pieces.withColumn(out, normalise_handle(F.col(out)))


def ngram_words(ngrams: DataFrame, ngram: str = "ngram", out: str = "word") -> DataFrame:
    """One row per word of each n-gram, the n-gram and all other columns kept beside it.

    Words hold no blank, so splitting gives what tokenising the n-gram again would.
    """
    return ngrams.select("*", F.explode(F.split(ngram, " ")).alias(out))


def _carried(df: DataFrame, text: str) -> list[str]:
    return [column for column in df.columns if column != text]
