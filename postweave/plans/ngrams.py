"""Frequent n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.text import first_word, strip_links
from postweave.operators.counts import count_by
from postweave.operators.filters import contains_pattern, drop_stopword_ngrams, exclude_pattern
from postweave.operators.ranking import top_n
from postweave.operators.tokens import tokenize_ngrams


def ngram_top(
    posts: DataFrame,
    n: int = 2,
    top: int = 5,
    filterword: str = "",
    containword: str = "",
    stopwords: Sequence[str] = (),
    stop_mode: str = "token",
) -> DataFrame:
    """The most frequent n-grams as (ngram, n); pass ``stopwords`` to leave out n-grams with one."""
    ngrams = tokenize_ngrams(posts.select("text"), n=n)
    ngrams = exclude_pattern(ngrams, "ngram", filterword)
    ngrams = contains_pattern(ngrams, "ngram", containword)
    ngrams = drop_stopword_ngrams(ngrams, "ngram", stopwords, stop_mode)
    return top_n(count_by(ngrams, "ngram"), "n", top)


def ngram_negation(posts: DataFrame, negationword: str = "not", n: int = 2, top: int = 5) -> DataFrame:
    """The most frequent n-grams that begin with a word, as (ngram, n).

    Texts without the word are passed over before they are tokenised.
    """
    texts = posts.select(strip_links(F.col("text")).alias("text")).filter(F.lower("text").contains(negationword))
    ngrams = tokenize_ngrams(texts, n=n)
    begun = F.col("ngram").startswith(negationword) & (first_word(F.col("ngram")) == negationword)
    return top_n(count_by(ngrams.filter(begun), "ngram"), "n", top)
