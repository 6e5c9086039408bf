"""What sets posts that perform well apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.labels import HIGH, LOW, signed_mirror
from postweave.operators.filters import original_posts
from postweave.operators.ranking import top_n_by_group
from postweave.operators.statistics import label_high_low
from postweave.operators.tfidf import two_way_tf_idf
from postweave.operators.tokens import tokenize_ngrams
from postweave.params import METRICS, one_of


def high_low_terms(
    posts: DataFrame, tweetmetric: str = "favorite_count", highlowperformers: float = 50, n: int = 2, top: int = 5
) -> DataFrame:
    """The n-grams with the highest tf-idf among high and low performers.

    Rows are (comparison, ngram, n, tf, idf, tf_idf), low performers' tf_idf below zero. With one
    group only, every idf is zero, all n-grams tie, and all are returned.
    """
    metric = one_of("tweetmetric", tweetmetric, METRICS)
    labelled = label_high_low(original_posts(posts).select("text", metric), metric, highlowperformers)
    ngrams = tokenize_ngrams(labelled.select("text", "comparison"), n=n)
    weighed = two_way_tf_idf(ngrams, "ngram", "comparison", HIGH, LOW)
    best = top_n_by_group(weighed, "comparison", "tf_idf", top, few_groups=True)
    return best.withColumn("tf_idf", signed_mirror(F.col("tf_idf"), F.col("comparison"), LOW))
