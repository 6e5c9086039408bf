import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postweave.functions.text import clean_text
from postweave.operators import filters, tokens
from postweave.operators.counts import count_by


def texts(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values, 1)], "id string, text string")


def test_ngrams_of_one_text_only(spark, rows_of):
    grams = tokens.tokenize_ngrams(texts(spark, "a b", "c d", "one", None), n=2)
    assert rows_of(grams) == [("1", "a b"), ("2", "c d")]


@pytest.mark.parametrize(
    ("n", "expected"),
    [
        (1, ["a", "b", "c", "d"]),
        (2, ["a b", "b c", "c d"]),
        (3, ["a b c", "b c d"]),
        (4, ["a b c d"]),
        (5, []),
    ],
)
def test_ngram_lengths(spark, n, expected):
    found = tokens.tokenize_ngrams(texts(spark, "a b c d"), n=n).select("ngram").collect()
    assert [row[0] for row in found] == expected


def test_ngram_length_is_checked(spark):
    with pytest.raises(ValueError):
        tokens.tokenize_ngrams(texts(spark, "a"), n=0)
    with pytest.raises(TypeError):
        tokens.tokenize_ngrams(texts(spark, "a"), n=2.0)


def test_mentions(spark, rows_of):
    found = tokens.extract_mentions(texts(spark, "@John_Doe99 hi", "mail me@x.org", "none", "@123"))
    assert rows_of(found) == [("1", "john doe"), ("2", "me x org"), ("4", "")]


def test_ngram_words_keep_the_ngram(spark, rows_of):
    grams = tokens.tokenize_ngrams(texts(spark, "bad don't"), n=2)
    assert rows_of(tokens.ngram_words(grams), "ngram", "word") == [("bad don't", "bad"), ("bad don't", "don't")]


def test_stop_words_by_token_and_by_substring(spark, rows_of):
    grams = spark.createDataFrame([("a cat",), ("big cat",)], "ngram string")
    assert rows_of(filters.drop_stopword_ngrams(grams, "ngram", ["a"])) == [("big cat",)]
    assert rows_of(filters.drop_stopword_ngrams(grams, "ngram", ["a"], "substring")) == []
    assert filters.drop_stopword_ngrams(grams, "ngram", []) is grams
    with pytest.raises(ValueError):
        filters.drop_stopword_ngrams(grams, "ngram", ["a"], "prefix")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab.é ", max_size=7), min_size=1, max_size=12), st.lists(st.text("ab.é ", max_size=4), max_size=6), st.booleans())
def test_substring_stop_words_as_a_table(spark, grams, stops, large):
    with pytest.MonkeyPatch.context() as patch:
        if large:
            patch.setattr(filters, "fits_broadcast", lambda table: False)
        df = spark.createDataFrame([*[(gram,) for gram in grams], (None,)], "ngram string")
        table = spark.createDataFrame([*[(stop,) for stop in stops], (None,)], "word string")
        kept = filters.drop_stopword_ngrams(df, "ngram", table, "substring").collect()
    expected = [gram for gram in grams if not any(stop in gram for stop in stops)]
    assert sorted((r[0] for r in kept), key=str) == sorted([*expected, None], key=str)


def test_missing_ngrams_stay_in_every_mode(spark):
    df = spark.createDataFrame([(None,), ("a b",)], "ngram string")
    table = spark.createDataFrame([("a",)], "word string")
    for stops in (["a"], table):
        for mode in ("token", "substring"):
            assert [r[0] for r in filters.drop_stopword_ngrams(df, "ngram", stops, mode).collect()] == [None]


def test_an_ngram_that_is_null_stays(spark):
    grams = spark.createDataFrame([(1, "a cat"), (2, None), (3, "big cat")], "id int, ngram string")
    table = spark.createDataFrame([("a",)], "word string")
    for stopwords in (["a"], table):
        assert sorted(r.id for r in filters.drop_stopword_ngrams(grams, "ngram", stopwords).collect()) == [2, 3]


def test_patterns_and_exact(spark, rows_of):
    grams = spark.createDataFrame([("ab",), ("bc",)], "ngram string")
    assert rows_of(filters.exclude_pattern(grams, "ngram", "^a")) == [("bc",)]
    assert rows_of(filters.contains_pattern(grams, "ngram", "a|x")) == [("ab",)]
    assert filters.exclude_pattern(grams, "ngram", "") is grams
    assert rows_of(filters.exclude_exact(grams, "ngram", "b")) == [("ab",), ("bc",)]


def test_date_range_includes_both_ends(spark, make_posts, rows_of):
    posts = make_posts(*[{"created_at": dt.datetime(2024, 3, day)} for day in (1, 2, 4, 5)])
    days = posts.select(F.to_date("created_at").alias("created_at"))
    kept = rows_of(filters.date_range_filter(days, "2024-03-02", dt.date(2024, 3, 4)))
    assert kept == [(dt.date(2024, 3, 2),), (dt.date(2024, 3, 4),)]
    assert filters.date_range_filter(days, None, None) is days


word = st.text(alphabet="ab'.é_", min_size=0, max_size=5)
post = st.lists(word, max_size=8).map(" ".join)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(post, min_size=1, max_size=6))
def test_ngram_properties(spark, posts):
    df = texts(spark, *posts)
    words = [r[0] for r in tokens.tokenize_words(df).select("word").collect()]
    assert sorted(words) == sorted(r[0] for r in tokens.tokenize_ngrams(df, n=1).select("ngram").collect())
    lengths = {r[0]: r[1] for r in count_by(tokens.tokenize_words(df), "id").collect()}
    for n in (2, 3):
        assert tokens.tokenize_ngrams(df, n=n).count() == sum(max(0, length - n + 1) for length in lengths.values())


piece = st.sampled_from(["https://t.co/ab", "https:", "<b>", "x<y>", "//t.co/", "plain", "\n", " ", "<", ">"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(piece, max_size=8).map(" ".join), min_size=1, max_size=6))
def test_cleaning_twice_is_cleaning_once(spark, posts):
    df = texts(spark, *posts).select(clean_text(F.col("text")).alias("once"))
    assert df.filter(clean_text(F.col("once")) != F.col("once")).count() == 0


def test_only_parts_that_begin_like_a_stop_word_are_joined(spark):
    values = spark.createDataFrame([("abcdef",), ("xyz",), ("b12345",), ("9",)], "word string")
    listed = spark.createDataFrame([("cdef",), ("1234",), ("9999",), ("9",)], "_word string")
    found = filters._with_substring(values, "word", listed)
    assert sorted(r[0] for r in found.collect()) == ["9", "abcdef", "b12345"]
    # digits are looked up before they are shuffled: letters alone make no rows for the join
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_substring_stop_words_across_words(spark, rows_of):
    df = spark.createDataFrame([("good day", 1), ("good dog", 2), ("dday x", 3), (None, 4)], "ngram string, n int")
    table = spark.createDataFrame([("d da",), ("ay x",)], "word string")
    kept = filters.drop_stopword_ngrams(df, "ngram", table, "substring")
    assert sorted(r["n"] for r in kept.collect()) == [2, 4]
