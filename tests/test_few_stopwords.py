import pytest
from pyspark.sql import functions as F

from postweave.operators import counts, filters, tokens

VALUES = ["the cat", "cat the", "a the b", "other cat", "bathe the", "bathe them", "the", "", " ", "a  b", " a", "a ", "The cat", "x y z", "in\tin", None, "été the", "of.the"]
LISTS = [["the"], ["the", "of", "a", "in"], [""], ["a b"], ["the cat", "x"], ["été"], ["z", None], ["%", "_", "."], [f"w{k}" for k in range(filters.FEW_WORDS)], [f"w{k}" for k in range(filters.FEW_WORDS)] + ["the"]]


@pytest.mark.parametrize("listed", LISTS)
def test_words_are_those_between_blanks(spark, listed):
    table = spark.createDataFrame([(k, value, value) for k, value in enumerate(VALUES)], "k int, ngram string, `o.dd` string")
    kept = filters.drop_stopword_ngrams(table, "ngram", listed)
    assert kept.columns == table.columns and kept.schema["ngram"].dataType == table.schema["ngram"].dataType
    wanted = [(k, v, v) for k, v in enumerate(VALUES) if v is None or not set(v.split(" ")) & set(listed)]
    assert sorted(map(tuple, kept.collect())) == wanted


def test_a_few_words_split_no_ngram(spark):
    # fails where n-grams are split, and where an n-gram is put together again for each time the filter names it
    posts = spark.createDataFrame([("the cat of a cat",), ("cat cat cat",)], "text string")
    counted = counts.count_by(filters.drop_stopword_ngrams(tokens.tokenize_ngrams(posts, n=2), "ngram", ["the", "of", "a"]), "ngram")
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "exists(" not in plan and plan.count("concat_ws(") == 1
    assert [tuple(row) for row in counted.collect()] == [("cat cat", 2)]


def test_other_spellings_of_the_column(spark):
    table = spark.createDataFrame([("the cat",), ("cat cat",)], "Ngram string").withColumn("held", F.struct("Ngram"))
    for column in ("ngram", "held.Ngram"):
        kept = filters.drop_stopword_ngrams(table, column, ["the"])
        assert kept.columns == ["Ngram", "held"] and [row.Ngram for row in kept.collect()] == ["cat cat"]
