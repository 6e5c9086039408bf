import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from postweave.functions import calendar, labels, text


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("see https://t.co/abc now\nnext", "see  Link\nnext"),
        ("http://t.co/a", "http: Link"),
        ("a<b\nc>d", "ad"),
        ("https://example.org <b>x</b>", "//example.org x"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, text.clean_text) == clean


def test_strip_links_leaves_scheme_and_tags(spark):
    assert one(spark, "https://t.co/a b\n<i>", text.strip_links) == "https: Link\n<i>"
    assert one(spark, "//example.org", text.strip_links) == "//example.org"


@pytest.mark.parametrize(
    ("raw", "words"),
    [
        ("Don't stop", ["don't", "stop"]),
        ("it’s 3.14, a.1 b. 'quoted' x__y", ["it’s", "3.14", "a", "1", "b", "quoted", "x__y"]),
        ("Café ÉTÉ naïve", ["café", "été", "naïve"]),
        ("10,000 1,000.5; 1;2 3, 4 a,b a..b a.'b", ["10,000", "1,000.5", "1;2", "3", "4", "a", "b", "a", "b", "a", "b"]),
        ("中文 10中 中.文 ひら カタカナー カタabc 한국어", ["中", "文", "10", "中", "中", "文", "ひ", "ら", "カタカナー", "カタ", "abc", "한국어"]),
        ("e.g. U.S.A. 5km 3.a ab_1.5_c नमस्ते", ["e.g", "u.s.a", "5km", "3", "a", "ab_1.5_c", "नमस्ते"]),
        ("... !?", []),
        ("", []),
    ],
)
def test_words(spark, raw, words):
    assert one(spark, raw, text.words) == words


def automaton(raw):
    """Words by walking the characters: a joiner counts where letters, or digits, stand on both its sides."""

    def kind(char):
        name, category = unicodedata.name(char, ""), unicodedata.category(char)[0]
        if char == "_":
            return "_"
        if category == "L":
            return "S" if name.startswith(("CJK UNIFIED", "HIRAGANA LETTER")) else "K" if name.startswith("KATAKANA") else "L"
        return category if category in "MN" else ""

    made, at, text_of = [], 0, raw.lower()
    kinds = [kind(char) for char in text_of]
    while at < len(text_of):
        first = at
        state = kinds[at]
        if state in ("", "M"):
            at += 1
            continue
        at += 1
        while at < len(text_of):
            now = kinds[at]
            joins = "'’." if state == "L" else "'’.,;" if state == "N" else ""
            if now == "M":
                at += 1
            elif state in "LN_" and now and now in "LN_" or state == now == "K":
                state, at = now, at + 1
            elif text_of[at] in joins and at + 1 < len(text_of) and kinds[at + 1] == state:
                at += 2
            else:
                break
        made.append(text_of[first:at])
    return made


def test_words_against_an_automaton(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab12_.,;'’ \n-é\u0301中ひカター한") for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.words(F.col("t")).alias("w")).collect()
    assert [row.w for row in rows] == [automaton(t) for t in texts]


def test_words_of_a_long_dotted_run_do_not_overflow_the_stack(spark):
    assert one(spark, "a" + ".a" * 200_000, lambda c: F.size(text.words(c))) == 1


def test_blank_separated_knows_unicode_spaces(spark):
    assert one(spark, "  A b\n\nc d ", text.blank_separated) == ["a", "b", "c", "d"]


def test_first_word(spark):
    assert one(spark, "don't stop", text.first_word) == "don"
    assert one(spark, "no way", text.first_word) == "no"
    assert one(spark, "_no way", text.first_word) == ""


def test_normalise_handle(spark):
    assert one(spark, "@john_doe99", text.normalise_handle) == "john doe"
    assert one(spark, "@123", text.normalise_handle) == ""


def buckets(spark, days, division, with_year=False):
    df = spark.createDataFrame([(day,) for day in days], "d date")
    return [row[0] for row in df.select(calendar.calendar_bucket(F.col("d"), division, with_year)).collect()]


def test_calendar_buckets(spark):
    january = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 15)]
    assert buckets(spark, january, "week") == ["1", "2", "3"]
    assert buckets(spark, january, "biweek") == ["0", "1", "2"]
    assert buckets(spark, january, "week", True) == ["1-2024", "2-2024", "3-2024"]
    assert buckets(spark, [dt.date(2024, 3, 5)], "month") == ["3-2024"]
    assert buckets(spark, [dt.date(2024, 3, 5)], "day") == ["5-3-2024"]
    with pytest.raises(ValueError):
        buckets(spark, january, "year")


def test_labels(spark):
    assert one(spark, "The BEST", lambda c: labels.label_contains(c, "Best")) == "contains Best"
    assert one(spark, "worst", lambda c: labels.label_contains(c, "Best")) == "doesn't contain Best"
    assert one(spark, "anything", lambda c: labels.label_contains(c, "")) == "contains "
    assert one(spark, "retweet_count", labels.label_metric) == "Retweets"


def test_signed_mirror_and_logs(spark):
    df = spark.createDataFrame([("negative", 2.0), ("positive", 3.0), ("negative", 0.0)], "g string, v double")
    mirrored = df.select(labels.signed_mirror(F.col("v"), F.col("g"), "negative"), labels.log_scale(F.col("v"))).collect()
    assert [str(row[0]) for row in mirrored] == ["-2.0", "3.0", "0.0"]
    assert mirrored[2][1] is None
