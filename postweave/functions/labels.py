"""Labels, signs and scores computed from one row."""

from __future__ import annotations

from collections.abc import Mapping
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that appear in results.
METRIC_NAMES = {"favorite_count": "Favorites", "retweet_count": "Retweets"}
RECEIVED_NAMES = {"favorite_count": "FavoritesReceived", "retweet_count": "RetweetsReceived"}
HIGH = "High Performing Tweets"
LOW = "Low Performing Tweets"
NEGATIVE = "negative"


def label_contains(text: Column, word: str) -> Column:
    """ "contains W" or "doesn't contain W", by regex on the lower-cased text; null without a text.

    A word without regex characters is searched for as it is.
    """
    pattern = word.lower()
    plain = not set(pattern) & set(r"\.^$*+?{}[]()|")
    found = F.lower(text).contains(pattern) if plain else F.lower(text).rlike(pattern)
    return F.when(found, f"contains {word}").when(~found, f"doesn't contain {word}")


def label_metric(metric: Column, names: Mapping[str, str] = METRIC_NAMES) -> Column:
    """Display name of a metric column."""
    pairs = list(names.items())
    label = F.lit(pairs[-1][1])
    for name, shown in reversed(pairs[:-1]):
        label = F.when(metric == name, shown).otherwise(label)
    return label


def label_performance(z: Column, cut: float | None) -> Column:
    """High when the score is above ``cut``, else low; null without a score. No cut: all are low."""
    high = F.lit(False) if cut is None else z > F.lit(cut)
    return F.when(z.isNotNull(), F.when(high, HIGH).otherwise(LOW))


def signed_mirror(value: Column, group: Column, mirrored: str) -> Column:
    """Negate the value for one of two groups; zero stays plain zero."""
    return F.when((group == mirrored) & (value != 0), -value).otherwise(value)


def log_score(value: Column) -> Column:
    """log(value + 1)."""
    return F.log1p(value)


def log_scale(value: Column) -> Column:
    """log10(value); null for zero and below."""
    return F.when(value > 0, F.log10(value))


def normal_percentile(z: Column) -> Column:
    """100 times the normal distribution function, to double precision.

    Spark has no error function. Near zero the integral is a power series, of which the terms are summed from the
    last; further out the tail is a continued fraction, evaluated from its far end.
    """
    size = F.abs(z)
    density = F.exp(-size * size / 2) / sqrt(2 * pi)
    series = F.aggregate(_countdown(60), F.lit(1.0), lambda rest, k: 1 + size * size / (2 * k + 1) * rest) * size
    fraction = F.aggregate(_countdown(60), size, lambda rest, k: size + k / rest)
    upper = F.when(size < 3, 0.5 - density * series).otherwise(density / fraction)
    return 100 * F.when(z < 0, upper).otherwise(1 - upper)


def _countdown(last: int) -> Column:
    """The whole numbers from ``last`` to 1, as doubles."""
    return F.array(*[F.lit(float(k)) for k in range(last, 0, -1)])
