"""Summaries, exact medians, histograms, scores and trends of metric columns.

``few_groups`` broadcasts per-group results, one or two rows per group; pass it where the number of
groups is bounded (metric names, two-way labels), as the analytics do. A missing key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.functions.labels import label_performance, log_scale, log_score, normal_percentile
from postweave.operators.joins import join_groups
from postweave.operators.order_statistics import values_at
from postweave.params import TREND_METHODS, at_least, one_of, percentile


_WHOLE = ("byte", "short", "integer", "long")


def tally_values(df: DataFrame, groups: Sequence[str], value: str, out: str = "times") -> DataFrame:
    """Rows per group and distinct value; what medians and histograms can be read from."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias(out))


def tally_median(
    tally: DataFrame, groups: Sequence[str], value: str, times: str = "times", few_groups: bool = False, cuts: int = 2
) -> DataFrame:
    """Exact median per group of counted values: the mean of the one or two in the middle, rounded once, to a double."""
    middle = {"_lower": "(_total - 1) div 2", "_upper": "_total div 2"}
    found = values_at(tally, groups, value, times, middle, few_groups, cuts)
    lower, upper = F.col("_lower"), F.col("_upper")
    if tally.schema[value].dataType.typeName() == "long":
        lower, upper = lower.cast("decimal(20,0)"), upper.cast("decimal(20,0)")
    return found.select(*groups, ((lower + upper) / 2).cast("double").alias("median"))


def metric_summary(df: DataFrame, key: str, value: str, few_groups: bool = False, cuts: int = 2) -> DataFrame:
    """Minimum, median, mean, maximum, sample deviation and number of rows per key; ``cuts`` as in ``values_at``.

    All come from one count of distinct values, so the input is read once. Sums of whole numbers are exact; deviations
    are taken from the mean, not from a difference of large sums.
    """
    # no branch leaves a count out, and filters on counts stay above the aggregate: so all branches share its shuffle
    tally = df.groupBy(key, value).agg(F.count(value).alias("_times"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 0")
    valued = tally.filter("_times > 0")
    number = F.col(value).cast("decimal(20,0)") if df.schema[value].dataType.typeName() in _WHOLE else F.col(value).cast("double")
    means = tally.groupBy(key).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.try_divide(F.sum(number * F.col("_times")), F.sum("_times")).alias("_mean"),
        F.sum("_times").alias("_values"),
        F.sum("_rows").alias("TotalTweets"),
    )
    # differences are taken before values become doubles, which whole numbers from 2^53 on do not fit
    apart = (number - F.col("_mean")).cast("double")
    spread = join_groups(valued, means.select(key, "_mean"), key, few_groups)
    spread = spread.groupBy(key).agg(F.sum(apart * apart * F.col("_times")).alias("_squares"))
    medians = tally_median(valued, [key], value, "_times", few_groups=few_groups, cuts=cuts)
    joined = join_groups(join_groups(means, medians, key, few_groups, "left"), spread, key, few_groups, "left")
    deviation = F.sqrt(F.try_divide(F.col("_squares"), F.col("_values") - 1))
    mean = F.col("_mean").cast("double").alias("mean")
    return joined.select(key, "min", "median", mean, "max", deviation.alias("sd"), "TotalTweets")


def group_median(df: DataFrame, groups: Sequence[str], value: str, few_groups: bool = False) -> DataFrame:
    """Attach the median of its group to each row; null where a group has no values."""
    medians = tally_median(tally_values(df, groups, value), groups, value, few_groups=few_groups)
    return join_groups(df, medians, groups, few_groups, "left")


def log_histogram(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    bins: int = 30,
    times: str | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Counts per group in equal-width bins of log10(value); zeros have no bin.

    The bins span each group's own range, and a group with one distinct value has bin 1 only.
    ``times`` names a column of multiplicities.
    """
    at_least("bins", bins, 1)
    groups = list(groups)
    scaled = df.withColumn("_log", log_scale(F.col(value))).filter(F.col("_log").isNotNull())
    bounds = scaled.groupBy(*groups).agg(F.min("_log").alias("_lo"), F.max("_log").alias("_hi"))
    spanned = join_groups(scaled, bounds, groups, few_groups)
    share = F.try_divide(F.col("_log") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    number = F.least(F.coalesce(F.floor(share * bins) + 1, F.lit(1)), F.lit(bins)).cast("int")
    held = F.count(F.lit(1)) if times is None else F.sum(times)
    return spanned.groupBy(*groups, number.alias("bin")).agg(held.alias("n"))


def log_zscore(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """Standard score of log(value + 1) among all rows; null when the deviation is zero or undefined.

    The mean and the deviation are computed here, by one aggregation of the value column, and enter
    the plan as two constants. As subqueries they would keep Spark from recognising that the
    branches of a plan built on the scores are the same, and it would tokenise once per branch.
    """
    score = log_score(F.col(value))
    mean, deviation = df.agg(F.avg(score), F.stddev_samp(score)).first()
    if not deviation:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (score - F.lit(mean)) / F.lit(deviation))


def label_high_low(df: DataFrame, value: str, pct: float = 50, out: str = "comparison") -> DataFrame:
    """Label rows above or below percentile ``pct`` of the fitted log-normal; rows without a score go.

    Comparing the score with the normal quantile of ``pct`` is the same as comparing percentiles.
    """
    pct = percentile("pct", pct)
    cut = None if pct == 100 else NormalDist().inv_cdf(pct / 100)
    scored = log_zscore(df, value, "_z")
    labelled = scored.withColumn(out, label_performance(F.col("_z"), cut)).drop("_z")
    return labelled.filter(F.col(out).isNotNull())


def zscore_percentile(df: DataFrame, value: str, with_percentile: bool = False) -> DataFrame:
    """``log_zscore`` as column ``z`` and, if asked for, its percentile."""
    scored = log_zscore(df, value)
    return scored.withColumn("percentile", normal_percentile(F.col("z"))) if with_percentile else scored


def daily_trend(series: DataFrame, value: str, days: int = 7, out: str = "trend", method: str = "mean") -> DataFrame:
    """Smoothed value over the days within ``days`` of each (series, date) row.

    ``mean`` is the centred moving average. ``linear`` fits a straight line to the same days and takes its value at the
    day, which does not lag at the ends of a series or on slopes; it is the mean where the days are one. ``local`` is
    local regression: a parabola fitted with tricube weights that fall to zero at ``days + 1``, a line where two days
    have a value, that value where one has.
    For daily aggregates: a series has at most one row per day of the calendar.
    """
    at_least("days", days, 0)
    one_of("method", method, TREND_METHODS)
    number = F.unix_date("date")
    around = Window.partitionBy("series").orderBy(number).rangeBetween(-days, days)
    mean = F.avg(value).over(around)
    if method == "mean":
        return series.withColumn(out, mean)
    if method == "local":
        # at most 2 * days + 1 entries, one per day
        valued = F.when(F.col(value).isNotNull(), F.struct(number.alias("day"), F.col(value).cast("double").alias("value")))
        near = series.withColumns({"_near": F.collect_list(valued).over(around), "_mean": mean})
        return near.withColumn(out, F.coalesce(_local_value("_near", number, days + 1), "_mean")).drop("_near", "_mean")
    slope = F.regr_slope(F.col(value).cast("double"), number.cast("double")).over(around)
    line = mean + slope * (number - F.avg(F.when(F.col(value).isNotNull(), number)).over(around))
    return series.withColumn(out, F.coalesce(line, mean))


def _local_value(near: str, day: Column, width: int) -> Column:
    """Value at ``day`` of the polynomial fitted to a row's (day, value) entries with tricube weights; null without one day.

    Distances count in widths from the row's own day, so that sums of their fourth powers lose no digits: sums of
    powers of the date itself, from which running totals could be subtracted, would lose all of them.
    """

    def weighted(power: int, valued: bool = False) -> Column:
        def add(total: Column, entry: Column) -> Column:
            distance = (entry["day"] - day) / F.lit(float(width))
            term = F.pow(1 - F.pow(F.abs(distance), F.lit(3)), F.lit(3)) * F.pow(distance, F.lit(power))
            return total + (term * entry["value"] if valued else term)

        return F.aggregate(near, F.lit(0.0), add)

    s0, s1, s2, s3, s4 = (weighted(power) for power in range(5))
    t0, t1, t2 = (weighted(power, valued=True) for power in range(3))
    parabola = F.try_divide(
        t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2),
        s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2),
    )
    line = F.try_divide(t0 * s2 - t1 * s1, s0 * s2 - s1 * s1)
    return F.when(F.size(near) > 2, parabola).when(F.size(near) == 2, line)
