"""Top-n selections, positions and sorts.

Selections work from the n-th value. Rows are counted per distinct value on the map side, so that what
has to be ordered is n distinct values with their multiplicities, from however many rows and tasks.
One filter then keeps the rows that reach the n-th value, wherever they are: no task receives a
whole group, however many rows tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.operators.joins import join_groups
from postweave.operators.order_statistics import values_at
from postweave.params import at_least

# The most distinct values that are put in one list.
LISTED = 10_000


def top_n(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows whose value is among the ``n`` largest, ties of the n-th kept."""
    at_least("n", n, 1)
    return df.filter(F.col(value) >= nth_value(df, value, n))


def nth_value(df: DataFrame, value: str, n: int, descending: bool = True) -> Column:
    """The ``n``-th largest (or smallest) value of a column, or the last if there are fewer; a subquery.

    Up to ``LISTED`` it comes from a list of n distinct values; beyond, numbers, dates and times are found by
    counting ranges of values, so that no task holds n of them; other columns always come from the list.
    """
    tally = df.select(value).dropna().groupBy(value).agg(F.count(F.lit(1)).alias("times"))
    if n > LISTED and isinstance(df.schema[value].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        rank = f"greatest(_total - {n}, 0)" if descending else f"least({n} - 1, _total - 1)"
        return values_at(tally, [], value, "times", {"nth": rank}).scalar()
    extreme = tally.orderBy(F.desc(value) if descending else F.asc(value)).limit(n)
    listed = F.sort_array(F.collect_list(F.struct(F.col(value).alias("value"), "times")), asc=not descending)
    start = F.struct(F.lit(0).cast("bigint").alias("passed"), F.lit(None).cast(df.schema[value].dataType).alias("value"))

    def step(reached: Column, entry: Column) -> Column:
        passed = (reached["passed"] + entry["times"]).alias("passed")
        return F.when(reached["passed"] < n, F.struct(passed, entry["value"].alias("value"))).otherwise(reached)

    return extreme.agg(F.aggregate(listed, start, step, lambda reached: reached["value"]).alias("nth")).scalar()


def top_n_by_group(df: DataFrame, group: str, value: str, n: int, few_groups: bool = False) -> DataFrame:
    """``top_n`` within each group.

    Values are counted per group first, on the map side, so that what is ranked is each group's n
    largest distinct values with their multiplicities. A missing group is a group. ``few_groups`` broadcasts the cuts, one row
    per group; pass it where the number of groups is bounded.
    """
    at_least("n", n, 1)
    tally = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_times"))
    downward = Window.partitionBy(group).orderBy(F.desc(value))
    largest = tally.withColumn("_place", F.row_number().over(downward)).filter(F.col("_place") <= n)
    above = F.sum("_times").over(downward.rowsBetween(Window.unboundedPreceding, -1))
    reached = largest.withColumn("_above", F.coalesce(above, F.lit(0))).filter(F.col("_above") < n)
    cuts = reached.groupBy(group).agg(F.min(value).alias("_cut"))
    joined = join_groups(df, cuts, group, few_groups)
    return joined.filter(F.col(value) >= F.col("_cut")).select(*df.columns)


def top_k_exact(df: DataFrame, group: str, value: str, k: int, tie: str) -> DataFrame:
    """Exactly ``k`` rows per group (fewer in a smaller group): largest value, then smallest ``tie``."""
    return _first_rows(df, group, k, F.desc(value), F.asc(tie))


def capped_top(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group in the order of ``label``: a cap that ignores the value."""
    return _first_rows(df, group, k, F.asc(label))


def _first_rows(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    # every task prunes its rows to k per group before the shuffle (WindowGroupLimit)
    at_least("k", k, 1)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def rank_within(df: DataFrame, group: Sequence[str], value: str, tie: str, out: str = "ord") -> DataFrame:
    """Position of each row in its group by value, then ``tie``: the order of bars in a chart.

    For selections already cut to their top rows, as every row of a group is numbered in one task.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(value, tie)))


def sort_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort as the last step; a unique last key spreads equal values over the sorted partitions."""
    return df.orderBy(*order)


def first_by(df: DataFrame, column: str, n: int, tie: str, descending: bool = False) -> DataFrame:
    """The first ``n`` rows in the order of ``column``, then ``tie``; missing values come last.

    The n-th value of the column and, among the rows that have it, the n-th tie are found from those
    two columns alone. As a filter they reach the scan, so of the wide columns, such as texts, little
    more is read than what is returned.
    """
    at_least("n", n, 0)
    value = F.col(column)
    edge = nth_value(df, column, n, descending)
    ties = df.filter(value == edge).select(tie).orderBy(tie).limit(n)
    last_tie = ties.agg(F.max(tie).alias("last")).scalar()
    before = value > edge if descending else value < edge
    near = before | ((value == edge) & (F.col(tie) <= last_tie)) | value.isNull()
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.filter(near).orderBy(order, tie).limit(n)


def preview(posts: DataFrame, n: int = 6) -> DataFrame:
    """The first ``n`` posts by date and id."""
    return first_by(posts, "created_at", n, tie="status_id")
