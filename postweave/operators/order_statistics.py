"""Values at given ranks of counted values, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.operators.joins import join_groups
from postweave.params import at_least

# Slots per unit of log(1 + |value|) in the first pass: at most about 45,000 slots per group for any
# 64-bit integer, each 0.1% wide. A slot that holds a rank is cut into equal parts of its own range.
_SLOTS = 512
_PARTS = 4096


def values_at(
    tally: DataFrame,
    groups: Sequence[str],
    value: str,
    times: str,
    ranks: Mapping[str, str],
    few_groups: bool = False,
    cuts: int = 2,
) -> DataFrame:
    """The values at ``ranks`` of each group, in the column's own type, counted from 0 upwards.

    A rank is an SQL expression of ``_total``, the number of values of the group; there is no value at a rank outside. ``tally``
    has one row per group and distinct value, of a number, date or timestamp, with its multiplicity in ``times``.

    The values are counted in slots whose order is that of the values; running totals over the slots tell which ones
    hold the ranks. Those are cut once more, from their least value to their largest, and only the
    distinct values of the parts that hold the ranks are put in order. So values that lie close together are spread
    as widely as values that do not. ``cuts=1`` leaves the second cut out: for whole numbers below 10^9, such as
    counts of likes, of which a slot holds at most two million.
    """
    at_least("cuts", cuts, 1)
    groups = list(groups)
    number = _number(tally, value)
    size = F.signum(number.cast("double")) * F.log1p(F.abs(number.cast("double")))
    slotted = tally.withColumns({"_value": number, "_slot": F.floor(size * _SLOTS)})
    whole = Window.partitionBy(*groups)
    slots = slotted.groupBy(*groups, "_slot").agg(
        F.sum(times).alias("_held"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
    )
    slots = slots.withColumns({"_below": _before("_held", whole.orderBy("_slot")), "_total": F.sum("_held").over(whole)})
    reached = slots.filter(_holds(ranks)).drop("_held")
    inside = join_groups(slotted, reached, [*groups, "_slot"], few_groups)
    keys = [*groups, "_slot"]
    if cuts > 1:
        inside, keys = _cut(inside, keys, times, ranks, few_groups), [*keys, "_part"]
    last = Window.partitionBy(*keys).orderBy("_value")
    ranked = inside.withColumns({"_below": F.col("_below") + _before(times, last), "_held": F.col(times)})
    found = [F.max(F.when(_holds({name: rank}), F.col(value))).alias(name) for name, rank in ranks.items()]
    return ranked.groupBy(*groups).agg(*found)


def _cut(inside: DataFrame, keys: Sequence[str], times: str, ranks: Mapping[str, str], few_groups: bool) -> DataFrame:
    """The values of those equal parts of the slots ``keys`` that hold a rank."""
    # differences are taken before values become doubles, which whole numbers from 2^53 on do not fit
    share = F.try_divide((F.col("_value") - F.col("_low")).cast("double"), (F.col("_high") - F.col("_low")).cast("double"))
    parted = inside.withColumn("_part", F.coalesce(F.floor(share * _PARTS), F.lit(0)))
    held = parted.groupBy(*keys, "_part", "_below", "_total").agg(F.sum(times).alias("_held"))
    along = Window.partitionBy(*keys).orderBy("_part")
    parts = held.withColumn("_below", F.col("_below") + _before("_held", along)).filter(_holds(ranks)).drop("_held")
    return join_groups(parted.drop("_below", "_total"), parts, [*keys, "_part"], few_groups)


def _number(tally: DataFrame, value: str) -> Column:
    """The value as a number of the same order, exact to subtract."""
    kind = tally.schema[value].dataType.typeName()
    if kind == "date":
        return F.unix_date(value)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(value).cast("timestamp"))
    return F.col(value).cast("decimal(20,0)") if kind == "long" else F.col(value)


def _before(times: str, ordered) -> Column:
    return F.coalesce(F.sum(times).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holds(ranks: Mapping[str, str]) -> Column:
    here = [(F.col("_below") <= F.expr(rank)) & (F.col("_below") + F.col("_held") > F.expr(rank)) for rank in ranks.values()]
    return reduce(lambda a, b: a | b, here)
