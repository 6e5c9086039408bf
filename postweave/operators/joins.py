"""Joins in which a missing key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str] | str, small: bool = False, how: str = "inner") -> DataFrame:
    """Join per-group results to rows on ``keys``, nulls equal to nulls; ``df``'s key columns stay.

    ``small`` broadcasts ``groups``: for a number of groups that is bounded.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    named = groups.withColumnsRenamed({key: f"_joined {key}" for key in keys})
    same = reduce(lambda a, b: a & b, [F.col(f"`{key}`").eqNullSafe(F.col(f"`_joined {key}`")) for key in keys])
    return df.join(F.broadcast(named) if small else named, same, how).drop(*[f"_joined {key}" for key in keys])


# A key with over one in so many of the rows is dealt in pieces of about that size.
PIECES = 1000


def dealt_join(df: DataFrame, groups: DataFrame, tally: DataFrame, key: str, by: Sequence[str], missing: bool = True) -> DataFrame:
    """``join_groups`` on one key, in which the rows of a frequent key do not meet in one task.

    ``tally`` holds the number of ``df``'s rows per key as ``_rows``. The frequent keys, fewer than ``PIECES`` whatever the
    input, are broadcast with the number of pieces each is dealt into by a hash of the columns ``by``; a row
    of ``groups`` with such a key is repeated once for each piece: for one row per key, fewer than 2 * ``PIECES`` times in all.
    Without ``missing`` a null key meets none, which spares the sort two further keys.
    """
    total = tally.agg(F.sum("_rows")).scalar()
    pieces = F.ceil(F.col("_rows") * PIECES / total).cast("int")
    often = tally.filter(F.col("_rows") * PIECES > total).select(key, pieces.alias("_pieces"))
    number = F.coalesce("_pieces", F.lit(1))
    dealt = join_groups(df, often, key, True, "left").withColumn("_piece", F.pmod(F.xxhash64(*by), number).cast("int"))
    copies = join_groups(groups, often, key, True, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), number - 1)))
    dealt, copies = dealt.drop("_pieces"), copies.drop("_pieces")
    both = join_groups(dealt, copies, [key, "_piece"]) if missing else dealt.join(copies, [key, "_piece"])
    return both.drop("_piece")
