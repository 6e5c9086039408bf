"""Joins of tokens and posts with small tables whose size is measured first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.operators.joins import dealt_join

# A side is broadcast up to this many bytes of values; each executor holds one copy.
BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``table`` take at most ``limit`` bytes.

    The table is measured by one distributed aggregation; only the total reaches the driver.
    """
    per_row = F.lit(0).cast("bigint")
    for name in table.columns:
        width = F.octet_length(F.col(f"`{name}`").cast("string"))
        per_row = per_row + F.coalesce(width, F.lit(0)) + 16
    return (table.agg(F.sum(per_row)).first()[0] or 0) <= limit


def lexicon_join(words: DataFrame, lexicon: DataFrame, small: bool | None = None) -> DataFrame:
    """Inner join on ``word``; a word with several labels gives several rows.

    A lexicon that fits is broadcast, so the words are not shuffled. ``small`` passes on an earlier
    measurement. With a larger one, frequent words are dealt by their other columns.
    """
    if small is None:
        small = fits_broadcast(lexicon)
    if small:
        return words.join(F.broadcast(lexicon), "word")
    return _dealt_join(words, lexicon, [name for name in words.columns if name != "word"])


def _dealt_join(words: DataFrame, lexicon: DataFrame, by: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """Inner join on ``word`` by shuffle; frequent words are dealt by the columns ``by``.

    Words are frequent by their share of the rows of ``counted``, if given, instead of ``words``.
    """
    if not by:
        return words.join(lexicon, "word")
    words, others = words.dropna(subset=["word"]), [name for name in words.columns if name != "word"]
    counted = words if counted is None else counted.dropna(subset=["word"])
    tally = counted.groupBy("word").agg(F.count(F.lit(1)).alias("_rows"))
    labels = [name for name in lexicon.columns if name != "word"]
    return dealt_join(words, lexicon, tally, "word", by, missing=False).select("word", *others, *labels)


def count_sentiments(
    words: DataFrame, lexicon: DataFrame, keys: Sequence[str], small: bool | None = None
) -> DataFrame:
    """Sentiment words per key and sentiment, as column ``n``.

    With a broadcast lexicon, only the words it lists reach the shuffle. With a larger one, the words
    are counted per key before they are shuffled by word, which takes the repetition out of a
    frequent word's share; what remains of it is dealt by key.
    """
    keys = list(keys)
    if fits_broadcast(lexicon) if small is None else small:
        found = lexicon_join(words.select(*dict.fromkeys([*keys, "word"])), lexicon, small=True)
        return found.groupBy(*keys, "sentiment").agg(F.count(F.lit(1)).alias("n"))
    folded = words.groupBy(*dict.fromkeys([*keys, "word"])).agg(F.count(F.lit(1)).alias("_times"))
    # tallied as they come: the counts per key would be shuffled once more for it
    found = _dealt_join(folded, lexicon, [key for key in keys if key != "word"], words)
    return found.groupBy(*keys, "sentiment").agg(F.sum("_times").alias("n"))


def join_back_text(ranked: DataFrame, posts: DataFrame, small: bool = False) -> DataFrame:
    """Inner join of ranked ids with their posts by ``status_id``.

    Pass ``small`` when the ranked side is bounded, as after a top-k: it is broadcast then and the
    posts, which hold the texts, are only filtered.
    """
    return posts.join(F.broadcast(ranked) if small else ranked, "status_id")
