"""Benchmark decontamination by template canonicalisation.

Texts become typed tokens: numbers turn into ``<num>``, a unit after a number into ``<unit>``, capitalised words inside
a sentence into ``<name>``, and the word that opens a sentence, which may be a name or not, into ``<open>``; other words, those
all in capitals among them, are lower-cased. Windows of ``WINDOW`` typed tokens of documents and benchmark items are
hash-joined, so a question whose numbers and names were changed keeps its windows. A document holds an item when it has
at least ``SIMILARITY`` of the item's windows and the slots agree: along the best alignment, each value of the item
stands for one value of the document, in at least that share of its places; where both have the same word there is no slot.

Each place of a document has one window, hashed from the hashes of its tokens, so the work is linear in a text's length.
Items of fewer tokens than a window are held by documents in which they stand, word for word, as sentences of their own.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.stored import stored

WINDOW = 5
SIMILARITY = 0.8
BROADCAST_WINDOWS = 1_000_000
# Units of measure that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi g kg mg lb lbs oz t ml l cl gal s sec secs min mins h hr hrs hour hours minute minutes second seconds "
    "day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles "
    "inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres "
    "gallon gallons percent degree degrees dollar dollars euro euros cent cents usd eur kb mb gb tb hz khz mhz ghz w kw v a"
).split()
_TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’.,:/-][\p{L}\p{M}\p{N}]+)*[.!?]?"


def _raw(text: Column) -> Column:
    """Tokens with the sentence mark that follows them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def _word(token: str) -> str:
    return f"lower(rtrim('.!?', {token}))"


def _opens(raw: str, at: str) -> str:
    """Whether the token at ``at`` is the first of a sentence."""
    return f"if({at} > 0, right({raw}[{at} - 1], 1) IN ('.', '!', '?'), true)"


def _typed(raw: str) -> Column:
    """The typed token for each of the column ``raw``."""
    units = ", ".join(f"'{unit}'" for unit in UNITS)
    return F.expr(
        f"transform({raw}, (t, i) -> CASE"
        f" WHEN ascii(t) BETWEEN 48 AND 57 THEN '<num>'"
        f" WHEN i > 0 AND ascii(if(i > 0, {raw}[i - 1], 'x')) BETWEEN 48 AND 57 AND {_word('t')} IN ({units}) THEN '<unit>'"
        f" WHEN {_opens(raw, 'i')} THEN '<open>'"
        f" WHEN left(t, 1) <> lower(left(t, 1))"
        f" AND length(rtrim('.!?', t)) > 1 AND substring(t, 2) = lower(substring(t, 2)) THEN '<name>'"
        f" ELSE {_word('t')} END)"
    )


def _hashed(typed: str) -> Column:
    return F.expr(f"transform({typed}, t -> xxhash64(t))")


def _windows(hashes: str, window: int) -> Column:
    """The hash of each run of ``window`` of the column ``hashes``; none where there are fewer."""
    run = ", ".join(f"{hashes}[i + {k}]" for k in range(window))
    return F.expr(f"if(size({hashes}) < {window}, array(), transform(sequence(0, greatest(size({hashes}) - {window}, 0)), i -> xxhash64({run})))")


def _sentences(raw: str, length: int) -> Column:
    """The hash of each run of ``length`` words that begins where a sentence does and ends where one does."""
    ends = f"if(i + {length} < size({raw}), right({raw}[i + {length - 1}], 1) IN ('.', '!', '?'), true)"
    words = ", ".join(_word(f"{raw}[i + {k}]") for k in range(length))
    starts = f"filter(sequence(0, greatest(size({raw}) - {length}, 0)), i -> {_opens(raw, 'i')} AND {ends})"
    return F.expr(f"if(size({raw}) < {length}, array(), transform({starts}, i -> xxhash64({length}, {words})))")


def _window_readings(window: int) -> Column:
    """For each window of an item the hashes it may have in a document, its own first.

    Documents have one reading, in which a sentence may begin elsewhere: the item's openers are also read as names and
    as words, and one of its other names and words as an opener.
    """
    choices = f"if(typed[i + k] = '<open>', array('<open>', '<name>', {_word('raw[i + k]')}), array(typed[i + k]))"
    every = f"aggregate(sequence(0, {window - 1}), array(cast(array() as array<string>)), (made, k) -> flatten(transform(made, m -> transform({choices}, c -> concat(m, array(c))))))"
    mixed = "transform({}, m -> xxhash64({}))".format(every, ", ".join(f"xxhash64(m[{k}])" for k in range(window)))
    moved = []
    for at in range(window):
        run = ", ".join("xxhash64('<open>')" if k == at else f"hashes[i + {k}]" for k in range(window))
        moved.append(f"if(typed[i + {at}] IN ('<num>', '<unit>'), w, xxhash64({run}))")
    return F.expr(f"transform(windows, (w, i) -> array_distinct(concat({mixed}, array({', '.join(moved)}))))")


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, item_sig, raw, typed and ``readings``: for each place of an item the hashes any of which holds it."""
    made = items.select("item_id", F.xxhash64("text").alias("item_sig"), _raw(F.col("text")).alias("raw"))
    made = made.dropDuplicates(["item_id", "item_sig"]).withColumn("typed", _typed("raw")).withColumn("hashes", _hashed("typed"))
    made = made.withColumn("windows", _windows("hashes", window))
    short = F.array().cast("array<array<bigint>>")
    for length in range(1, window):
        whole = ", ".join(_word(f"raw[{k}]") for k in range(length))
        short = F.when(F.size("raw") == length, F.expr(f"array(array(xxhash64({length}, {whole})))")).otherwise(short)
    readings = F.when(F.size("windows") > 0, _window_readings(window)).otherwise(short)
    return made.select("item_id", "item_sig", "raw", "typed", readings.alias("readings"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, item_windows, found, slots, consistent.

    ``found`` of the item's ``item_windows`` different windows stand in the document; ``consistent`` is the share of
    the ``slots`` compared that keep to one value (1 without slots). Null or empty texts hold nothing and are held
    by none. Documents with a null doc_id are told apart by their texts and reported with null; full repeats of a row
    are reported once. Rows of ``items`` that share an item_id are told apart likewise. Other columns are ignored.
    """
    found = _held(docs, items, window, similarity)
    return found.select("doc_id", "item_id", F.col("item_windows").cast("long").alias("item_windows"), "found", "slots", F.round("consistent", 6).alias("consistent"))


def _held(docs: DataFrame, items: DataFrame, window: int, similarity: float) -> DataFrame:
    """doc_id, sig (of the text), item_id, item_sig, item_windows, found, slots and consistent of what is held."""
    sig = F.xxhash64("text").alias("sig")
    item_tokens = _item_windows(items, window)
    different = F.size(F.array_distinct(F.transform("readings", lambda r: r[0])))
    listed = item_tokens.select("item_id", "item_sig", different.alias("item_windows"), F.explode_outer("readings").alias("readings"))
    # a window of the item counts once, whichever of its readings is met
    wanted = listed.select("item_id", "item_sig", "item_windows", F.col("readings")[0].alias("own"), F.explode_outer("readings").alias("window")).distinct()
    # outer explodes: an inner one infers a filter, for which Spark computes all that the array is made of once more, and
    # within lambdas once per element; empty arrays leave a null window, which joins with nothing
    # the benchmark is broadcast when it is measured to be small; a larger one is joined by shuffle
    few = items.limit(1).count() == 0 or wanted.count() <= BROADCAST_WINDOWS
    # lengths of the items that are shorter than a window: four at most
    lengths = [row[0] for row in item_tokens.filter(F.size("raw").between(1, window - 1)).select(F.size("raw")).distinct().collect()]

    tokens = docs.select("doc_id", sig, _raw(F.col("text")).alias("raw"))
    hashed = tokens.withColumn("typed", _typed("raw")).withColumn("hashes", _hashed("typed"))
    every = F.array_distinct(F.concat(_windows("hashes", window), *[_sentences("raw", length) for length in sorted(lengths)]))
    own = hashed.select("doc_id", "sig", F.explode_outer(every).alias("window"))
    met = own.join(F.broadcast(wanted) if few else wanted, "window")
    # full repeats of a row meet each window as often as there are rows
    counted = met.groupBy("doc_id", "sig", "item_id", "item_sig", "item_windows").agg(F.count_distinct("own").alias("found"))
    pairs = stored(counted.filter(F.col("found") >= F.ceil(F.col("item_windows") * similarity - 1e-9)), "held-items")

    pair = ["doc_id", "sig", "item_id", "item_sig"]
    held = pairs.select(F.col("doc_id").alias("pair_id"), F.col("sig").alias("pair_sig"), "item_id", "item_sig", "item_windows", "found")
    same = F.col("doc_id").eqNullSafe(F.col("pair_id")) & (F.col("sig") == F.col("pair_sig"))
    texts = docs.select("doc_id", sig, "text").join(held, same).select(*pair, "text").dropDuplicates(pair)
    # a row per window carries its own words, not the whole document's; items without a whole window have no slots
    runs = F.expr(f"transform(windows, (w, i) -> slice(raw, cast(i + 1 as int), {window}))")
    doc_side = texts.select(*pair, _raw(F.col("text")).alias("raw")).withColumn("typed", _typed("raw")).withColumn("hashes", _hashed("typed"))
    doc_side = doc_side.withColumn("windows", _windows("hashes", window)).withColumn("runs", runs)
    doc_side = doc_side.select(*pair, F.posexplode_outer(F.arrays_zip("windows", "runs")).alias("at", "one"))
    doc_side = doc_side.select(*pair, "at", F.col("one.windows").alias("window"), F.col("one.runs").alias("values"))
    item_side = item_tokens.filter(F.size("raw") >= window).select("item_id", "item_sig", F.posexplode_outer("readings").alias("item_at", "hashes"), "raw", "typed")
    item_side = item_side.select(
        F.col("item_id").alias("i_id"),
        F.col("item_sig").alias("i_sig"),
        "item_at",
        F.explode_outer("hashes").alias("i_window"),
        F.expr(f"slice(raw, item_at + 1, {window})").alias("item_values"),
        F.expr(f"slice(typed, item_at + 1, {window})").alias("types"),
    )
    on = F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_sig") == F.col("i_sig")) & (F.col("window") == F.col("i_window"))
    aligned = doc_side.join(F.broadcast(item_side) if few else item_side, on)
    aligned = aligned.dropDuplicates([*pair, "at", "item_at"])
    # an item's window is compared at the place on the diagonal with the most windows
    diagonal = Window.partitionBy(*pair, F.col("at") - F.col("item_at"))
    best = Window.partitionBy(*pair, "item_at").orderBy(F.desc("on_diagonal"), "at")
    aligned = aligned.withColumn("on_diagonal", F.count("*").over(diagonal)).withColumn("place", F.row_number().over(best)).filter("place = 1")
    slots = aligned.select(*pair, "item_at", F.posexplode(F.arrays_zip("types", "item_values", "values")).alias("k", "slot"))
    values = slots.select(
        *pair,
        F.col("slot.types").alias("type"),
        F.expr(_word("slot.item_values")).alias("item_value"),
        F.expr(_word("slot.values")).alias("value"),
        (F.col("item_at") + F.col("k")).alias("slot_at"),
    ).distinct()
    # openers and words are slots where the document has another word
    values = values.filter("type IN ('<num>', '<unit>', '<name>') OR item_value <> value")
    tallied = values.groupBy(*pair, "item_value", "value").agg(F.count("*").alias("n"))
    shares = tallied.groupBy(*pair, "item_value").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    agreed = shares.groupBy(*pair).agg(F.sum("all").alias("slots"), F.sum("most").alias("kept"))
    renamed = agreed.select(*[F.col(c).alias(f"s_{c}") for c in pair], "slots", "kept")
    match = F.lit(True)
    for column in pair:
        match = match & F.col(column).eqNullSafe(F.col(f"s_{column}"))
    judged = pairs.join(renamed, match, "left").withColumn("slots", F.coalesce("slots", F.lit(0)).cast("long"))
    judged = judged.withColumn("consistent", F.when(F.col("slots") == 0, 1.0).otherwise(F.col("kept") / F.col("slots")))
    return judged.filter(F.col("consistent") >= similarity)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept. Rows that share a doc_id, or have none, go by their own text."""
    found = _held(docs, items, WINDOW, SIMILARITY).select(F.col("doc_id").alias("held id"), F.col("sig").alias("held sig")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("held id")) & (F.xxhash64("text") == F.col("held sig"))
    return docs.join(found, same, "left_anti")
