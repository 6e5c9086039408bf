"""Chat formatting: conversations to marked text with a loss flag for every piece of it.

A ``Template`` declares how turns look and in which order roles may speak; nothing else knows a role by name. Its turn order
is a finite-state machine, and each turn becomes three segments: what opens it, its text and what closes it. The text is
escaped, so that marks within it are told from the template's, and ``read_turns`` gives back roles and texts exactly.

Turns are dealt by conversation and block of turn numbers, so a very long conversation is spread over tasks. A first pass
over roles alone folds each block to a map from the state before it to the state after it; from these maps follow each
block's first state and place, which come to the block's turns as a marker row sorted before them. Rows are read as a sorted
stream: no conversation is ever held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096
FLUSH_CHARS = 1 << 22
FLUSH_ROWS = 2000


@dataclass(frozen=True)
class Template:
    """How turns are marked and ordered.

    A turn is ``mark``, the role's label, ``": "``, the escaped text, ``end`` and ``tail``. Roles without a label show as
    ``other`` and their escaped name. ``escape`` goes before itself, ``mark`` and ``end`` within texts. ``moves`` gives for
    each state the roles that may speak and the state each leads to; a conversation is complete in a state of ``final``.
    Text of the roles in ``learn`` counts for the loss.
    """

    labels: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learn: frozenset[str] = frozenset({"assistant"})
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    start: str = "start"
    final: frozenset[str] = frozenset({"answered"})
    mark: str = "### "
    end: str = "</turn>"
    tail: str = "\n"
    other: str = "@"
    escape: str = "\\"

    def __post_init__(self):
        if len(self.escape) != 1 or not self.mark or not self.end or not self.other:
            raise ValueError("escape is one character; mark, end and other are not empty")
        if self.escape in self.mark + self.end or self.mark in self.end or self.end in self.mark:
            raise ValueError("mark and end hold neither the escape character nor each other")
        labels = list(self.labels.values())
        if len(set(labels)) < len(labels):
            raise ValueError("two roles share a label")
        for label in labels:
            if label.startswith(self.other) or any(sign in label for sign in (":", self.escape, self.mark, self.end)):
                raise ValueError(f"label {label!r} holds a control string")
        unknown = {to for moves in self.moves.values() for to in moves.values()} | {self.start} | set(self.final)
        if unknown - set(self.moves):
            raise ValueError(f"states without moves: {sorted(unknown - set(self.moves))}")

    @cached_property
    def states(self) -> list[str]:
        return list(self.moves)

    @cached_property
    def _landing(self) -> dict[str, str]:
        """The state a role leads to where it may not speak: that of the first state in which it may."""
        return {role: to for moves in reversed(list(self.moves.values())) for role, to in moves.items()}

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """(state after ``role`` speaks, whether it may speak in ``state``); a role of no move changes nothing."""
        to = self.moves[state].get(role)
        return (self._landing.get(role, state), False) if to is None else (to, True)

    @cached_property
    def _controls(self) -> str:
        return "|".join(re.escape(sign) for sign in (self.escape, self.mark, self.end))

    @cached_property
    def _to_escape(self) -> re.Pattern:
        return re.compile(f"({self._controls})")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}({self._controls}|:)")

    @cached_property
    def _scan(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}(?:{self._controls}|:)|{re.escape(self.mark)}|{re.escape(self.end)}")

    def escaped(self, text: str) -> str:
        if self.escape not in text and self.mark not in text and self.end not in text:
            return text
        return self._to_escape.sub(lambda found: self.escape + found[0], text)

    def unescaped(self, text: str) -> str:
        return self._escaped.sub(lambda found: found[1], text) if self.escape in text else text

    def opening(self, role: str) -> str:
        label = self.labels.get(role)
        if label is None:
            label = self.other + self.escaped(role).replace(":", self.escape + ":")
        return f"{self.mark}{label}: "

    @cached_property
    def closing(self) -> str:
        return self.end + self.tail

    def read_turns(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn in formatted text."""
        roles = {label: role for role, label in self.labels.items()}
        label_end = re.compile(f"((?:[^:{re.escape(self.escape)}]|{re.escape(self.escape)}.)*): ", re.DOTALL)
        at = 0
        while at < len(text):
            if not text.startswith(self.mark, at):
                raise ValueError(f"no turn opens at {at}")
            found = label_end.match(text, at + len(self.mark))
            if found is None:
                raise ValueError(f"no label ends after {at}")
            label, first = found[1], found.end()
            role = roles.get(label)
            if role is None:
                if not label.startswith(self.other):
                    raise ValueError(f"unknown label at {at}")
                role = self.unescaped(label[len(self.other) :])
            last = text.find(self.end, first)
            if last >= 0 and text.find(self.escape, first, last) >= 0:
                last = next((token.start() for token in self._scan.finditer(text, first) if token[0] == self.end), -1)
            if last < 0 or not text.startswith(self.tail, last + len(self.end)):
                raise ValueError(f"the turn at {at} does not end")
            yield role, self.unescaped(text[first:last])
            at = last + len(self.closing)


TEMPLATE = Template()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, FLUSH_ROWS):
            yield from zip(*[column.to_pylist() for column in batch.slice(first, FLUSH_ROWS).columns])


def _gathered(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``FLUSH_ROWS`` rows and about ``FLUSH_CHARS`` characters, as ``size`` counts a row's."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if len(held) == FLUSH_ROWS or chars >= FLUSH_CHARS:
            yield _batch(held, schema)
            held, chars = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, part.type) for values, part in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _entries(rows: DataFrame, template: Template) -> DataFrame:
    """conv_id, block, state, place: where each block of a conversation of several blocks begins."""
    states = template.states
    number = {state: k for k, state in enumerate(states)}
    ident = rows.schema["conv_id"]
    folded = T.StructType([ident]).add("block", "long").add("turns", "long").add("after", T.ArrayType(T.IntegerType()))
    begun = T.StructType([ident]).add("block", "long").add("state", "integer").add("place", "long")

    def fold(batches):
        def blocks():
            own = None
            for conv_id, block, role in _stream(batches):
                if own != (conv_id, block):
                    if own is not None:
                        yield (*own, turns, [number[state] for state in after])
                    own, turns, after, known = (conv_id, block), 0, list(states), {}
                turns += 1
                if role not in known:
                    known[role] = {state: template.step(state, role)[0] for state in states}
                after = [known[role][state] for state in after]
            if own is not None:
                yield (*own, turns, [number[state] for state in after])

        return _gathered(blocks(), _arrow(folded), lambda row: 64)

    def begin(batches):
        def blocks():
            own, first = None, None
            for conv_id, block, turns, after in _stream(batches):
                if own != (conv_id,):
                    own, place, state = (conv_id,), 0, number[template.start]
                    first = (conv_id, block, state, place)
                else:
                    if first is not None:
                        yield first
                        first = None
                    yield conv_id, block, state, place
                place, state = place + turns, after[state]

        return _gathered(blocks(), _arrow(begun), lambda row: 64)

    narrow = rows.select("conv_id", "block", "turn", "role").repartition("conv_id", "block")
    narrow = narrow.sortWithinPartitions("conv_id", "block", "turn", "role").select("conv_id", "block", "role")
    maps = narrow.mapInArrow(fold, folded).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return maps.mapInArrow(begin, begun)


def format_turns(conversations: DataFrame, template: Template = TEMPLATE, block: int = BLOCK) -> DataFrame:
    """A row per turn: conv_id, block, single, turn, place, role, allowed, state, segments.

    ``conversations`` has conv_id, turn (a whole number), role and text; other columns are ignored. ``segments`` are the
    turn's pieces (text, loss) in order; joined in order of ``place``, which counts a conversation's turns from 0, they are
    the formatted conversation. ``allowed`` says whether the role may speak there, ``state`` is the machine's after it; a turn
    out of order is formatted like any other. ``block`` is the turn number over ``block``, ``single`` whether the conversation has
    but one. Within a partition the rows of a block stand together, in order.

    Null texts and roles are empty; an empty role is one without label. Rows with a null conv_id are one conversation; a
    null turn comes first. Rows of one turn number go by role, then text; repeated rows are a turn each. An empty table gives
    no rows. Many rows of one turn number in one conversation are one block.
    """
    ident = conversations.schema["conv_id"].dataType
    rows = conversations.select(
        "conv_id",
        F.expr(f"cast(turn as bigint) div {int(block)}").alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    marks = _entries(rows, template)
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("turn", "long"), ("role", "string"), ("text", "string"))}
    first = marks.select("conv_id", "block", F.lit(0).alias("kind"), *[c.alias(n) for n, c in nothing.items()], "state", "place")
    rest = rows.select("conv_id", "block", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("long").alias("place"))
    dealt = first.unionByName(rest).repartition("conv_id", "block")
    dealt = dealt.sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", ident), T.StructField("block", T.LongType())])
    for name, kind in (("single", "boolean"), ("turn", "long"), ("place", "long"), ("role", "string"), ("allowed", "boolean"), ("state", "string")):
        schema = schema.add(name, kind)
    schema = schema.add("segments", T.ArrayType(T.StructType().add("text", "string").add("loss", "boolean")))

    def made(batches):
        def turns():
            own = None
            for conv_id, at, kind, turn, role, text, begun, before in _stream(batches):
                if own != (conv_id, at):
                    own, single, state, place = (conv_id, at), True, template.start, 0
                if kind == 0:
                    single, state, place = False, template.states[begun], before
                    continue
                state, allowed = template.step(state, role)
                segments = [(template.opening(role), False), (template.escaped(text), role in template.learn), (template.closing, False)]
                yield conv_id, at, single, turn, place, role, allowed, state, [{"text": t, "loss": loss} for t, loss in segments]
                place += 1

        return _gathered(turns(), _arrow(schema), lambda row: 100 + len(row[-1][1]["text"]))

    return dealt.mapInArrow(made, schema)


def orders(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, turns, valid, complete, first_bad: what the state machine says of each formatted conversation.

    ``valid``: every turn was allowed; ``complete``: valid and ended in a final state; ``first_bad``: place of the first turn that
    was not allowed, null where all were.
    """
    counted = formatted.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.min(F.when(~F.col("allowed"), F.col("place"))).alias("first_bad"),
        F.max_by("state", "place").alias("last"),
    )
    valid = F.col("first_bad").isNull()
    return counted.select("conv_id", "turns", valid.alias("valid"), (valid & F.col("last").isin(*template.final)).alias("complete"), "first_bad")


def read_back(formatted: DataFrame, template: Template = TEMPLATE, in_order: bool = False) -> DataFrame:
    """A row per conversation, read from the text and flags of its segments alone.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 of the text under
    the loss flags, unescaped, and formatted_chars. Text that is not in the template's form is an error.
    ``in_order``: the rows lie as ``format_turns`` left them; else they are dealt and sorted once more.

    Conversations of one block are digested where they lie. Of others, what was read moves to one task for each, which reads
    it as a stream: a digest of a whole text has no parts that could be joined.
    """
    if not in_order:
        formatted = formatted.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    read = T.StructType([formatted.schema["conv_id"]])
    for name, kind in (("block", "long"), ("part", "long"), ("single", "boolean"), ("n_turns", "long"), ("turns", "binary")):
        read = read.add(name, kind)
    for name, kind in (("loss_chars", "long"), ("loss", "binary"), ("formatted_chars", "long")):
        read = read.add(name, kind)
    names = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    digests = T.StructType([formatted.schema["conv_id"]])
    for name in names[1:]:
        digests = digests.add(name, "string" if "sha" in name else "long")

    def parsed(segments) -> tuple[int, str, str, int]:
        """(turns, their digest text, text under the loss flags, characters) of some whole turns."""
        text = "".join(segment["text"] for segment in segments)
        turns = list(template.read_turns(text))
        learnt = template.unescaped("".join(segment["text"] for segment in segments if segment["loss"]))
        return len(turns), "".join(f"{role}\n{said}\n" for role, said in turns), learnt, len(text)

    def pieces(batches):
        def rows():
            own = None
            for conv_id, block, single, place, segments in _stream(batches):
                if own is not None and own != (conv_id, block):
                    yield from whole()
                    own = None
                turns, said, learnt, chars = parsed(segments)
                if not single:
                    yield conv_id, block, place, False, turns, said.encode(), len(learnt), learnt.encode(), chars
                    continue
                if own is None:
                    own, digest, loss, counts = (conv_id, block), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

                    def whole():
                        yield *own, 0, True, counts[0], digest.digest(), counts[1], loss.digest(), counts[2]

                digest.update(said.encode())
                loss.update(learnt.encode())
                counts[:] = counts[0] + turns, counts[1] + len(learnt), counts[2] + chars
            if own is not None:
                yield from whole()

        return _gathered(rows(), _arrow(read), lambda row: len(row[5]) + len(row[7]))

    def joined(batches):
        def rows():
            own = None
            for conv_id, single, turns, said, chars, learnt, size in _stream(batches):
                if own is not None and own != (conv_id,):
                    yield own[0], counts[0], digest.hexdigest(), counts[1], loss.hexdigest(), counts[2]
                    own = None
                if single:
                    yield conv_id, turns, said.hex(), chars, learnt.hex(), size
                    continue
                if own is None:
                    own, digest, loss, counts = (conv_id,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                digest.update(said)
                loss.update(learnt)
                counts = [counts[0] + turns, counts[1] + chars, counts[2] + size]
            if own is not None:
                yield own[0], counts[0], digest.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        return _gathered(rows(), _arrow(digests), lambda row: 200)

    parts = formatted.select("conv_id", "block", "single", "place", "segments").mapInArrow(pieces, read)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.select("conv_id", "single", "n_turns", "turns", "loss_chars", "loss", "formatted_chars").mapInArrow(joined, digests)


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and one more, of id -7, in which both turns say what looks like marks of the template."""
    said = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def digest(conversations: DataFrame) -> DataFrame:
    """The digest of all conversations and the probe, formatted and read back."""
    return read_back(format_turns(with_probe(conversations)), in_order=True)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
made AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
           ELSE '@' || replace(regexp_replace(role, '(\\|### |</turn>)', '\\\1', 'g'), ':', '\:') END AS label,
         regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g') AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || label || ': ' || escaped || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
