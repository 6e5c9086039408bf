import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postweave.llm import chat_format as cf

CONVERSATIONS = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "### ", "###", "</turn>", "#", " ", "Assistant: ", ":", "\n", "é", "😀", "</turn", ">", "a", "\\\\"]


def written(said):
    """A text of pieces that look like marks."""
    draw = random.Random(said)
    return "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([*PIECES, "user", "system"]), max_size=4), st.lists(st.sampled_from(PIECES), max_size=12)), max_size=4))
def test_marks_in_texts_and_roles_come_back(turns):
    turns = [("".join(role), "".join(text)) for role, text in turns]
    form = "".join(cf.TEMPLATE.opening(role) + cf.TEMPLATE.escaped(text) + cf.TEMPLATE.closing for role, text in turns)
    assert list(cf.TEMPLATE.read_turns(form)) == turns


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in (
        {"escape": "\\\\"},
        {"mark": "<\\"},
        {"mark": "</turn>!"},
        {"labels": {"user": "A", "bot": "A"}},
        {"labels": {"user": "a: b"}},
        {"labels": {"user": "@user"}},
        {"start": "nowhere"},
        {"moves": {"start": {"user": "lost"}}},
    ):
        with pytest.raises(ValueError):
            cf.Template(**wrong)
    for text in ("x", "### User hi</turn>\n", "### User: hi", "### User: hi\\</turn>\n", "### Nobody: hi</turn>\n", "### User: hi</turn>"):
        with pytest.raises(ValueError):
            list(cf.TEMPLATE.read_turns(text))


def plain(rows):
    """{conv_id: digest row} without escapes or marks but for their number."""
    conversations = {}
    for conv_id, turn, role, text in rows:
        conversations.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    made = {}
    for conv_id, turns in conversations.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        learnt = "".join(text for role, text in turns if role == "assistant")
        form = "".join(cf.TEMPLATE.opening(r) + cf.TEMPLATE.escaped(t) + cf.TEMPLATE.closing for r, t in turns)
        made[conv_id] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(learnt),
            hashlib.sha256(learnt.encode()).hexdigest(),
            len(form),
        )
    return made


@pytest.fixture(scope="module")
def rows():
    made = [(k, t, ["user", "assistant"][t % 2], written(f"{k}.{t}")) for k in range(20) for t in range(k % 7)]
    made += [(100, t, ["user", "assistant"][t % 2], written(f"long {t}")) for t in range(90)]  # several blocks
    made += [(None, 0, "user", "x"), (None, 1, "assistant", None), (31, None, "user", "first"), (31, 0, None, "second")]
    made += [(32, 0, "tool: x", "a\\"), (32, 0, "user", "b"), (32, 0, "user", "a"), (32, 0, "user", "a"), (33, -9, "", ""), (33, 4, "Assistant", "not learnt")]
    made += [(34, 0, "assistant", "é " * 200_000 + "</turn>")]
    return made


def test_digest_against_plain_python(spark, rows, crowded):
    table = spark.createDataFrame(rows, CONVERSATIONS)
    said = "\\### Assistant: </turn> ok"
    expected = plain([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    for parts in (1, 5):
        made = {row[0]: tuple(row)[1:] for row in cf.digest(crowded(table.repartition(parts))).collect()}
        assert made == expected
    assert expected[-7][2] == len(said)


@pytest.mark.parametrize("block", (4, 7))
def test_long_conversations_over_several_blocks(spark, rows, block):
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(6)
    whole, cut = cf.format_turns(table), cf.format_turns(table, block=block)
    columns = ["conv_id", "turn", "place", "role", "allowed", "state", "segments"]
    key = lambda row: repr(row)
    assert sorted(whole.select(columns).collect(), key=key) == sorted(cut.select(columns).collect(), key=key)
    assert {row.single for row in cut.filter("conv_id = 100").collect()} == {False}
    expected = plain(rows)
    for in_order in (True, False):
        made = {row[0]: tuple(row)[1:] for row in cf.read_back(cut, in_order=in_order).collect()}
        assert made == expected


def test_turn_order(spark):
    orders = {
        1: ("system user assistant user assistant", True, True, None),
        2: ("user assistant user", True, False, None),
        3: ("assistant user", False, False, 0),
        4: ("user user assistant", False, False, 1),
        5: ("user system assistant", False, False, 1),
        6: ("user tool assistant", False, False, 1),
        7: ("system assistant", False, False, 1),
        8: ("user assistant assistant user assistant", False, False, 2),
    }
    rows = [(k, t, role, "x") for k, (roles, *_) in orders.items() for t, role in enumerate(roles.split())]
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    for block in (2, 4096):
        formatted = cf.format_turns(table, block=block)
        made = {row.conv_id: (row.valid, row.complete, row.first_bad) for row in cf.orders(formatted).collect()}
        assert made == {k: tuple(rest) for k, (_, *rest) in orders.items()}
        assert {r.conv_id: [s.loss for s in r.segments] for r in formatted.filter("role <> 'assistant'").collect()}.popitem()[1] == [False] * 3


def test_another_template(spark):
    template = cf.Template(
        labels={"human": "H", "bot": "B"},
        learn=frozenset({"bot", "human"}),
        moves={"open": {"human": "said"}, "said": {"bot": "open"}},
        start="open",
        final=frozenset({"open"}),
        mark="<|",
        end="|>",
        tail="",
        other="?",
        escape="~",
    )
    rows = [(1, 0, "human", "a|>~<|H: b"), (1, 1, "bot", "~"), (1, 2, "H", "|>")]
    formatted = cf.format_turns(spark.createDataFrame(rows, CONVERSATIONS), template)
    text = "".join(s.text for row in sorted(formatted.collect(), key=lambda r: r.place) for s in row.segments)
    assert text == "<|H: a~|>~~~<|H: b|><|B: ~~|><|?H: ~|>|>"
    assert list(template.read_turns(text)) == [row[2:] for row in rows]
    back = cf.read_back(formatted, template).first()
    assert (back.n_turns, back.loss_chars) == (3, len(rows[0][3]) + 1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert cf.format_turns(empty).count() == 0 and cf.read_back(cf.format_turns(empty)).count() == 0
    assert [row.conv_id for row in cf.digest(empty).collect()] == [-7]
