import random
import re
from collections import defaultdict

import pytest

from postweave.llm import line_dedup


def brute(docs):
    """Kept text of each row by the definition: all templates of all lines, in a dictionary."""

    def templates(tokens):
        n = len(tokens)
        parts = min(n, 10)
        cut = [s * n // parts for s in range(parts + 1)]
        yield n, tuple(tokens)
        for i in range(parts):
            for j in range(i, parts):
                if sum(cut[s + 1] - cut[s] for s in {i, j}) <= n // 5:
                    rest = tuple(None if s in (i, j) else tuple(tokens[cut[s] : cut[s + 1]]) for s in range(parts))
                    yield n, tuple(tokens[:3]), i, j, rest

    held, per_line = defaultdict(set), {}
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n") if doc_id is not None else []):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split("[\x20\x09-\x0d]+", line) if t]
            if len(tokens) >= 3:
                per_line[doc_id, text, k] = list(templates(tokens))
                for template in per_line[doc_id, text, k]:
                    held[template].add(doc_id)
    made = []
    for doc_id, text in docs:
        if text is None:
            made.append((doc_id, None))
            continue
        lines = enumerate(text.split("\n"))
        kept = [l for k, l in lines if not any(len(held[t]) > 1 and min(held[t]) < doc_id for t in per_line.get((doc_id, text, k), ()))]
        made.append((doc_id, "\n".join(kept)))
    return sorted(made, key=repr)


def kept(docs):
    return sorted(((row.doc_id, row.text) for row in line_dedup.line_digest(docs).collect()), key=repr)


def test_equals_brute_force(make_docs, crowded, prose):
    draw = random.Random(5)
    footer = "Posted by {} on 2024-01-{} in the section {} of our site , all rights reserved"
    rows = [(k, "\n".join([prose(k, 12), footer.format(draw.choice("xyz"), k, draw.choice("abc")), prose(k % 4, 25)])) for k in range(25)]
    base = prose(200, 30).split()
    rows += [(50 + k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(0, 30, 4)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, "a b"), (34, "a b"), (35, "one two three"), (36, "one two three\none two three")]
    rows += [(37, prose(37)), (37, prose(37)), (37, "another text\n" + prose(0, 12)), (None, prose(0, 12)), (None, None), (38, "é\r\n" * 2000), (39, "a\n" * 20_000)]
    assert kept(crowded(make_docs(*rows))) == brute(rows)


def test_variable_fields(make_docs):
    lines = ["Your order 17 from Ann will arrive on Monday at the shop in town", "Your order 230 from Bob will arrive on Friday at the shop in town"]
    docs = make_docs((1, lines[0] + "\nmine alone it is"), (2, lines[1] + "\nhis alone it was not"))
    assert kept(docs) == [(1, lines[0] + "\nmine alone it is"), (2, "his alone it was not")]


def test_the_first_document_keeps_its_lines(make_docs):
    docs = make_docs(*[(k, "a common line of text") for k in range(5, 0, -1)])
    assert kept(docs) == [(1, "a common line of text")] + [(k, "") for k in range(2, 6)]


def test_columns_and_empty_table(make_docs):
    docs = make_docs((1, "a b c\nd"), (2, "a b c\nd"))
    made = line_dedup.keep_first_lines(docs)
    assert made.columns == docs.columns
    assert {row.doc_id: (row.text, row.n_chars) for row in made.collect()} == {1: ("a b c\nd", 7), 2: ("d", 1)}
    assert line_dedup.line_digest(docs.filter("false")).count() == 0


@pytest.mark.parametrize("operator", [line_dedup.line_digest, line_dedup.dropped_lines])
def test_no_pairs_in_the_plan(make_docs, operator):
    plan = operator(make_docs((1, "a b c")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
