import hashlib
from collections import Counter

import pytest

from postweave.llm import substring_dedup
from postweave.llm.substring_dedup import remove_repeats


def brute(docs, window):
    count, words = Counter(), [(doc_id, (text or "").encode().split()) for doc_id, text in docs]
    for _, own in words:
        count.update(tuple(own[i : i + window]) for i in range(len(own) - window + 1))
    made = []
    for doc_id, own in words:
        gone = set()
        for i in range(len(own) - window + 1):
            if count[tuple(own[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(word for i, word in enumerate(own) if i not in gone)
        made.append((doc_id, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(made, key=repr)


@pytest.fixture
def docs(prose):
    passage = prose(100, 60)
    rows = [(k, f"{prose(k, 50)} {passage} {prose(50 + k, 3 * k)}") for k in range(12)]
    rows += [(20, prose(20)), (21, prose(20)), (22, "ab " * 300), (23, None), (24, ""), (25, "few words"), (26, "\t\n \x0b")]
    rows += [(27, prose(27, 35)), (28, prose(27, 35).replace(" ", "\n")), (29, prose(29, 34)), (30, prose(29, 34))]
    rows += [(31, prose(31)), (31, prose(31)), (None, prose(32)), (None, prose(32)), (33, "É ü " * 40)]
    rows += [(34, prose(34, 20_000) + " " + passage), (35, "x" * 300_000 + " " + passage)]
    return rows


def test_equals_brute_force(make_docs, crowded, docs):
    made = remove_repeats(crowded(make_docs(*docs, parts=4))).collect()
    assert sorted(map(tuple, made), key=repr) == brute(docs, 35)


def test_stretches_of_a_text_and_small_windows(make_docs, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", 100)
    assert sorted(map(tuple, remove_repeats(make_docs(*docs)).collect()), key=repr) == brute(docs, 35)
    some = [row for row in docs if row[0] not in (34, 35)]
    assert sorted(map(tuple, remove_repeats(make_docs(*some), window=3, run=2).collect()), key=repr) == brute(some, 3)


def test_a_sketch_too_small_loses_nothing(make_docs, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MIN_CELLS", 256)
    monkeypatch.setattr(substring_dedup, "MAX_CELLS", 256)
    assert sorted(map(tuple, remove_repeats(make_docs(*docs)).collect()), key=repr) == brute(docs, 35)


def test_text_on_request_and_empty_table(make_docs, prose):
    table = make_docs((1, "one two three four"), (2, "zero two three four five"))
    kept = {row.doc_id: row.text for row in remove_repeats(table, window=3, run=2, with_text=True).collect()}
    assert kept == {1: "one", 2: "zero five"}
    assert remove_repeats(table.filter("false")).count() == 0
