import random
import zlib

import numpy as np
import pytest

from postweave.llm import packing
from postweave.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizer_s_own(plain, prose):
    cached = packing.CachedTokenizer(tokenizer_path())
    draw = random.Random(3)
    texts = [prose(1), "a  b", "a \n b", "\n\nx", " lead", "trail ", "x<|endoftext|> y", "don't 12,3 \t\x1cq\x1f y", "日本 語　x", "é" * 50]
    texts += ["".join(draw.choice(" \n\ta.é1'sß ") for _ in range(30)) for _ in range(500)]
    for text in texts:
        expected = np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert cached.ids(text) == expected, repr(text)


def test_the_cache_is_bounded(monkeypatch, prose):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    cached = packing.CachedTokenizer(tokenizer_path())
    once, again = cached.ids(prose(2, 400)), cached.ids(prose(2, 400))
    assert once == again and len(cached) <= 50


@pytest.mark.parametrize("tokens", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_piece_lengths(tokens):
    lengths = packing.piece_lengths(tokens, 1024)
    assert sum(lengths) == tokens and lengths == sorted(lengths, reverse=True)
    assert all(length & (length - 1) == 0 and length <= 1024 for length in lengths)
    small = [length for length in lengths if length < 1024]
    assert len(small) == len(set(small))


def test_pieces_cover_each_document_once(make_docs, crowded, plain, prose):
    docs = [(1, prose(1)), (2, None), (3, ""), (4, prose(4, 9000)), (5, prose(1)), (5, prose(1)), (None, "no id")]
    rows = packing.pack(crowded(make_docs(*docs)), tokenizer_path()).collect()
    by_doc = {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        assert row.length & (row.length - 1) == 0 and row.offset == 0
    for doc_id, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        copies = sum(other == doc_id for other, _ in docs)
        pieces = sorted(by_doc[doc_id], key=lambda row: row.start)
        assert sum(row.length for row in pieces) == len(ids) * copies
        for row in pieces:
            part = np.array(ids[row.start : row.start + row.length], dtype="<u4").tobytes()
            assert row.ids_crc32 == zlib.crc32(part) and row.doc_tokens == len(ids)
    ordered = sorted(rows, key=lambda row: row.sequence_id)
    assert [row.sequence_id for row in ordered] == list(range(len(rows)))
    assert [row.length for row in ordered] == sorted((row.length for row in rows), reverse=True)


def test_ids_on_request_and_empty_table(make_docs, prose):
    docs = make_docs((1, prose(1)))
    row = packing.token_pieces(docs, tokenizer_path(), with_ids=True).first()
    assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
    assert packing.pack(docs.filter("false"), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.token_pieces(docs, tokenizer_path(), longest=1000)
