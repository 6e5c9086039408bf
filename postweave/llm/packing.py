"""Packing by power-of-two decomposition.

A document's token sequence is cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then the binary digits of the rest. A sequence is one piece, so none crosses documents and none needs padding.
Sequences of one length form a bucket, and sequence numbers run through the buckets from the longest to the shortest.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CACHED_WORDS = 600_000
# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 1024

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_TOKENS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """The powers of two that make up ``tokens``, longest first."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << bit for bit in range(longest.bit_length() - 2, -1, -1) if rest >> bit & 1]


class CachedTokenizer(dict):
    """Token ids of whole texts as little-endian 32-bit bytes.

    The pre-tokenisation of a byte-level BPE never joins what stands on both sides of the start of a run of white space,
    so words with the space before them are encoded once and remembered, up to ``CACHED_WORDS`` of them. Words are
    encoded by ``tiktoken`` from the vocabulary of the tokenizer file, several times faster than by the file's own
    library and to the same ids. Texts with longer runs of white space or with a special token's string, and all
    texts where the file is of another kind, are given to that library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.runs = re.compile(r"\s\s")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.encode = self._word_encoder(spec)

    def _word_encoder(self, spec: dict):
        """A function from a text to its ids, None unless the file holds a byte-level BPE in rank order."""
        import tiktoken

        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = not spec.get("normalizer") and not spec.get("post_processor") and not model.get("end_of_word_suffix")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not plain:
            return None
        chars = _byte_characters()
        ranks = {bytes(chars[c] for c in token): at for token, at in model["vocab"].items() if token not in self.special}
        made = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return made.encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        made = self[unit] = array("I", self.encode(unit)).tobytes()
        return made

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.encode is None or self.runs.search(text) or any(token in text for token in self.special):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        units = [first] * bool(first) + [" " + word for word in rest]
        return b"".join(map(self.__getitem__, units))


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + k): byte for k, byte in enumerate(rest)}


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> CachedTokenizer:
    """One per worker process, kept from task to task."""
    return CachedTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and with ``with_ids`` the ids themselves.

    ``tokenizer`` is the path of a tokenizer file on every executor. A null or empty text is the end id alone. Rows
    with a null or repeated doc_id are packed like any other; columns but doc_id and text are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = _tokenizer(tokenizer)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            kept = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = model.ids(text.as_py() or "") + tail
                total = len(ids) // 4
                start = 0
                for length in piece_lengths(total, longest):
                    own = ids[start * 4 : (start + length) * 4]
                    row = (doc_id, start, length, zlib.crc32(own), total)
                    kept.append(row + (own,) if with_ids else row)
                    start += length
                    held += length * with_ids
                    if held > 1 << 20 or len(kept) > 100_000:
                        yield _batch(kept, with_ids)
                        kept, held = [], 0
            if kept:
                yield _batch(kept, with_ids)

    return docs.select("doc_id", "text").mapInArrow(pieces, _TOKENS if with_ids else _PIECES)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    arrays = [pa.array([row[i] for row in rows], type=pa.int64()) for i in range(5)]
    if with_ids:
        arrays.append(pa.array([row[5] for row in rows], type=pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Add sequence_id and offset: each piece is a sequence, numbered without gaps by bucket, longest first.

    Pieces are spread over hashed bins, which no length and no document can fill alone; the bins' counts are the
    only rows that are ordered in one place (bins times lengths).
    """
    keyed = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BINS)).cast("int"))
    counts = keyed.groupBy("length", "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length"), "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("length", "bin", before.alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "bin").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    placed = keyed.withColumn("within", within).join(F.broadcast(first), ["length", "bin"])
    return placed.withColumn("sequence_id", (F.col("first") + F.col("within")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("bin", "first", "within")


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Sequences of at most ``longest`` tokens, one piece each, without any padding.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id and
    offset. An empty table gives no rows; nulls, repeats and other columns are as in ``token_pieces``. The bins'
    counts are broadcast: at most ``BINS`` times the number of lengths.
    """
    from postweave.llm.stored import stored

    pieces = stored(token_pieces(docs, tokenizer, longest, end_id), "pieces")
    return number_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
