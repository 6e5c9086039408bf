"""Web archives and their index: WARC files written as locally sorted runs, read back, and merged into capture histories.

Every task writes one archive whose records are sorted by URL key and capture time. The files are gzipped text for Spark, with
the blank line that ends a WARC record as line end, so any file system that Spark knows will do; a gzipped file is read
by one task from its start, and its byte stream is parsed by the lengths in the records' headers, a record at a time.

The index of each archive is a sorted run. An external merge makes one order of them: runs are cut at the same
key ranges, and for each range a loser tree merges the pieces, one comparison per level for each row.
"""

from __future__ import annotations

import base64
import datetime as dt
import uuid
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.stored import stored
from postweave.sources.storage import fresh_folder

RECORD_END = b"\r\n\r\n"
FIRST_CAPTURE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
_INDEX = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, position long"
)


def url_key(url: str | None) -> str:
    """A key that sorts captures by host, the domain's parts reversed, then path and query; empty for no URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){tail}".lower()


def capture_time(page_id: int | None) -> str:
    """Pages carry no time of capture: they count as captured a second apart, in the order of their ids."""
    if page_id is None or not 0 <= page_id < 10**11:
        page_id = 0
    return (FIRST_CAPTURE + dt.timedelta(seconds=page_id)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record without the blank line that ends it: a response, or a revisit if ``refers_to`` names a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}")
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + RECORD_END + block


_PRINTABLE = "".join(chr(c) for c in range(33, 127))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to gzipped WARC files in ``folder``.

    Of rows with equal payloads those with the largest page_id are responses and the others revisits of it. Null ids
    come before all others; payloads that only rows with null ids have are all responses.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    again = own.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("rows")).filter("rows > 1")
    joined = own.join(again.select("digest", "latest"), "digest", "left")
    joined = joined.select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> latest, null, latest)").alias("refers_to"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times, texts = [], [], []
            columns = [batch.column(i) for i in range(5)]
            for page_id, url, payload, digest, refers_to in zip(*(column.to_pylist() for column in columns)):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                keys.append(url_key(url))
                times.append(capture_time(page_id))
                texts.append(record(page_id, url, payload, name, refers_to))
            arrays = [pa.array(keys, pa.string()), pa.array(times, pa.string()), columns[0], pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["url_key", "captured", "page_id", "record"])

    records = joined.mapInArrow(made, "url_key string, captured string, page_id long, record binary")
    run = records.sortWithinPartitions("url_key", "captured", "page_id").select(F.col("record").cast("string").alias("value"))
    run.write.option("lineSep", RECORD_END.decode()).option("compression", "gzip").text(folder)


def records_of(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(archive, record's number, headers, block) from the chunks between blank lines, in each archive's order.

    A block may hold blank lines itself, so chunks are put together until its length is reached.
    """
    archive, number, headers, parts, have, need = None, 0, None, [], 0, 0
    for name, chunk in chunks:
        if name != archive:
            if headers is not None:
                raise ValueError(f"{archive} ends within a record")
            archive, number = name, 0
        while True:
            if headers is None:
                lines = chunk.decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record where one should begin in {archive}")
                headers = dict(line.split(": ", 1) for line in lines[1:])
                parts, have, need = [], -len(RECORD_END), int(headers["Content-Length"])
                break
            parts.append(chunk)
            have += len(RECORD_END) + len(chunk)
            if have < need:
                break
            whole = RECORD_END.join(parts)
            yield archive, number, headers, whole[:need]
            number += 1
            headers, parts, rest = None, [], whole[need:]
            if rest in (b"", RECORD_END):
                break  # the separator alone: the archive's last block ended in part of a blank line
            chunk = rest[len(RECORD_END) :]  # the block ended in part of a blank line
    if headers is not None:
        raise ValueError(f"{archive} ends within a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the archives in ``folder``, a sorted run for each: see ``_INDEX`` for its columns.

    Payloads of responses are checked against their digests.
    """
    chunks = spark.read.option("lineSep", RECORD_END.decode()).text(folder)
    chunks = chunks.select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("chunk"))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for name, chunk in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield name, chunk.as_py()

        rows = []
        for archive, number, headers, block in records_of(each()):
            http, _, payload = block.partition(RECORD_END)
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if headers["WARC-Type"] == "response":
                if len(payload) != size or base64.b32encode(sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"record {number} of {archive} is damaged")
            url, page_id, refers_to = (headers.get(key) for key in ("WARC-Target-URI", "X-Page-ID", "X-Refers-To-Page-ID"))
            rows.append(
                {
                    "url_key": url_key(url),
                    "captured": headers["WARC-Date"],
                    "page_id": page_id and int(page_id),
                    "url": url,
                    "payload_bytes": size,
                    "payload_digest": digest,
                    "record_type": headers["WARC-Type"],
                    "refers_to": refers_to and int(refers_to),
                    "archive": archive,
                    "position": number,
                }
            )
            if len(rows) == 5000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return chunks.mapInArrow(indexed, _INDEX)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(name, kinds[kind]) for name, kind in (field.split() for field in _INDEX.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, so a new row plays one match per level."""

    _END = object()

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.heads = [next(run, self._END) for run in runs] or [self._END]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            left, right = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (left, right) if self._before(left, right) else (right, left)
        self.winner = winners[1] if self.size > 1 else 0

    def _before(self, one: int, other: int) -> bool:
        a, b = self.heads[one], self.heads[other]
        if a is self._END or b is self._END:
            return b is self._END and a is not self._END or a is b and one < other
        return a < b or (a == b and one < other)

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.winner]) is not self._END:
            yield head
            own = self.winner
            self.heads[own] = next(self.runs[own], self._END)
            node = (own + self.size) // 2
            while node:
                if self._before(self.losers[node], own):
                    self.losers[node], own = own, self.losers[node]
                node //= 2
            self.winner = own


def merge_runs(index: DataFrame) -> DataFrame:
    """The rows of sorted runs (columns of ``_INDEX``; a run is an archive) in one order of url_key, captured, page_id.

    The order runs through the result's partitions. Ranges are cut by all three columns, so the captures of a
    frequent URL are spread; a range's rows, some columns of short strings, are merged in memory.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = [table.column(name).to_pylist() for name in ("archive", "url_key", "captured", "page_id")]
        runs: dict[str, list] = {}
        for place, (archive, key, captured, page_id) in enumerate(zip(*columns)):
            # null ids come first
            runs.setdefault(archive, []).append((key, captured, page_id is not None, page_id or 0, place))
        order = pa.array([row[-1] for row in LoserTree([iter(run) for run in runs.values()])], pa.int64())
        yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)

    dealt = index.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("archive", "position")
    return dealt.mapInArrow(merged, _INDEX)


def capture_histories(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, read them back, and give their index in global order.

    A null html is an empty payload, a null url has the empty key. Repeated rows are a record each; among rows with
    the largest page_id of their payload all are responses. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "archives")
    write_archives(pages, folder)
    return merge_runs(stored(read_archives(spark, folder), "capture-runs"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
made AS (
  SELECT *, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS latest FROM p
)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(digest, CAST(g * 5 + 1 AS INTEGER), 5))::INT >> CAST(15 - 5 * k AS INTEGER)) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM latest THEN NULL ELSE latest END AS refers_to
FROM made
"""
