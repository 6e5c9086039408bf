import base64
import gzip
import hashlib
import random

import pytest

from postweave.llm import warc
from postweave.sources.storage import fresh_folder

PAGES = "page_id long, url string, html string"


@pytest.fixture
def rows():
    made = [(k, f"http://www.site{k % 4}.example.org/p{k % 7}?q={k}", f"<html>{k % 9}</html>") for k in range(60)]
    made += [(60, None, None), (61, "", ""), (62, "not a url\r\nX: y", "a\r\n\r\nb"), (63, "http://[bad", "ends\r\n"), (64, "http://x/", "ends\r")]
    made += [(65, "http://x/é ü", "\r\n\r\n"), (66, "http://x/", "\r\n\r\n\r\n\r\nWARC/1.0\r\n\r\n"), (67, "http://x/", "é" * 200_000), (68, "http://x:99999/", "p")]
    return made + [(70, "http://x/", "same"), (70, "http://x/", "same"), (71, "http://y/", "\n\r\n\r\n"), (None, "http://z/", "null id"), (None, None, None)]


def test_round_trip(spark, crowded, rows):
    pages = crowded(spark.createDataFrame(rows, PAGES)).repartition(5)
    made = [tuple(row) for row in warc.capture_histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    latest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            latest[html or ""] = max(page_id, latest.get(html or "", page_id))
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = latest.get(html or "")
        kind = ("response", None) if page_id == first else ("revisit", first)
        expected.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind))
    assert sorted(made, key=repr) == sorted(expected, key=repr)


def test_archives_are_sorted_runs_and_the_merge_is_in_order(spark, rows):
    folder = fresh_folder(spark, "archives")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = warc.read_archives(spark, folder)
    by_run = {}
    for row in index.collect():
        by_run.setdefault(row.archive, []).append(row)
    assert len(by_run) > 1
    for run in by_run.values():
        run.sort(key=lambda row: row.position)
        assert [(r.url_key, r.captured) for r in run] == sorted((r.url_key, r.captured) for r in run)
        assert [r.position for r in run] == list(range(len(run)))
    merged = [(r.url_key, r.captured) for r in warc.merge_runs(index).collect()]
    assert merged == sorted(merged) and len(merged) == len(rows)


@pytest.mark.parametrize("html", ["ends\r\n", "\r\n", "ends\r\n\r\n\r\n", "ends\r\n\r\n", "ends\r"])
def test_an_archive_whose_last_page_ends_in_line_ends(spark, html):
    for given in ([(1, "http://x/", html)], [(1, "http://x/", "first"), (2, "http://x/", html)]):
        made = warc.capture_histories(spark.createDataFrame(given, PAGES).coalesce(1)).collect()
        assert [(row.page_id, row.payload_bytes, row.record_type) for row in made] == [(k, len(t), "response") for k, _, t in given]


def test_files_are_warc(spark, rows):
    import glob

    folder = fresh_folder(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows[:20], PAGES).coalesce(1), folder)
    (name,) = glob.glob(f"{folder.removeprefix('file://')}/*.gz")
    data = gzip.open(name).read()
    kinds = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        headers = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(headers[b"Content-Length"])
        assert head.startswith(b"WARC/1.0\r\n") and data[size : size + 4] == b"\r\n\r\n"
        kinds.append(headers[b"WARC-Type"])
        data = data[size + 4 :]
    assert len(kinds) == 20 and set(kinds) == {b"response", b"revisit"}


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(runs):
    draw = random.Random(runs)
    lists = [sorted(draw.randint(0, 30) for _ in range(draw.randint(0, 40))) for _ in range(runs)]
    assert list(warc.LoserTree([iter(part) for part in lists])) == sorted(sum(lists, []))


def test_empty_table(spark):
    assert warc.capture_histories(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_noticed(spark):
    with pytest.raises(ValueError):
        list(warc.records_of(iter([("a", b"WARC/1.0\r\nContent-Length: 10"), ("a", b"short")])))
    with pytest.raises(ValueError):
        list(warc.records_of(iter([("a", b"nothing")])))
