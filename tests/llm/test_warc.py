import base64
import gzip
import hashlib
import io

import pytest

from scoreloom.llm import warc
from scoreloom.session import new_folder

HTML = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\ny WARC/1.1\r\n\r\n", "ü" * 70_000, "", "<p>a</p>"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, n int, first string")


@pytest.fixture(scope="module")
def archive(spark):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages(spark, [(i, f"http://h/{i}\r\nX: y", h, 0, "z") for i, h in enumerate(HTML)]), folder, records_per_file=4)
    return folder


def test_round_trip(spark, archive):
    found = {r.page_id: r for r in warc.page_ids(warc.assemble(warc.read_archives(spark, archive))).collect()}
    assert sorted(found) == list(range(len(HTML)))
    texts = [h or "" for h in HTML]
    for i, text in enumerate(texts):
        r, data = found[i], text.encode()
        first = texts.index(text)
        assert r.response.payload_bytes == len(data)
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.response.kind, r.refers_page) == (("response", None) if first == i else ("revisit", first))
        assert first != i or (bytes(r.response.payload) == data and r.response.digest_ok)
        assert (r.requests, r.metadata_records) == (1, 1)
        assert r.request.target_uri == f"http://h/{i}  X: y"


def test_small_payloads_stay_responses(spark):
    rows = [(i, "u", h, 0, "") for i, h in enumerate(["aa", "aa", "bbbb", "bbbb"])]
    found = warc.captures(pages(spark, rows), least_bytes=3).orderBy("page_id").collect()
    assert [r.refers_to for r in found] == [None, None, None, 2]


def test_many_revisits_of_one_response(spark):
    rows = [(i, "u", "same" if i % 3 else f"own {i // 6}", 0, "") for i in range(3000)]
    folder = new_folder(spark, "warc")
    warc.write_archives(pages(spark, rows), folder, every_row=True)
    found = {r.page_id: (r.response.kind, r.refers_page) for r in warc.page_ids(warc.assemble(warc.read_archives(spark, folder))).collect()}
    first = {}
    for i, _, html, *_ in rows:
        first.setdefault(html, i)
    assert found == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h, *_ in rows}


def test_members_of_any_length_are_split():
    parts = [b"", b"a", bytes(range(256)) * 40, b"z" * 9_000_000, b"end"]
    packed = b"".join(gzip.compress(x) for x in parts)
    assert list(warc._members(packed)) == parts
    assert list(warc._members(b"WARC/1.1 plain")) == [b"WARC/1.1 plain"]


def test_a_repeated_record_counts_by_its_first_copy(spark):
    def record(place, kind, name, *to):
        return ("f", place, kind, name, list(to), None, None, None, None, None, None, None, None)

    rows = [record(0, "response", "r"), record(1, "request", "q", "r"), record(2, "response", "r"), record(3, "request", "q", "r")]
    (r,) = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert (r.record_id, r.requests, r.request.record_id) == ("r", 1, "q")


def test_members_are_plain_gzip(spark, archive):
    files = spark.read.format("binaryFile").load(archive).collect()
    assert len(files) > 1
    data = b"".join(gzip.GzipFile(fileobj=io.BytesIO(bytes(f.content))).read() for f in files)
    assert data.count(b"WARC-Type: ") == 3 * len(HTML)


def test_very_long_record_keeps_its_end():
    member = warc._member(b"x" * (1 << 24)) + b"\x00"
    assert gzip.decompress(member) == b"x" * (1 << 24)


def test_empty_table_and_repeated_rows(spark):
    for rows in ([], [(1, "u", "a", 0, "")] * 2, [(None, None, None, 0, "")]):
        folder = new_folder(spark, "warc")
        warc.write_archives(pages(spark, rows), folder)
        found = warc.page_ids(warc.assemble(warc.read_archives(spark, folder))).collect()
        assert [r.page_id for r in found] == [r[0] for r in rows[:1]]


def test_every_row_comes_back(spark):
    rows = [
        (None, "u", "a", 0, ""), (None, "v", "b", 0, ""), (None, None, None, 0, ""),
        (1, "u", "a", 0, ""), (1, "v", "a", 0, ""), (1, "u", "b", 0, ""), (2, "u", "b", 0, ""), (3, "x", "c", 0, ""), (3, "x", "c", 0, ""),
    ]
    for every_row, wanted in ((True, rows), (False, rows[:-1])):
        folder = new_folder(spark, "warc")
        warc.write_archives(pages(spark, rows), folder, every_row=every_row)
        found = warc.page_ids(warc.assemble(warc.read_archives(spark, folder))).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((key((r.page_id, r.request.target_uri, r.response.payload_digest)) for r in found)) == sorted(
            key((i, u or "", warc.digest((h or "").encode()))) for i, u, h, *_ in wanted
        )
        assert all((r.requests, r.metadata_records) == (1, 1) for r in found)
        # of equal payloads one row is the response: the smallest id, null last, then the first url
        revisits = sorted(str((r.page_id, r.refers_page)) for r in found if r.response.kind == "revisit")
        assert revisits == sorted(["(None, 1)", "(None, 1)", "(1, 1)", "(2, 1)"] + ["(3, 3)"] * every_row)
        assert sorted(r.request.target_uri for r in found if r.response.kind == "response") == ["", "u", "u", "x"]


def test_ties_in_either_direction_and_orphans(spark):
    def record(kind, name, *to):
        return ("f", ord(name), kind, name, list(to), None, None, None, None, None, None, None, None)

    rows = [
        record("response", "r", "q"), record("request", "q"), record("metadata", "m", "q"), record("metadata", "n", "r"),
        record("response", "s"), record("metadata", "x", "gone"),
    ]
    found = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert sorted(found) == ["r", "s"]
    assert (found["r"].request.record_id, found["r"].metadata.record_id) == ("q", "m")
    assert (found["r"].requests, found["r"].metadata_records, found["s"].requests, found["s"].request) == (1, 2, 0, None)
