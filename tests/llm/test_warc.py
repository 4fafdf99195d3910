import hashlib

import pytest

from foldloom.llm import warc
from foldloom.llm.shared import new_path

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    long = "<p>" + "the same page " * 20 + "é</p>"
    return [(5, "http://a", long, "x"), (3, "http://b\r\nX: y", long, "x"), (9, None, long, "x"), (1, "u", "short", "x"), (2, "u", "short", "x"), (4, "u", None, None), (6, "u", "", "x"), (None, "u", long, "x"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20, "x"), (8, "u", "z" * 400_000, "x"), (10, "u", "z" * 400_000, "x")] + [(i, f"http://{i}", f"<html>{i} " + f"body {i} " * 30, "x") for i in range(20, 60)]


@pytest.mark.parametrize("file_bytes", [1 << 25, 200])
def test_round_trip(spark, file_bytes):
    folder = new_path(spark, "warc-test")
    rows = pages()
    assert warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, file_bytes=file_bytes) == len(rows)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    by = {r["record_id"]: r for r in got}
    first = {}
    for k, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        body = (html or "").encode()
        r = by[f"<urn:page:{'' if k is None else k}>"]
        refers = first.setdefault(body, k) if len(body) >= 100 and k is not None else k
        assert (r["payload_digest"], r["payload_bytes"]) == (hashlib.sha256(body).hexdigest(), len(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if refers == k else ("revisit", f"<urn:page:{refers}>"))
        assert bytes(r["payload"]) == (body if refers == k else b"")
    assert by["<urn:page:9>"]["target_uri"] == "" and "X: y" in by["<urn:page:3>"]["target_uri"]


def test_records_stand_alone_after_the_dictionary(spark):
    import zstandard

    folder = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(pages(), SCHEMA).coalesce(1), folder)
    content = bytes(warc.files(spark, folder, "*.zst").first()["content"])
    magic, size = int.from_bytes(content[:4], "little"), int.from_bytes(content[4:8], "little")
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    own = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    frame = zstandard.ZstdDecompressor(dict_data=own).decompressobj().decompress(content[8 + size :])
    assert frame.startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    folder = new_path(spark, "warc-test")
    assert warc.write(spark.createDataFrame([], SCHEMA), folder) == 0


def test_rows_that_repeat_a_key(spark):
    long = "<p>" + "a page that comes again " * 10
    rows = [(1, "u", long, "x")] * 8 + [(2, "u", long, "x")] * 3 + [(1, "u", "other " * 30, "x")] * 2 + [(3, "u", "small", "x")] * 2
    folder = new_path(spark, "warc-test")
    assert warc.write(spark.createDataFrame(rows, SCHEMA), folder) == len(rows)
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in warc.read(spark, folder).collect())
    assert got == [("<urn:page:1>", "response", "")] * 10 + [("<urn:page:2>", "revisit", "<urn:page:1>")] * 3 + [("<urn:page:3>", "response", "")] * 2


def test_the_dictionary_learns_one_record_a_key(spark):
    rows = spark.createDataFrame([(1, "u", f"<html>body {i} of many " * 40, "x") for i in range(500)] + [(i, "u", f"<html>page {i} of many " * 40, "x") for i in range(2, 40)], SCHEMA)
    trained = warc.dictionary(rows, "page_id", "url", "html", sample=30)
    assert trained and b"WARC-Payload-Digest" in trained
