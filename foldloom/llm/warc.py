"""WARC archives compressed with Zstandard and a dictionary.

The dictionary is trained on at most SAMPLE records, headers and all, those with the least hashes of their keys and one of rows
that repeat a key; of a longer record the first SAMPLE_BYTES. These bounds shape the dictionary alone. Every file
begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary; each record then is a frame of its
own, so that a record can be read alone at its offset. A record whose payload has LEAST_DUPLICATE bytes or more and
equals another's is a revisit of the one with the least key; it names that in WARC-Refers-To and has no payload.

Digests and who refers to whom are DataFrame aggregates on slim rows. Payloads are dealt out once, by key; each task streams
its records into files of about FILE_BYTES compressed bytes and holds one batch at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive_files import SharedFile, files
from .text_kernels import lean

DICTIONARY_MAGIC = 0x184D2A5D
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 1 << 16, 1 << 16
LEVEL, FILE_BYTES, LEAST_DUPLICATE = 3, 32 << 20, 100
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own


def record(key, url: str, kind: str, digest: str, size: int, refers, payload: bytes) -> bytes:
    """One WARC/1.1 record with its two final line breaks."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def dictionary(pages: DataFrame, key: str, url: str, text: str, sample: int = SAMPLE) -> bytes:
    """A Zstandard dictionary, empty if there is too little to learn from."""
    import zstandard

    keys = pages.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)  # the keys first: tasks send no texts but those chosen
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    own = pages.join(F.broadcast(keys), key, "left_semi").groupBy(F.col(key).cast("long").alias("key"))
    some = own.agg(F.min(F.struct(F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.substring(body, 1, SAMPLE_BYTES).alias("part"))).alias("r")).select("key", "r.*")
    parts = sorted(record(r["key"], r["url"], "response", r["digest"], r["size"], None, bytes(r["part"]))[:SAMPLE_BYTES] for r in some.collect())  # at most ``sample`` rows of SAMPLE_BYTES
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def decided(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, digest, refers) of each row; refers: the least key among equal payloads, where that is another's."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = pages.select(F.col(key).cast("long").alias("key"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    large = F.col("size") >= LEAST_DUPLICATE
    first = slim.where(large).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("first") != F.col("key"), F.col("first")).alias("refers")
    # small payloads, however many share a digest, are dealt to no one task
    return slim.where(large).join(first, "digest", "left").select("key", "size", "digest", refers).union(slim.where(~large).select("key", "size", "digest", F.lit(None).cast("long")))


def _writer(folder: str, trained: bytes, file_bytes: int):
    def run(batches):
        import zstandard

        task = TaskContext.get().partitionId()
        own = zstandard.ZstdCompressionDict(trained) if trained else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True)
        out, number, written, clean = None, 0, 0, False
        try:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    key, url, html, size, digest, refers = row
                    if out is None:
                        out = SharedFile(folder, f"part-{task:05d}-{number:04d}.warc.zst")
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
                    kind = "response" if refers is None else "revisit"
                    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
                    out.write(press.compress(record("" if key is None else key, uri, kind, digest, size, refers, (html or "").encode() if refers is None else b"")))
                    written += 1
                    if out.size >= file_bytes:
                        out.close()
                        out, number = None, number + 1
            if out is not None:
                out.close()
            clean = True
        finally:
            if out is not None and not clean:
                out.drop()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["records"])

    return run


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", text: str = "html", file_bytes: int = FILE_BYTES) -> int:
    """Writes a record for every row into archives in ``folder``, and returns how many.

    A null or empty text is an empty payload; a null url is an empty one. A row without a key has an empty record id and
    never is one that others revisit, unless all with its payload have none: then all are responses. Rows that repeat a key are
    one record each, with one record id; of those with equal payloads, too, all are what the key is, a response or revisits. An
    empty table writes no file; other columns aren't looked at.
    """
    trained = dictionary(pages, key, url, text)
    slim = decided(pages.where(F.col(key).isNotNull()), key, text).groupBy("key", "digest").agg(F.first("size").alias("size"), F.first("refers").alias("refers"))
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    full = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(text).alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    rows = full.join(slim.select("key", "digest", "refers"), ["key", "digest"], "left").select("key", "url", "html", "size", "digest", "refers")
    n = rows.mapInArrow(lean(_writer(folder, trained, file_bytes)), "records long").agg(F.sum("records").alias("n")).first()["n"]
    return int(n or 0)


_HEADER = re.compile(rb"([A-Za-z-]+): ?(.*)")


def records(content) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of one archive."""
    import zstandard

    view = memoryview(content)
    magic, size = struct.unpack_from("<II", view)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    trained = bytes(view[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    at = 8 + size
    while at < len(view):
        one = reader.decompressobj()
        parts = []
        while not one.eof:  # frames tell their end only as they are read
            step = view[at : at + (1 << 14)]
            if not len(step):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = {m[1].decode(): m[2].decode() for m in map(_HEADER.fullmatch, head.split(b"\r\n")[1:]) if m}
        yield fields, rest[: int(fields["Content-Length"])]


FIELDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in ``folder``; a revisit's payload is empty, its size and digest those it stands for."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for f, payload in records(content.as_buffer()):
                    rows.append((f["WARC-Record-ID"], f["WARC-Type"], f["WARC-Target-URI"], f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"]), f.get("WARC-Refers-To"), payload))
                    held += len(payload)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"])

    return files(spark, folder, "*.warc.zst").select("content").mapInArrow(lean(run), FIELDS)
