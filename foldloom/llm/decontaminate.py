"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents.

An item that a document contains to the share C shares at least ceil(C * m) of its m shingles, so at least one of the
floor((1 - C) * m) + 1 shingles with the least hashes: its bottom-k MinHash sketch. Items fall into classes by size; a
class's documents are those long enough for it, and a document's sketch for a class is its shingles whose hashes are no
larger than the largest in the class's sketches. Where the sketches meet there is a candidate, and none is missed; it is
then verified by the exact share of the item's shingles in the whole document, told apart by 128 bits: a shared one must
be shared under two independent hashes.

Items are a stated query set. Up to MOST shingles (an item counts as ITEM more) they are broadcast in blocks of at most
BLOCK_SHINGLES: one pass over the documents, and nothing is shuffled. Beyond, sketches meet in a join: a filter of at most 2**FILTER_BITS
bits, broadcast, holds back the hashes of documents that no sketch has; a text with candidates is sent once, whatever their
number, copies of a text as one, and a task holds one text's set at a time. Both ways have the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text_kernels import lean, pieces, shared, shingle_sets

K = 5
SHARE = (4, 5)
BLOCK_SHINGLES, MOST, ITEM = 1 << 19, 1 << 22, 32
FILTER_BITS, BUCKET = 27, 1 << 15  # bits of the filter, and of each of its parts as Spark's bitmap functions cut them


def need(m: int, share: tuple[int, int]) -> int:
    return -(-m * share[0] // share[1])


def head(own: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The bottom-k sketch of an item's sorted set."""
    return own[: len(own) - need(len(own), share) + 1]


class Block:
    """Items' sets under both hashes and, by size class, their sketches."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], share: tuple[int, int]):
        self.items, self.share = items, share
        classes: dict[int, list[int]] = {}
        for i, (_, own, _) in enumerate(items):
            classes.setdefault(len(own).bit_length(), []).append(i)
        self.classes = []
        for members in classes.values():
            heads = [head(items[i][1], share) for i in members]
            values = np.concatenate(heads)
            whose = np.repeat(np.array(members), [len(h) for h in heads])
            order = np.argsort(values, kind="stable")
            self.classes.append((min(self.need(len(items[i][1])) for i in members), values[order], whose[order]))

    def need(self, m: int) -> int:
        return need(m, self.share)

    def found(self, own: np.ndarray, other: Callable[[], np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(item's key, its shingles, those in the document) of each item that the document contains, whose sorted set is
        ``own``; ``other`` makes its set under the second hash, which only documents with a candidate need."""
        for least, values, whose in self.classes:
            if len(own) < least:
                continue
            sketch = own[: int(np.searchsorted(own, values[-1], "right"))]
            if not len(sketch):
                continue
            if len(sketch) < len(values):  # the shorter is looked up in the longer
                a, b = np.searchsorted(values, sketch, "left"), np.searchsorted(values, sketch, "right")
                met = [whose[x:y] for x, y in zip(a[a < b].tolist(), b[a < b].tolist(), strict=True)]
            else:
                at = np.searchsorted(sketch, values)
                at[at == len(sketch)] = 0
                met = [whose[sketch[at] == values]]
            for i in np.unique(np.concatenate(met)).tolist() if met else []:
                key, item, item_2 = self.items[i]
                both = shared(own, item)
                if both < self.need(len(item)):
                    continue
                both = min(both, shared(other(), item_2))
                if both >= self.need(len(item)):
                    yield key, len(item), both


def _found(sent: list[Broadcast], texts: pa.Array, k: int) -> Iterator[Iterator[tuple[int, int, int]]]:
    """What each of ``texts`` contains of the items in the blocks ``sent`` out."""
    for i, own in enumerate(shingle_sets(texts, k, False)):
        other = cache(lambda i=i: next(shingle_sets(texts.slice(i, 1), k, False, 1)))
        yield chain.from_iterable(b.value.found(own, other) for b in sent if len(own))


def item_sets(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(item, own, other): the items with shingles, their sorted sets under both hashes; written."""

    def run(batches):
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1)):
                sets = [pa.array([x.tobytes() for x in shingle_sets(texts, k, False, seed)], pa.binary()) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids, *sets], ["item", "own", "other"])

    slim = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    return written(slim.mapInArrow(lean(run), "item long, own binary, other binary").where("octet_length(own) > 0"), "items")


def _set(value) -> np.ndarray:
    return np.frombuffer(bytes(value), dtype=np.uint64)


def blocks(sets: DataFrame, share: tuple[int, int]) -> Iterator[Block]:
    """The items in blocks; equal items stay apart."""
    held, size = [], 0
    for r in sets.toLocalIterator():
        own, other = _set(r["own"]), _set(r["other"])
        if held and size + len(own) > BLOCK_SHINGLES:
            yield Block(held, share)
            held, size = [], 0
        held.append((r["item"], own, other))
        size += len(own)
    if held:
        yield Block(held, share)


def sent_out(sets: DataFrame, share: tuple[int, int]) -> list[Broadcast] | None:
    """The items' blocks, broadcast; None if they are beyond MOST."""
    size = sets.agg(F.sum(F.octet_length("own") / 8 + ITEM)).first()[0] or 0
    return None if size > MOST else [sets.sparkSession.sparkContext.broadcast(b) for b in blocks(sets, share)]


def _filter(sketches: DataFrame, bits: int) -> np.ndarray:
    """A bit for each leading ``bits`` bits of a hash that a sketch has, eight to a byte; at most 2**FILTER_BITS."""
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    parts = sketches.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(BUCKET, 1 << bits) // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        at = (r["part"] - 1) * BUCKET // 8
        out[at : at + BUCKET // 8] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def met_by_hash(texts: DataFrame, sets: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """(digest, item, item_shingles, shared) for each item in each distinct text of ``texts`` (digest, text): sketches joined by hash, then
    verified. Items that repeat give a row each."""
    spark = texts.sparkSession
    one = sets.groupBy("item", "own", "other").agg(F.count("*").alias("copies")).withColumn("uid", F.sha2(F.concat(F.col("item").cast("string").cast("binary"), "own"), 256))
    one = written(one, "item-sets")

    def heads(batches):
        for batch in batches:
            own = [head(_set(x), share) for x in batch.column(0).to_pylist()]
            if not own:
                continue
            whose = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), batch.column(1).take(pa.array(whose))], ["hash", "uid"])

    sketches = written(one.select("own", "uid").mapInArrow(lean(heads), "hash long, uid string"), "item-sketches")
    bits = min(FILTER_BITS, max(15, sketches.count().bit_length() + 4))
    known = spark.sparkContext.broadcast(_filter(sketches, bits))

    def hashes(batches):
        for batch in batches:
            for digests, own_texts in pieces(batch.column(0), batch.column(1)):
                found = []
                for own in shingle_sets(own_texts, k, False):
                    at = own >> np.uint64(64 - bits)
                    hit = known.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                    found.append(own[hit.astype(bool)])
                whose = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), digests.take(pa.array(whose))], ["hash", "digest"])

    own = texts.select("digest", "text").mapInArrow(lean(hashes), "hash long, digest string").distinct()
    met = written(own.join(sketches, "hash").select("digest", "uid").distinct(), "met")
    none = F.lit(None)
    asked = texts.join(met.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    asked = asked.select("digest", "text", none.cast("string").alias("uid"), none.cast("long").alias("item"), none.cast("long").alias("copies"), none.cast("binary").alias("own"), none.cast("binary").alias("other"))
    pairs = met.join(one, "uid").select("digest", none.cast("string").alias("text"), "uid", "item", "copies", "own", "other")

    def verified(batches):
        digest, pair = None, []
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["uid"] is None:
                    digest, text = r["digest"], pa.array([r["text"]], pa.string())
                    pair = [next(shingle_sets(text, k, False, seed)) for seed in (0, 1)]
                elif r["digest"] == digest:
                    both = min(shared(x, _set(r[c])) for x, c in zip(pair, ("own", "other"), strict=True))
                    m = len(r["own"]) // 8
                    if both >= need(m, share):
                        rows += [(digest, r["item"], m, both)] * r["copies"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), *[pa.int64()] * 3))], ["digest", "item", "item_shingles", "shared"])

    dealt = asked.union(pairs).repartition("digest").sortWithinPartitions("digest", F.col("uid").isNotNull())
    return dealt.mapInArrow(lean(verified), "digest string, item long, item_shingles long, shared long")


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """(``key``, ``item_key``, item_shingles, shared, containment) for each document that contains an item to ``share``.

    Documents and items without ``k`` words, null ones among them, contain nothing and are in nothing; rows without a key
    give no result; rows that repeat a key give one each. Empty tables give an empty result.
    """
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = item_sets(items, item_key, item_text, k)
    sent = sent_out(sets, share)

    def run(batches):
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1)):
                rows = [(i, *hit) for i, hits in zip(ids.to_pylist(), _found(sent, texts, k), strict=True) for hit in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["id", "item", "item_shingles", "shared"])

    if sent is None:
        source = source.withColumn("digest", F.sha2("text", 256))
        out = source.select("id", "digest").join(met_by_hash(source.select("digest", "text"), sets, k, share), "digest")
    else:
        out = source.mapInArrow(lean(run), "id long, item long, item_shingles long, shared long")
    return out.select(F.col("id").alias(key), F.col("item").alias(item_key), "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they are.

    A null, empty or short text contains nothing and stays, as does every row of an empty table or without items; rows without a key
    or that repeat are judged each for itself; other columns, whatever their names, pass through."""
    at = docs.columns.index(text)
    sets = item_sets(items, item_key, item_text, k)
    sent = sent_out(sets, share)

    def run(batches):
        for batch in batches:
            rows = pa.array(np.arange(len(batch)))
            clean = [next(hits, None) is None for _, texts in pieces(rows, batch.column(at)) for hits in _found(sent, texts, k)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    if sent is not None:
        return docs.mapInArrow(lean(run), docs.schema) if sent else docs
    away = [f"_d_{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*away).withColumn("digest", F.sha2(away[at], 256))
    hit = met_by_hash(own.select("digest", F.col(away[at]).alias("text")).where("text is not null"), sets, k, share).select("digest").distinct()
    return own.join(hit, "digest", "left_anti").select(*[F.col(a).alias(c) for a, c in zip(away, docs.columns, strict=True)])
