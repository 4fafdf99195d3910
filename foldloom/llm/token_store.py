"""Token ids in binary files, word aligned by Simple-8b.

A 64-bit word holds a selector in its top 4 bits and, below, as many ids as fit at one width: COUNTS of them at WIDTHS
bits. Selector 0 is an escape: the next word is one value of up to 64 bits as it is. Ids are coded in blocks of
BLOCK, the last of a file shorter; a block's first word is in the file's index, so that blocks decode alone and all blocks
of a batch are coded and decoded together, by NumPy.

File: MAGIC, the words of all blocks, then the footer: the documents' keys and id counts (int64, uint32), each
block's first word and id count (uint64, uint32), and a tail of six uint64: documents, blocks, words, ids, documents
without a key, and a version; MAGIC again. Documents are in ascending key order in a file and from one file to the next.
A file is closed at the first document past FILE_BYTES, so its footer and blocks have a bound, and is read a group of
blocks at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive_files import SharedFile, file_names, opened
from .text_kernels import lean, pieces
from .token_ids import ids_of

MAGIC, VERSION, BLOCK, FILE_BYTES = b"FLS8IDS\n", 1, 4096, 64 << 20
#: Fixed values of the format by selector; 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of ``values`` (unsigned), each block's first word, and each block's number of values."""
    n = len(values)
    sizes = np.full(-(-n // block), block, dtype=np.int64)
    if n % block:
        sizes[-1] = n % block
    values = values.astype(np.uint64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), sizes
    # fits[s]: from this place on, as many values as selector s holds are narrow enough and in the block
    left = np.concatenate([np.arange(s, 0, -1) for s in sizes]) if len(sizes) < 4 else np.concatenate([np.tile(np.arange(block, 0, -1), len(sizes) - 1), np.arange(sizes[-1], 0, -1)])
    choice = np.where(values < np.uint64(1) << np.uint64(60), 15, 0).astype(np.int8)
    places, most = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), int(values.max())
    for s in range(14, 0, -1):
        bits, count = int(WIDTHS[s]), int(COUNTS[s])
        if most < 1 << bits:  # all are narrow enough: what is left of the block decides
            choice[left >= count] = s
            continue
        # of the places that were narrow enough before, those that are so for fewer bits: ever fewer are looked at
        places = places[values[places] < (np.uint64(1) << np.uint64(bits))]
        if len(places) < count:
            break
        ok = places[: len(places) - count + 1]
        ok = ok[places[count - 1 :] - ok == count - 1]
        choice[ok[left[ok] >= count]] = s
    # all blocks take one step at a time, from word to word
    end = np.cumsum(sizes)
    at, begins = end - sizes, np.zeros(n, dtype=bool)
    step = COUNTS[choice]
    while len(at):
        begins[at] = True
        at = at + step[at]
        more = at < end
        at, end = at[more], end[more]
    place = np.flatnonzero(begins)
    kind, whose = choice[place].astype(np.int64), place // block
    wide = 1 + (kind == 0)
    to = np.cumsum(wide) - wide
    out = np.zeros(int(wide.sum()), dtype=np.uint64)
    for s in np.unique(kind).tolist():
        mine = kind == s
        if s == 0:
            out[to[mine] + 1] = values[place[mine]]
            continue
        word = np.full(int(mine.sum()), s << 60, dtype=np.uint64)
        if WIDTHS[s]:
            for i in range(int(COUNTS[s])):
                word |= values[place[mine] + i] << np.uint64(i * int(WIDTHS[s]))
        out[to[mine]] = word
    starts = to[np.searchsorted(whose, np.arange(len(sizes)), "left")]
    return out, starts.astype(np.uint64), sizes


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of whole blocks' ``words``."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    if (kind == 0).any():  # a word after an escape is a value, whatever its top bits say
        plain = np.ones(len(words), dtype=bool)
        for i in np.flatnonzero(kind == 0).tolist():
            if plain[i]:
                plain[i + 1] = False
        head = np.flatnonzero(plain)
    else:
        head = np.arange(len(words))
    kind = kind[head]
    counts = COUNTS[kind]
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(kind).tolist():
        mine = kind == s
        if s == 0:
            out[to[mine]] = words[head[mine] + 1]
        elif WIDTHS[s]:
            low, mask = words[head[mine]], np.uint64((1 << int(WIDTHS[s])) - 1)
            for i in range(int(COUNTS[s])):
                out[to[mine] + i] = (low >> np.uint64(i * int(WIDTHS[s]))) & mask
    if len(out) != n:
        raise ValueError(f"{len(out)} values where {n} were written")
    return out


def _writer(folder: str, tokenizer: str, eos: int, file_bytes: int, batch_ids: int = 128 * BLOCK):
    def run(batches):
        ids, task = ids_of(tokenizer, 200_000), TaskContext.get().partitionId()
        out, number, written = None, 0, 0
        keys: list = []
        counts, starts, sizes, waiting, words, held = [], [], [], [], 0, 0

        def flush(everything: bool) -> None:
            nonlocal waiting, words, held
            own = np.concatenate([np.zeros(0, ids.kind), *waiting])
            cut = len(own) if everything else len(own) // BLOCK * BLOCK
            coded, first, size = encode(own[:cut])
            out.write(coded.astype("<u8").tobytes())
            starts.append(first + np.uint64(words))
            sizes.append(size)
            words += len(coded)
            waiting, held = [own[cut:]], len(own) - cut

        def finish() -> None:
            nonlocal out, number, keys, counts, starts, sizes, waiting, words, written
            flush(True)
            nameless = sum(k is None for k in keys)
            out.write(np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.array(counts, "<u4").tobytes())
            out.write(np.concatenate(starts).astype("<u8").tobytes() + np.concatenate(sizes).astype("<u4").tobytes())
            blocks = sum(len(x) for x in sizes)
            out.write(np.array([len(keys), blocks, words, sum(counts), nameless, VERSION], "<u8").tobytes() + MAGIC)
            out.close()
            written += len(keys)
            out, number, keys, counts, starts, sizes, waiting, words = None, number + 1, [], [], [], [], [], 0

        try:
            for batch in batches:
                for names, texts in pieces(batch.column(0), batch.column(1), 4 << 20):
                    if out is None:
                        out = SharedFile(folder, f"part-{task:06d}-{number:06d}.ids")
                        out.write(MAGIC)
                    keys += names.to_pylist()
                    flat, at = ids.encode(texts)
                    waiting.append(np.insert(flat, at[1:], np.array(eos).astype(ids.kind)))
                    counts += (np.diff(at) + 1).tolist()
                    held += len(waiting[-1])
                    if held >= batch_ids:
                        flush(False)
                    if 8 * words + 2 * held + 12 * len(keys) >= file_bytes:
                        finish()
            if out is not None:
                finish()
        finally:
            if out is not None:
                out.drop()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["documents"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", eos: int = 2, parts: int | None = None, file_bytes: int = FILE_BYTES) -> int:
    """Writes the ids of every row, ascending by ``key``, and returns how many rows. ``parts`` tasks (default: as many as
    shuffles have partitions) write a file for each ``file_bytes``. Null keys come first; rows that repeat a key, null keys among
    them, follow each other by the text's first 32 characters, then a hash of it, and ranges part them like others; a null
    or empty text is the end id alone; an empty table writes no file; other columns aren't looked at."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the text, and a running number, deal out rows that share a key, or everything
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.substring(text, 1, 32).alias("head"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("i"))
    order = ("id", "head", "h", "i")
    ranged = source.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    n = ranged.mapInArrow(lean(_writer(folder, tokenizer, eos, file_bytes), 16 << 20), "documents long").agg(F.sum("documents").alias("n")).first()["n"]
    return int(n or 0)


class File:
    """One file's footer, and its words as they are asked for. ``source`` is open for reading at any place."""

    def __init__(self, source: pa.NativeFile):
        self.source, end = source, source.size()
        if end < 64 or source.read_at(8, 0) != MAGIC or source.read_at(8, end - 8) != MAGIC:
            raise ValueError("not a file of token ids")
        self.documents, self.blocks, self.n_words, self.n_ids, self.nameless, _ = (int(x) for x in np.frombuffer(source.read_at(48, end - 56), "<u8"))

    def _part(self, kind: str, at: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at(size * n, at), kind)

    def index(self) -> None:
        """Reads the documents' keys and id counts, and the blocks' first words and id counts."""
        at = 8 + 8 * self.n_words
        self.keys = self._part("<i8", at, self.documents)
        self.counts = self._part("<u4", at + 8 * self.documents, self.documents)
        at += 12 * self.documents
        self.starts = self._part("<u8", at, self.blocks)
        self.sizes = self._part("<u4", at + 8 * self.blocks, self.blocks)

    def texts(self, group: int = 256) -> Iterator[np.ndarray]:
        """The ids of each document, reading and decoding ``group`` blocks at a time."""
        left = np.zeros(0, np.uint64)
        todo = iter(self.counts.tolist())
        want = next(todo, None)
        for b in range(0, self.blocks, group):
            to = min(self.blocks, b + group)
            first, last = int(self.starts[b]), int(self.starts[to]) if to < self.blocks else self.n_words
            words = self._part("<u8", 8 + 8 * first, last - first)
            left = np.concatenate([left, decode(words, int(self.sizes[b:to].sum()))])
            at = 0
            while want is not None and at + want <= len(left):
                yield left[at : at + want]
                at += want
                want = next(todo, None)
            left = left[at:]


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of each document, from the files in ``folder``. Where a file's first id stands
    follows from the tails of the files before it: two numbers a file."""
    names = file_names(spark, folder, "*.ids")

    def sizes(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([opened(folder, x, lambda f: File(f).n_ids) for x in own], pa.int64())], ["name", "n"])

    before, total = {}, 0
    for r in sorted(names.mapInArrow(lean(sizes), "name string, n long").collect()):  # a row a file
        before[r["name"]], total = total, total + r["n"]
    sent = spark.sparkContext.broadcast(before)

    def rows(source, start: int) -> pa.RecordBatch:
        f = File(source)
        f.index()
        n = f.counts.astype(np.int64)
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in f.texts()]
        missing = np.arange(f.documents) < f.nameless
        return pa.RecordBatch.from_arrays([pa.array(f.keys.astype(np.int64), mask=missing), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield opened(folder, name, lambda f, name=name: rows(f, sent.value[name]))

    return names.mapInArrow(lean(run, 16 << 20), "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", key)
