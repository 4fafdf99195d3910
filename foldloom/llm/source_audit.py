"""How the sources of each language differ in their words: by a sort-based stream.

Documents are counted in blocks, each a task's or a bounded share of it, so what is shuffled of a word is a row for each block and
source, however frequent it is. Rows are dealt by (lang, term) and sorted by (lang, term, source, block); a scan sums up runs of
equal keys, holding the sources of one term at a time. A second scan over the terms that are kept emits, for each run, what
its sources add to the distance of each pair that shares the term, and the terms that a source overuses. What terms add
that only one source of a pair has, or neither, follows from counts of equal shares, so no run is widened by absent sources.

Null ``text``, ``lang`` and ``source`` read as empty. Each row is a document, rows that repeat too. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

LEAST_DOCS, RANKS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Distinct terms that a block holds, and pairs that a task sums up, before their rows are sent on.
BLOCK_TERMS, TASK_PAIRS = 400_000, 200_000
#: Letters A-Z to lower case; other bytes that are ASCII part terms. What isn't ASCII has bytes from 128 on alone.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCKS = "lang string, term string, source string, block long, docs long, n long"
COUNTS = "lang string, term string, whole boolean, source string, n long"
PARTS = "part string, lang string, source string, item string, value long"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, (lang, term, source) with how many documents hold the term and how often."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in held.items():
            m = len(n)
            if m:
                yield pa.RecordBatch.from_arrays([_text([lang] * m), _text(list(n)), _text([source] * m), pa.array(np.full(m, block)), pa.array([docs[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["lang", "term", "source", "block", "docs", "n"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            before, found = len(n), terms_of(text)
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size >= BLOCK_TERMS:
                yield from sent()
                held, size, block = {}, 0, block + 1
    yield from sent()


def _starts(t: pa.Table, *keys: str) -> np.ndarray:
    """Positions at which any of ``keys`` differs from the row before."""
    new = np.zeros(len(t), dtype=bool)
    new[:1] = True
    for k in keys:
        c = t[k].combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_terms(batches: Iterable[pa.RecordBatch], shortened) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a (lang, term) ends; what is kept of an open one is ``shortened`` at every batch."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = shortened(t if held is None else pa.concat_tables([held, t]))
        at = int(_starts(t, "lang", "term")[-1])
        if at:
            yield t.slice(0, at)
        held = t.slice(at).combine_chunks()
    if held is not None:
        yield held


def _summed(t: pa.Table) -> pa.Table:
    """Runs of equal (lang, term, source) as one row each."""
    at = _starts(t, "lang", "term", "source")
    if len(at) == len(t):
        return t
    return t.take(pa.array(at)).select(["lang", "term", "source"]).append_column("docs", pa.array(np.add.reduceat(t["docs"].to_numpy(), at))).append_column("n", pa.array(np.add.reduceat(t["n"].to_numpy(), at)))


def _counted(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (b.select(["lang", "term", "source", "docs", "n"]) for b in batches)
        for t in _whole_terms(own, _summed):
            at = _starts(t, "lang", "term")
            of = np.repeat(np.arange(len(at)), np.diff([*at, len(t)]))
            enough = np.add.reduceat(t["docs"].to_numpy(), at) >= least
            each, all_ = t.filter(pa.array(enough[of])), t.take(pa.array(at[enough]))
            n = np.add.reduceat(t["n"].to_numpy(), at)[enough]
            if len(n):
                rows = lambda x, whole, source, n: pa.table({"lang": x["lang"], "term": x["term"], "whole": np.full(len(x), whole), "source": source, "n": n})
                yield from pa.concat_tables([rows(each, False, each["source"], each["n"]), rows(all_, True, _text([b""] * len(n)), pa.array(n))]).to_batches()

    return run


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, whole, source, n) of terms that ``least`` documents of the language hold: a row for each source that has the
    term, and one with ``whole`` for the language."""
    own = read(docs).select(*[F.col(c).cast("binary").alias(c) for c in ("lang", "source", "text")])
    blocks = own.mapInArrow(_blocks, BLOCKS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    return blocks.mapInArrow(_counted(least), COUNTS)


def _share(n: Column | str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + {SMOOTH} as decimal(20, 0))) div cast(total + {SMOOTH} * v as decimal(22, 0))")


def _differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (lang, term, whole, source, p, z), the language's own row first in each run: partial sums of pairs of sources, and
    terms of greater share than the language's."""
    sums: dict[tuple[str, str, str], int] = {}
    rows = lambda part, *columns: pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.string()), *columns], names=["part", "lang", "source", "item", "value"])

    def sent() -> pa.RecordBatch:
        a = list(zip(*sums, strict=True)) or [(), (), ()]
        return rows("pair", *[pa.array(x, pa.string()) for x in a], pa.array(list(sums.values()), pa.int64()))

    for t in _whole_terms(batches, lambda x: x):
        t = t.combine_chunks()
        at = _starts(t, "lang", "term")
        run = np.repeat(np.arange(len(at)), np.diff([*at, len(t)]))
        p, z, own = t["p"].to_numpy(), t["z"].to_numpy(), ~t["whole"].to_numpy(zero_copy_only=False)
        more = own & (p > p[at][run])
        picked = t.filter(pa.array(more))
        for b in pa.table({"part": pa.array(["term"] * len(picked), pa.string()), "lang": picked["lang"], "source": picked["source"], "item": picked["term"], "value": pa.array((p - p[at][run])[more])}).to_batches():
            yield b
        langs, sources = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        names, m = sources.dictionary.to_pylist(), len(sources.dictionary)
        lang, source = (x.indices.to_numpy()[own].astype(np.int64) for x in (langs, sources))
        run, p, z = run[own], p[own], z[own]
        for k in range(1, len(run)):
            i = np.flatnonzero(run[:-k] == run[k:])
            if not len(i):
                break
            j = i + k
            value = np.abs(p[i] - p[j]) - np.abs(p[i] - z[j]) - np.abs(p[j] - z[i]) + np.abs(z[i] - z[j])
            key = (lang[i] * m + source[i]) * m + source[j]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            for x, s in zip(key[order][first].tolist(), np.add.reduceat(value[order], first).tolist(), strict=True):
                pair = langs.dictionary[x // m // m].as_py(), names[x // m % m], names[x % m]
                sums[pair] = sums.get(pair, 0) + s
            if len(sums) >= TASK_PAIRS:
                yield sent()
                sums = {}
    yield sent()


def audited(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, the other sources by how far their shares of terms lie
    apart (``pair``: all), and the terms it uses more than the language does (``term``: the first ``ranks``).

    A share is 1 + floor(10**9 * (n + 5) / (total + 5 * v)), exact at any count; equal values rank by item. A language none of whose
    terms are in ``least`` documents has pairs at 0 and no terms. A source that is its language's only one has no pairs. An
    empty table has no rows."""
    counts = written(term_counts(docs, least), "terms")
    totals = counts.groupBy("lang", "whole", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    langs = totals.where("whole").select("lang", F.col("own").alias("v"), F.col("total").alias("lang_total"))
    sources = read(docs).select("lang", "source").distinct().join(totals.where("not whole").drop("whole"), ["lang", "source"], "left").join(langs.drop("lang_total"), "lang", "left").na.fill(0, ["total", "own", "v"])
    none = F.when(F.col("v") == 0, F.lit(0).cast("long"))  # no term is kept
    groups = sources.select("lang", "source", "total", "own", "v", none.otherwise(_share("0")).alias("z"))

    sized = counts.where("not whole").join(groups.drop("own"), ["lang", "source"]).select("lang", "term", "whole", "source", _share("n").alias("p"), "z")
    whole = counts.where("whole").join(langs.withColumnRenamed("lang_total", "total"), "lang").select("lang", "term", "whole", "source", _share("n").alias("p"), F.lit(0).cast("long").alias("z"))
    runs = sized.union(whole).repartition("lang", "term").sortWithinPartitions("lang", "term", F.desc("whole"), "source")
    found = written(runs.mapInArrow(_differences, PARTS), "differences")

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"), F.col("own").alias("other_own"))
    absent = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", ((F.col("v") - F.col("own") - F.col("other_own")) * F.abs(F.col("z") - F.col("other_z"))).alias("value"))
    equal = sized.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    alone = equal.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("other_z"))).alias("value"))
    # summed for each two sources before both take the sum
    halves = alone.union(found.where("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    pairs = halves.select("lang", turned, "value").select("lang", "e.source", "e.item", "value").union(absent).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", rank).where(F.col("rank") <= ranks)
    both = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(first.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
