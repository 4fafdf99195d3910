"""N-gram Jaccard self-join: rare-first prefixes, filters by length, position and suffix, each pair verified once.

1. Texts with equal shingle sets are one class, whose least doc_id stands for it; classes of copies are never expanded.
2. Shingles are ordered rare first. Any fixed total order gives right results, so frequencies are counted in a sketch of
   fixed size (2 ** SKETCH_BITS counts, the only thing broadcast), which sets the common ones apart.
3. Each class emits its prefix: two sets as similar as asked share a shingle of the first's probing prefix and the
   second's (smaller) indexing prefix. Shingles of one class only are dropped by an aggregate and a join.
   A length, a position, a suffix and a whole-set filter then bound the intersection that a pair could have.
4. Links are wanted for components, so a group of near copies needn't be paired in full: in PIVOT_ROUNDS round(s) the
   members of each prefix shingle's group are offered one member of it, and each document is paired with one that it is
   offered. What then is in one component needs no further pairs.
5. Where more than HOT members still share a prefix shingle, the sketch has put a common one first. The members of such groups
   are ordered anew, by the exact frequencies of all their shingles among them, counted in an aggregate, and get new
   prefixes; a pair of them that is similar shares a shingle of those. So texts that have most in common, and yet aren't similar, part at
   shingles of their own instead of being paired one with another.
6. The rest, every pair of a shingle's group across components, is paired exactly. A pair passes the filters first, is
   made distinct, and is verified once, by the exact intersection of the two sets.

:func:`similar_pairs` forms every pair, without pivots, and :func:`link_counts` gives each document's number of links.

A third of all rows in one group is one class, or a group that pivots join up in a few rounds; joins on a hot shingle
are sort-merge joins that adaptive execution can split. Defined results: see :func:`ngram_join`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, extended
from .shared import dropped, swept, written
from .text_kernels import lean, pieces, shared, shingle_sets

SKETCH_BITS = 18
PIVOT_ROUNDS, HOT = 1, 64
CLASSES = 8  # of hashes, in a suffix's signature: CLASSES counters of one byte
PARITY = 256  # classes of hashes in a whole set's signature: the parity of each class's count, in longs
FILTER_BITS = 22
ODD = tuple(f"p{i}" for i in range(PARITY // 64))
MEMBER = ("id", "n", "pos", "sig", "index", "component", *ODD)


def _prefixes(n: int, num: int, den: int) -> tuple[int, int]:
    """Lengths of the probing prefix (the larger set's) and the indexing prefix (the smaller set's)."""
    probe = n - -(-n * num // den) + 1
    index = n - -(-2 * n * num // (num + den)) + 1
    return probe, min(index, probe)


def _signatures(k: int, bits: int = SKETCH_BITS):
    """Per text: its set's size and a digest of it under both hashes (kind 0). Per task: how many texts' sets have each bucket of the sketch (kind 1)."""

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int64)
        low = np.uint64((1 << bits) - 1)
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1)):
                n, digests = [], []
                for own, other in zip(shingle_sets(texts, k, True), shingle_sets(texts, k, True, 1), strict=True):
                    n.append(max(len(own), len(other)))
                    digests.append(hashlib.blake2b(own.tobytes() + other.tobytes(), digest_size=16).digest() if len(own) else None)
                    counts[(own & low).astype(np.int64)] += 1
                yield _batch(ids, n, digests, 0)
        seen = np.flatnonzero(counts)
        yield _batch(pa.array(seen, pa.int64()), counts[seen], [None] * len(seen), 1)

    def _batch(ids, n, digests, kind):
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([kind] * len(ids), pa.int32())], ["id", "n", "digest", "kind"])

    return run


def _ordered(own: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the join's order, rare first; a one-to-one recoding of the hashes, sorted."""
    bits = len(rank).bit_length() - 1
    low = (own & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.sort((rank[low] << np.uint64(64 - bits)) | (own >> np.uint64(bits)))


HEADS = "id long, n long, head array<long>, tail array<long>, " + ", ".join(f"{c} long" for c in ODD) + ", wide binary"


def _heads_of(ids: pa.Array, sets: Iterable[tuple[np.ndarray, np.ndarray]], num: int, den: int) -> pa.RecordBatch:
    """Of (set, set in order) whose set can be similar to another one: the prefix in order, and at each of its places the
    signature of what follows: counters, modulo 256, of the later shingles in each class. Also the whole set's parities."""
    keep, sizes, heads, tails, odd, wide = [], [], [], [], [], []
    for i, (own, order) in enumerate(sets):
        n = len(own)
        if n == 0 or n * den < num * (n + 1):  # too small to be similar to any other set than an equal one
            continue
        wide.append(parities(own))
        odd.append(np.packbits(np.bincount((own >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1).view(np.int64))
        p, _ = _prefixes(n, num, den)
        kinds = (order % np.uint64(CLASSES)).astype(np.int64)
        total = np.bincount(kinds, minlength=CLASSES)
        after = total - np.cumsum(np.eye(CLASSES, dtype=np.int64)[kinds[:p]], axis=0)
        keep.append(i)
        sizes.append(n)
        heads.append(order[:p].view(np.int64))
        tails.append(np.ascontiguousarray((after & 255).astype(np.uint8)).view(np.int64).ravel())
    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32))
    flat = lambda xs: pa.ListArray.from_arrays(at, pa.array(np.concatenate(xs) if xs else np.empty(0, np.int64), pa.int64()))
    narrow = np.array(odd, dtype=np.int64).reshape(-1, PARITY // 64)
    columns = [ids.take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), flat(heads), flat(tails), *[pa.array(np.ascontiguousarray(narrow[:, i])) for i in range(PARITY // 64)], pa.array(wide, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "head", "tail", *ODD, "wide"])


def _heads(k: int, num: int, den: int, rank):
    """HEADS of each text, in the sketch's order."""

    def run(batches):
        r = rank.value
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1)):
                yield _heads_of(ids, ((own, _ordered(own, r)) for own in shingle_sets(texts, k, True)), num, den)

    return run


def _exact_heads(num: int, den: int):
    """HEADS of rows (id, shingles, frequencies), in the order of frequencies."""

    def run(batches):
        for batch in batches:
            sets = []
            for tokens, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, first = np.unique(np.array(tokens, dtype=np.int64).view(np.uint64), return_index=True)  # rows that repeat come once
                sets.append((own, own[np.argsort(np.array(counts)[first], kind="stable")]))
            yield _heads_of(batch.column(0), sets, num, den)

    return run


def _each(k: int):
    """(id, own, token) of each text's shingles; ``own`` tells texts apart that share an id."""

    def run(batches):
        for batch in batches:
            for ids, texts in pieces(batch.column(0), batch.column(1)):
                sets = list(shingle_sets(texts, k, True))
                whose = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                own = np.array([np.bitwise_xor.reduce(x) for x in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), pa.array(own[whose].view(np.int64)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "own", "token"])

    return run


def parities(own: np.ndarray) -> bytes:
    """A bit for each of about as many classes of hashes as the set has members, a power of two: the parity of its count."""
    classes = max(PARITY, 1 << int(len(own)).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) & (classes - 1), minlength=classes) & 1).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """How many members two sets at least don't share, by their parities; the longer are folded to the shorter's length."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _near(num: int, den: int):
    """Pairs (a, b, n_a, wide_a, n_b, wide_b) that their parities leave possible."""

    def run(batches):
        for batch in batches:
            a, b, n, wide_a, m, wide_b = (c.to_pylist() for c in batch.columns)
            ok = [x + y - least_apart(p, q) >= 2 * -(-num * (x + y) // (num + den)) for x, p, y, q in zip(n, wide_a, m, wide_b, strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _marked(wanted):
    """(id, text) of the texts whose id's bit is set in the map ``wanted``."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            own = _bit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.filter(pa.array((bits[own >> 6] >> (own & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    return ids & ((1 << FILTER_BITS) - 1)


def _map_of(ids: DataFrame) -> np.ndarray:
    """A map of 2 ** FILTER_BITS bits in 64-bit words, with the bits of ``ids`` set."""
    place = F.col("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # fixed number of rows
        bits[r["w"]] = np.uint64(r["b"] & ((1 << 64) - 1))
    return bits


def _similar(k: int, num: int, den: int):
    """Pairs (a, b) of (a, b, text_a, text_b) whose sets are similar: under both hashes, as the second only can say no."""

    def intersections(rows: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the sizes of both sets together, and of their intersection."""
        keys = rows.column(0).to_numpy()
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] + 1))  # an a whose rows follow each other is taken once
        left = list(shingle_sets(rows.column(2).take(pa.array(first)), k, True, seed))
        whose = np.searchsorted(first, np.arange(len(keys)), "right") - 1
        out = np.array([(len(left[i]) + len(y), shared(left[i], y)) for i, y in zip(whose.tolist(), shingle_sets(rows.column(3), k, True, seed), strict=True)])
        return out[:, 0], out[:, 1]

    def run(batches):
        for batch in batches:
            places = pa.array(np.arange(len(batch)))
            for part, _ in pieces(places, batch.column(3)):
                rows = batch.slice(part[0].as_py(), len(part))
                for seed in (0, 1):
                    if len(rows):
                        total, both = intersections(rows, seed)
                        rows = rows.filter(pa.array(both * den >= num * (total - both)))
                yield rows.select([0, 1])

    return run


def _passes(x: dict[str, Column], y: dict[str, Column], num: int, den: int) -> Column:
    """Length, position and suffix filters for a shared shingle of x, the larger set, and y, the smaller (ties by id)."""
    n, m = x["n"], y["n"]
    need = F.floor(((n + m) * num + (num + den - 1)).cast("double") / (num + den)).cast("long")
    left = F.least(n - x["pos"], m - y["pos"]) - 1  # shingles after the shared one
    head = F.least(x["pos"], y["pos"]) + 1
    apart = F.lit(0).cast("long")
    for c in range(CLASSES):
        byte = lambda s: F.shiftrightunsigned(s, 8 * c).bitwiseAND(F.lit(255))  # noqa: B023, E731
        # the difference modulo 256 that is nearest to zero: never more than the true one
        apart = apart + F.abs(((byte(x["sig"]) - byte(y["sig"]) + 384).bitwiseAND(F.lit(255))) - 128)
    suffixes = (n - x["pos"] - 1) + (m - y["pos"] - 1)
    odd = F.lit(0)
    for c in ODD:  # a class of differing parity holds a shingle that the sets don't share
        odd = odd + F.bit_count(x[c].bitwiseXOR(y[c]))
    return (m * den >= n * num) & y["index"] & (head + left >= need) & (n + m - odd >= 2 * need) & (2 * head + suffixes - apart >= 2 * need)


def _member(p: str) -> dict[str, Column]:
    return {c: F.col(f"{p}{c}") for c in MEMBER}


def _pairs(both: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) of a joined frame with the columns of two members, x_ and y_, that the filters let pass."""
    x, y = _member("x_"), _member("y_")
    larger = (x["n"] > y["n"]) | (x["n"] == y["n"]) & (x["id"] > y["id"])
    ok = F.when(larger, _passes(x, y, num, den)).otherwise(_passes(y, x, num, den))
    return both.where((x["id"] != y["id"]) & (x["component"] != y["component"]) & ok).select(x["id"].alias("x"), y["id"].alias("y"))


def _named(df: DataFrame, p: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{p}{c}") for c in MEMBER])


def _hits(heads: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (token, id, n, pos, sig, index, parities) of prefixes whose token is in more than one, and in an indexing prefix."""
    index = F.col("pos") < F.col("n") - F.floor((2 * F.col("n") * num + num + den - 1).cast("double") / (num + den)).cast("long") + 1
    each = heads.select("id", "n", F.posexplode(F.arrays_zip("head", "tail")).alias("pos", "at")).select(F.col("at.head").alias("token"), "id", "n", "pos", F.col("at.tail").alias("sig"))
    # in one sum: how many have the shingle in their prefix, and, from bit 32 on, how many in their indexing prefix
    seen = each.groupBy("token").agg(F.sum(F.when(index, F.lit((1 << 32) + 1)).otherwise(F.lit(1).cast("long"))).alias("c"))
    shared = seen.where((F.col("c").bitwiseAND(F.lit((1 << 32) - 1)) > 1) & (F.col("c") >= 1 << 32)).select("token")
    own = heads.select("id", "n", *ODD).distinct()
    return each.drop("n").join(shared, "token", "left_semi").join(own, "id").select("token", "id", "n", F.col("pos").cast("long").alias("pos"), "sig", index.alias("index"), *ODD)


def _labelled(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``rows`` with the component of each ``id``."""
    if parts is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(parts, F.col("id") == F.col("node"), "left").select(rows["*"], F.coalesce("component", "id").alias("component"))


def _across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) of every pair of a token's rows, labelled ones, that are in different components."""
    # a shingle's largest component isn't paired with itself; the others are, with it and among themselves
    most = rows.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"))
    others = _named(rows.join(most, "token").where("component <> most.component"), "x_")
    return _pairs(others.join(_named(rows, "y_"), "token"), num, den)


def links(docs: DataFrame, k: int, num: int, den: int, pivots: int = PIVOT_ROUNDS, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, found): rows (id, n, digest) of each document; parts (node, component) of the classes that have links; found
    (a, b), the links between classes that were verified, all there are if ``pivots`` is 0. ``docs``: (id long not null, text)."""
    spark = docs.sparkSession
    found = written(docs.mapInArrow(lean(_signatures(k, sketch_bits)), "id long, n long, digest binary, kind int"), "sets", by="kind")
    rows = found.where("kind = 0").select("id", "n", "digest")
    counts = np.zeros(1 << sketch_bits, dtype=np.int64)
    for r in found.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():  # fixed number of rows
        counts[r["id"]] = r["n"]
    rank = np.empty(1 << sketch_bits, dtype=np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << sketch_bits, dtype=np.uint64)
    rank = spark.sparkContext.broadcast(rank)

    own = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    heads = docs.mapInArrow(lean(_heads(k, num, den, rank)), HEADS)
    heads = written(heads.join(own.select("id"), "id", "left_semi"), "heads")
    left = written(_hits(heads, num, den), "hits")
    wide = written(heads.select("id", "n", "wide"), "parities")
    dropped(heads)
    del own, heads
    swept(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are similar. Whole-set parities, a bit a shingle, rule out most of the others. The
        texts of what is left, kept back by a map of 2 ** FILTER_BITS bits and the joins, meet and are compared."""
        sides = [wide.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b")]
        near = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "n_a", "wide_a", "n_b", "wide_b")
        near = written(near.mapInArrow(lean(_near(num, den)), "a long, b long"), "near")
        texts = {}
        for c in ("a", "b"):
            sent = spark.sparkContext.broadcast(_map_of(near.select(F.col(c).alias("id"))))
            texts[c] = docs.mapInArrow(lean(_marked(sent)), "id long, text string").select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
        both = near.join(texts["b"], "b").join(texts["a"], "a").select("a", "b", "text_a", "text_b")
        similar = written(both.mapInArrow(lean(_similar(k, num, den)), "a long, b long").distinct(), "verified")
        dropped(near)
        return similar

    def reordered(ids: DataFrame) -> DataFrame:
        """Hits of the documents ``ids`` (id) in the order of their shingles' exact frequencies among them."""
        sent = spark.sparkContext.broadcast(_map_of(ids))
        texts = docs.mapInArrow(lean(_marked(sent)), "id long, text string").join(ids, "id", "left_semi")
        each = written(texts.mapInArrow(lean(_each(k)), "id long, own long, token long"), "shingles")
        often = each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        counted = each.join(often, "token", "left").groupBy("id", "own").agg(F.collect_list(F.struct("token", F.coalesce("c", F.lit(1)).alias("c"))).alias("s"))  # a row a document
        heads = written(counted.select("id", "s.token", "s.c").mapInArrow(lean(_exact_heads(num, den)), HEADS), "heads")
        hits = written(_hits(heads, num, den), "hits-anew")
        dropped(each)
        dropped(heads)
        return hits

    done = parts = None
    verified_all: list[DataFrame] = []
    for round_ in range(pivots + 1):
        if parts is not None:
            # shingles whose documents are one component by now stay closed; only the others' rows go on
            inside = _labelled(left.select("token", "id"), parts)
            open_ = inside.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
            before, left = left, written(left.join(open_, "token", "left_semi"), "hits")
            dropped(before)
        left_now = left.withColumn("component", F.col("id")) if parts is None else written(_labelled(left, parts), "hits-labelled")
        if round_ < pivots:
            one = F.min if round_ == 0 else F.max
            offered = left_now.groupBy("token").agg(one(F.struct(*MEMBER)).alias("y")).select("token", *[F.col(f"y.{c}").alias(f"y_{c}") for c in MEMBER])
            # of the members that a document's shingles offer, one is tried in a round
            pairs = _pairs(_named(left_now, "x_").join(offered, "token"), num, den).groupBy("x").agg(one("y").alias("y"))  # y is less, or greater, than x: no pair comes twice
        else:
            crowds = written(left_now.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("token"), "crowds")
            if crowds.isEmpty():
                pairs = _across(left_now, num, den)
            else:
                anew = reordered(left_now.join(crowds, "token", "left_semi").select("id").distinct())
                pairs = _across(left_now.join(crowds, "token", "left_anti"), num, den).union(_across(_labelled(anew, parts), num, den))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = pairs if round_ < pivots else pairs.distinct()
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.union(pairs)
        new = None if pairs.isEmpty() else verified(pairs)
        if parts is not None:
            dropped(left_now)
        if new is not None and not new.isEmpty():
            verified_all.append(new)
            parts = written(components(new) if parts is None else extended(parts, new), "parts")
    dropped(wide)
    dropped(left)
    if parts is None:
        return rows, spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "a long, b long")
    found = verified_all[0]
    for more in verified_all[1:]:
        found = found.union(more)
    return rows, parts, found


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles, component_id (the least key reachable by links of similarity num / den
    or more, itself included) and n_copies (rows whose set is equal, itself included; 0 without shingles).

    A null or empty text has no shingles and is linked with nothing. A text of fewer than ``k`` words is one shingle. A row
    without a key keeps n_shingles, links nothing and has a null component. Rows that repeat a key stay, in one component. An
    empty table gives an empty result; other columns aren't looked at.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows, parts, _ = links(source.where("id is not null"), k, num, den)
    nameless = source.where("id is null").select(F.lit(0).cast("long").alias("id"), "text").mapInArrow(lean(_signatures(k)), "id long, n long, digest binary, kind int").where("kind = 0")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n_copies"))
    classes = classes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "n_copies")
    out = rows.join(classes, "digest", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
    none = F.lit(None).cast("long")
    return out.union(nameless.select(none, "n", none, F.lit(0).cast("long")))


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, n_a, n_b), a < b, of every two classes of equal shingle sets that are similar, a class going by
    its least key; members (``key``, class, n_shingles, n_copies) of every row with a key and shingles. Both are empty for an
    empty table. Rows that repeat a key count as copies each, in the class of what they hold."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    rows, _, found = links(source, k, num, den, pivots=0)
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("class"), F.count("*").alias("n_copies"), F.max("n").alias("n"))
    members = rows.join(classes.drop("n"), "digest").select(F.col("id").alias(key), "class", F.col("n").alias("n_shingles"), "n_copies")
    size = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"))
    return found.join(size("a"), "a").join(size("b"), "b").select("a", "b", "n_a", "n_b"), members


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``key``, class, n_shingles, n_copies and n_links of each member: the rows that it is linked with, copies and similar ones."""
    pairs, members = similar_pairs(docs, key, text, k, num, den)
    sizes = members.select("class", "n_copies").distinct()
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("class", "other")
    linked = both.join(sizes.select(F.col("class").alias("other"), "n_copies"), "other").groupBy("class").agg(F.sum("n_copies").alias("similar"))
    return members.join(linked, "class", "left").select(key, "class", "n_shingles", "n_copies", (F.col("n_copies") - 1 + F.coalesce("similar", F.lit(0))).alias("n_links"))
