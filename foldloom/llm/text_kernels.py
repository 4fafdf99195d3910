"""NumPy over the bytes of Arrow string arrays: words, word hashes and word shingles of many texts at once.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash is 64 bits wide: its bytes in lanes of
eight, each lane passed through a finaliser with its place, added up with the word's length and passed through it once more. A
word of up to eight bytes has a hash of its own by construction. There is no algebra between lanes that regular words
could cancel out. Two ``seed`` values give two independent hashes; what is decided for good is decided by both, 128
bits. Work goes in blocks of about BLOCK bytes, so that memory stays bounded however long a text is.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
_PLACE = _rng.integers(0, 1 << 64, (2, 64), dtype=np.uint64) | np.uint64(1)
_SEED = _rng.integers(0, 1 << 64, 2, dtype=np.uint64)
_LANE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
#: The bytes of a lane that belong to a word with so many left.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input bears on every bit of the output, and no two inputs share an output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the non-empty spans of ``data``, bytes followed by at least seven that no span holds."""
    lanes_at = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))

    def lanes(at: np.ndarray, left: np.ndarray, j) -> np.ndarray:
        own = lanes_at[at].view(np.uint64).ravel() & _MASK[np.minimum(left, 8)]
        return mixed(own + mixed(np.atleast_1d(j).astype(np.uint64) * _LANE + _SEED[seed]))

    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), BLOCK):
        s, n = starts[a : a + BLOCK], ends[a : a + BLOCK] - starts[a : a + BLOCK]
        total = lanes(s, n, 0)
        long = np.flatnonzero(n > 8)
        more = (n[long] - 1) >> 3  # lanes after the first
        upto = np.cumsum(more)
        b = 0
        while b < len(long):  # by lanes, or a word that has more alone
            c = max(b + 1, int(np.searchsorted(upto, (upto[b - 1] if b else 0) + BLOCK, "right")))
            words, k = long[b:c], more[b:c]
            first = np.cumsum(k) - k
            whose = np.repeat(np.arange(c - b), k)
            j = np.arange(len(whose)) - first[whose] + 1
            total[words] += np.add.reduceat(lanes(s[words][whose] + 8 * j, n[words][whose] - 8 * j, j), first)
            b = c
        out[a : a + BLOCK] = mixed(total + n.astype(np.uint64) * _PLACE[seed, 63])
    return out


def pieces(ids: pa.Array, texts: pa.Array, most: int = 2 * BLOCK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    at, ends = 0, np.cumsum(np.diff(offsets(texts)))
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield ids.slice(at, to - at), texts.slice(at, to - at)
        at = to


def offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def word_hashes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of texts without nulls: the hash of each word, and where each text's words begin (one entry more than texts)."""
    off = offsets(texts)
    first, last = int(off[0]), int(off[-1])
    if first == last:
        return np.empty(0, dtype=np.uint64), np.zeros(len(off), dtype=np.int64)
    data = np.zeros(last - first + 8, dtype=np.uint8)
    np.take(_LOWER, np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:last], out=data[:-8])
    off = off - first
    inside = _WORD[data[:-8]]
    edge = np.zeros(len(inside) + 1, dtype=bool)  # a text ends a word, whatever the next begins with
    edge[off] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return hashed(data, starts, ends, seed), np.searchsorted(starts, off, "left")


def shingle_sets(texts: pa.Array, k: int, whole_if_short: bool, seed: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles. A text of 1 to ``k`` - 1 words has none, or, with
    ``whole_if_short``, one for all of its words."""
    words, at = word_hashes(texts, seed)
    place = _PLACE[seed]
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        runs += words[i : i + n] * place[i]
    runs = mixed(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a and whole_if_short:
            with np.errstate(over="ignore"):
                own = (words[a:b] * place[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a) * place[62]
            yield mixed(np.array([own], dtype=np.uint64))
        else:
            yield np.empty(0, dtype=np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def lean(run, large: int = 1 << 20):
    """``run`` over a task's batches, handing arrays of ``large`` bytes straight back to the system, and the rest when the task
    ends: workers live on, and what idle ones keep counts against their executor."""

    def wrapped(batches):
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, large)  # M_MMAP_THRESHOLD, else it grows with what is freed
        except (OSError, AttributeError):
            libc = None
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return wrapped


_letters: dict[str, np.ndarray] = {}


def is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if "all" not in _letters:
        _letters["all"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters["all"]


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of letters, as they are written: the code points of all texts, the words' starts, ends and hashes, and
    where each text's words begin (one entry more than texts)."""
    points = np.frombuffer(" ".join([*texts, "  "]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = is_letter()[points]
    change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = change[::2], change[1::2]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return points, starts, ends, hashed(points.view(np.uint8), 4 * starts, 4 * ends), np.searchsorted(starts, begins, "left")
