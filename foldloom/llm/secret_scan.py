"""Secret scans: fixed patterns, and strings that a battery of randomness tests tells from structured text.

The patterns give the base spans. They are cut out of every run of the widest alphabet's characters, and each stretch
of SHORTEST or more that is left is a candidate: what a secret is joined to doesn't hide it. A stretch's encoding is inferred from
its characters. Three tests, a chi-squared one of uniformity over the alphabet, one of the number of runs of a kind of
character, and one of serial correlation of neighbours' places in the alphabet (of long stretches, at every lag to half their
length), ask twice. First, is the stretch too regular for random characters of that encoding? If any test says so at
GATE, it is structured text, however long. Then, is it too even for structured text? Uniformity and runs are held against
what structured text has at least (or most), and Fisher's method joins the two p-values. A weighted Benjamini-Hochberg
step, over the candidates of all documents, keeps the rate of false discoveries at ALPHA; weights are a fixed
function of a stretch's own length, at most 1, so a long stretch takes nothing from others and none passes above ALPHA.

The structured side's bounds, of narrow alphabets each its own, were fitted to words of the documents of scale 0.01, joined as identifiers, paths, versions and
Base64 of text; README states the rates reached on words of other documents.

What is counted over all documents is a table of candidates by length class and p-value bin, at most
64 * BINS rows; a bin's upper edge stands for its p-values, which errs on the safe side.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .text_kernels import lean

#: The patterns, in order, with the least length of what counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_VALUE, SHORTEST = 6, 20
#: Alphabets of encodings, the narrowest that holds all characters being the one inferred.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower": LOWER,
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
VOWELS = frozenset("aeiouyAEIOUY")
#: Of structured text, fitted: the least sum of squared character shares, above that of short alphabets; the most changes of
#: kind, as a share of those that random characters have; the least changes between vowels and others in letters alone.
SQUARES, LEAST_EXCESS, CHANGES, VOWEL_CHANGES = 0.055, 0.3, 0.78, 0.48
#: From this length on the least excess falls off: longer structured text may be as even as Base64 of text.
EVEN_FROM = 48
#: The same of narrow alphabets, which Base64 of text never has, so that nothing falls off: the least excess of squared shares,
#: and the most (in letters, the least) changes.
NARROW = {"hex": (1.0, 0.85), "HEX": (1.0, 0.85), "lower": (0.95, 0.53), "upper": (0.95, 0.53), "base32": (0.8, 0.82), "base36": (0.95, 0.82), "BASE36": (0.95, 0.82)}
#: Groups of digits that separators join, as in a UUID.
GROUPED = re.compile(r"[0-9A-Fa-f]{4,}(?:[-_][0-9A-Fa-f]{4,})+")
GATE, EVERY_LAG = 1e-3, 128
ALPHA, BINS, STEPS = 0.01, 4000, 10  # STEPS bins to a factor of e
TINY = 1e-300


class Alphabet:
    def __init__(self, chars: str):
        self.chars, self.size = frozenset(chars), len(chars)
        self.place = {c: i for i, c in enumerate(chars)}
        self.letters = all(c.isalpha() for c in chars)
        kinds = [VOWELS.__contains__, lambda c: True] if self.letters else [str.islower, str.isupper, str.isdigit, lambda c: True]
        if chars.isdigit():
            kinds = [lambda c: self.place[c] < self.size // 2, lambda c: True]
        self.kind = {c: next(i for i, k in enumerate(kinds) if k(c)) for c in chars}
        shares = np.bincount(list(self.kind.values())) / self.size
        self.changes = 1 - float((shares * shares).sum())  # of random characters


ALPHABETS = {k: Alphabet(v) for k, v in ENCODINGS.items()}


def encoding(body: str) -> str:
    """The narrowest encoding that holds all characters."""
    kinds = set(body)
    return next((k for k, a in ALPHABETS.items() if kinds <= a.chars), "mixed")


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _at_least(hits: int, n: int, share: float) -> float:
    """P(X >= hits) for n draws of probability ``share``: exact when short, else the normal tail."""
    if hits <= 0:
        return 1.0
    if n > 200:
        return max(TINY, _normal(-(hits - 0.5 - n * share) / math.sqrt(n * share * (1 - share))))
    term = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share))
    return min(1.0, max(TINY, sum(term(k) for k in range(hits, n + 1))))


def _most_regular(x: np.ndarray) -> float:
    """The greatest serial correlation in standard deviations of random characters, less what trying many lags gives."""
    n, d = len(x), x - x.mean()
    total = float((d * d).sum())
    if not total:
        return math.inf
    if n < EVERY_LAG:
        return abs(float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n)
    wide = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(d, wide)
    lags = np.arange(1, n // 2 + 1)
    z = np.abs(np.fft.irfft(f * f.conj(), wide)[1 : n // 2 + 1] / total + 1 / n) * n / np.sqrt(n - lags)
    return float(z.max()) - math.sqrt(2 * math.log(len(lags)))


def battery(run: str) -> tuple[str, float]:
    """The inferred encoding and the joint p-value under structured text; small: looks random. 1 if too regular."""
    body = run.rstrip("=")
    if GROUPED.fullmatch(body):
        body = body.replace("-", "").replace("_", "")
    name = encoding(body)
    own = ALPHABETS[name]
    x = np.array([own.place.get(c, 0) for c in body])
    n, size = len(x), own.size
    if n < SHORTEST - 4:
        return name, 1.0
    counts = np.bincount(x, minlength=size).astype(float)
    chi = float((counts * counts).sum()) * size / n - n
    kind = np.array([own.kind.get(c, 0) for c in body])
    pairs, changes = n - 1, int((np.diff(kind) != 0).sum())
    # too regular for random characters: chi-squared by Wilson and Hilferty, the others by their normal limits
    free = size - 1
    uneven = ((max(chi, 0.0) / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free))
    few = (pairs * own.changes - changes) / math.sqrt(pairs * own.changes * (1 - own.changes))
    if _normal(-uneven) < GATE or _normal(few if own.letters else -few) < GATE or 2 * _normal(-_most_regular(x)) < GATE:
        return name, 1.0
    # too even for structured text
    excess, most = NARROW.get(name) or (max(LEAST_EXCESS, (size * SQUARES - 1) * min(1.0, EVEN_FROM / n)), VOWEL_CHANGES if own.letters else CHANGES)
    middle, spread = free + (n - 1) * excess, math.sqrt(2 * free + 4 * n * excess)
    uniform = max(TINY, _normal((chi - middle) / spread))
    runs = _at_least(pairs - changes, pairs, 1 - most) if own.letters else _at_least(changes, pairs, most * own.changes)
    fisher = -math.log(uniform) - math.log(runs)
    return name, min(1.0, math.exp(-fisher) * (1 + fisher))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p) of the stretches of SHORTEST or more characters that base spans leave of the runs."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] < b:
            s, e, _ = base[i]
            i += 1
            a = max(a, reach)
            if s - a >= SHORTEST:
                out.append((a, s, battery(text[a:s])[1]))
            reach = max(reach, e)
        a = max(a, reach)
        if b - a >= SHORTEST:
            out.append((a, b, battery(text[a:b])[1]))
    return out


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,end:int,kind:int>>, runs array<struct<start:int,end:int,bin:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bin", pa.int32())])


def _scan(at: int, columns: list[int]):
    """Of each batch: the columns asked for, and what the scan finds in the text column ``at``."""

    def run(batches):
        for batch in batches:
            n, sums, spans, runs = ([], [], []), [], [], []
            for text in batch.column(at).to_pylist():
                text = text or ""
                base = base_spans(text)
                for k in range(3):
                    n[k].append(sum(s[2] == k for s in base))
                sums.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in base])
                runs.append([{"start": a, "end": b, "bin": min(BINS - 1, int(-math.log(max(p, 1e-300)) * STEPS))} for a, b, p in candidates(text, base)])
            arrays = [batch.column(c) for c in columns] + [pa.array(x, pa.int64()) for x in n] + [pa.array(sums), pa.array(spans, pa.list_(_SPAN)), pa.array(runs, pa.list_(_RUN))]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    return run


def length_class(run: Column) -> Column:
    return F.floor(F.log2((run["end"] - run["start"]).cast("double"))).cast("int")


def weight(c: int) -> float:
    """Of a length class: stretches under 32 characters can seldom be told for certain, and count half."""
    return min(1.0, 2.0 ** (c - 5))


def thresholds(counts: dict[tuple[int, int], int], alpha: float = ALPHA) -> dict[int, int]:
    """``counts`` by (length class, bin). The least bin of each class that the weighted step-up lets pass."""
    total = sum(counts.values())
    edge = lambda c, b: math.exp(-b / STEPS) / weight(c)
    seen, limit = 0, None
    for (c, b), n in sorted(counts.items(), key=lambda x: (edge(*x[0]), x[0])):
        seen += n
        if edge(c, b) <= alpha * seen / total:
            limit = edge(c, b)
    if limit is None:
        return {}
    return {c: next(b for b in range(BINS + 1) if edge(c, b) <= limit * (1 + 1e-12)) for c in {c for c, _ in counts} if edge(c, BINS) <= limit}


def scanned(docs: DataFrame, keep: list[str], text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """Columns ``keep`` of each row, with n_assign, n_access, n_hex, base_sha256, and ``secrets``: all spans as
    array<struct<start, end, kind>> by start, then kind, kinds numbered as in KINDS; places are code points.

    A null or empty text has no spans. Rows are judged each for itself; columns may be null or repeat; an empty table gives
    an empty result. Columns of the input named like the result's must not be in ``keep``.
    """
    own = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + list(T._parse_datatype_string(FOUND).fields))
    found = written(docs.select(*own).mapInArrow(lean(_scan(own.index(text), [own.index(c) for c in keep])), schema), "secrets")
    counts = found.select(F.explode("runs").alias("r")).groupBy(length_class(F.col("r")).alias("c"), F.col("r.bin").alias("b")).count()
    bins = thresholds({(r["c"], r["b"]): r["count"] for r in counts.collect()}, alpha)  # at most 64 * BINS rows
    passed = F.lit(False)
    test = lambda r: _any([(length_class(r) == c) & (r["bin"] >= b) for c, b in sorted(bins.items())], passed)
    extra = F.transform(F.filter("runs", test), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(3).alias("kind")))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    secrets = F.array_sort(F.concat("base", extra), order)
    return found.select(*keep, "n_assign", "n_access", "n_hex", "base_sha256", secrets.alias("secrets"))


def _any(tests: list[Column], none: Column) -> Column:
    for t in tests:
        none = none | t
    return none


def spans_text(secrets: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(secrets, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


MARK = "[secret]"


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by MARK."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], MARK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", length: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with secrets taken out of ``text``; a column ``length``, if named, keeps counting the text's characters."""
    away = {c: f"_s_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in away.items()])
    found = scanned(own, list(away.values()), away[text], alpha).drop("n_assign", "n_access", "n_hex", "base_sha256")
    at, spans = found.columns.index(away[text]), found.columns.index("secrets")
    count = found.columns.index(away[length]) if length else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:spans])
            hit = pa.compute.list_value_length(batch.column(spans)).to_numpy(zero_copy_only=False) > 0
            if hit.any():
                texts = batch.column(at).to_pylist()
                for i in np.flatnonzero(hit).tolist():
                    texts[i] = redact(texts[i], [(s["start"], s["end"]) for s in batch.column(spans)[i].as_py()])
                columns[at] = pa.array(texts, batch.column(at).type)
                if count is not None:
                    lengths = batch.column(count).to_pylist()
                    for i in np.flatnonzero(hit).tolist():
                        lengths[i] = len(texts[i])
                    columns[count] = pa.array(lengths, batch.column(count).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:spans])

    out = found.mapInArrow(lean(run), T.StructType(found.schema.fields[:spans]))
    return out.select(*[F.col(a).alias(c) for c, a in away.items()])
