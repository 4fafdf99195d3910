"""Quality rules by weak supervision: rules vote or abstain, EM estimates how accurate each is, a posterior decides.

Everything is DataFrame functions. A text is handled inside its own row, so no words are shuffled; what is shuffled
are counts of vote patterns, of which there are at most 3 ** len(RULES).

Defined results: a null text counts as no words, fails the base rule and is not kept; an empty text likewise. Rows that
repeat are judged alike, each on its own. Votes for which EM doesn't settle are judged by the likeliest model found. Extra
columns of the input pass through :func:`quality_filter` unchanged; names of this module's own columns start with ``_q_``. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: White space between words, and the characters that count as symbols.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Positions take the low bits of a packed window key; no array is longer than 2**31.
POSITION_BITS = 31
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: EM goes on until no rate moves by more than TOLERANCE. No step makes the model less likely, so one that hasn't settled after
#: MOST steps is the likeliest so far, and is taken.
TOLERANCE, MOST = 1e-6, 10_000
PRIOR_KEPT = 0.9
#: Starting values of P(votes good | good) and P(votes bad | bad), and the range that each stays in: a rule seldom speaks
#: against a good text, but may miss many bad ones. The ranges keep the two classes from changing places.
START_GOOD, RANGE_GOOD = 0.98, (0.9, 0.995)
START_BAD, RANGE_BAD = 0.35, (0.15, 0.95)
RANGE_PRIOR = (0.5, 0.99)
#: Pseudo-votes behind the starting values, so that a rule that hardly ever votes keeps them.
PSEUDO = 20.0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's parameter, where inlining would compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are packed as (hash, position) into longs and sorted: equal hashes become neighbours. Only those are looked
    at again, as strings, so a collision of hashes changes nothing. O(n log n) in the length of the text.
    """
    n = F.size(words)

    def packed(hashes: Column) -> Column:
        key = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        pack = lambda i: F.shiftleft(key(i), POSITION_BITS).bitwiseOR(i.cast("long"))
        return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), pack)).otherwise(F.array().cast("array<bigint>"))

    def neighbours(sorted_keys: Column) -> Column:
        top = lambda x: F.shiftright(x, POSITION_BITS)
        same = lambda x, j: top(x).eqNullSafe(top(F.get(sorted_keys, j - 1))) | top(x).eqNullSafe(top(F.get(sorted_keys, j + 1)))
        return F.filter(sorted_keys, same)

    position = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")

    def exact(candidates: Column) -> Column:
        named = F.array_sort(F.transform(candidates, lambda x: F.struct(F.array_join(F.slice(words, position(x) + 1, WINDOW), " ").alias("w"), position(x).alias("i"))))
        same = lambda s: F.filter(s, lambda x, j: x["w"].eqNullSafe(F.get(s, j - 1)["w"]) | x["w"].eqNullSafe(F.get(s, j + 1)["w"]))
        return F.array_sort(F.transform(let(named, same), lambda x: x["i"]))

    # every start covers WINDOW words, less what the next start covers as well
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    candidates = let(F.sort_array(let(F.transform(words, lambda w: F.xxhash64(w)), packed)), neighbours)
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(let(candidates, exact), covered))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures of every whole text, all long, and those that only rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = lambda: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(_removed(x, SPACE)) > 0)
    of_words = let(
        words(),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("distinct"),
        ),
    )
    size = lambda c: F.length(c).cast("long")
    return (
        docs.withColumn("_q_w", of_words)
        .withColumns(
            {
                "n_words": F.col("_q_w.n_words"),
                "word_chars": size(_removed(t, SPACE)),
                "n_symbols": size(t) - size(_removed(t, SYMBOLS)),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": F.col("_q_w.n_repeat_words"),
                "_q_distinct": F.col("_q_w.distinct"),
                "_q_lines": F.size(lines).cast("long"),
                "_q_upper": size(F.regexp_replace(t, r"\P{Lu}+", "")),
                "_q_letters": size(F.regexp_replace(t, r"\P{L}+", "")),
                "_q_bangs": size(t) - size(_removed(t, "!")),
            }
        )
        .drop("_q_w")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    """1 good, 0 bad, -1 abstains."""
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """Each rule's vote. Bounds are parameters of the rules, chosen once; whole shares, so no division by zero."""
    c = F.col
    return {
        "length": _vote(c("n_words") >= 50, c("n_words") < 10),
        "symbols": _vote(100 * c("n_symbols") <= c("word_chars"), 100 * c("n_symbols") > 4 * c("word_chars")),
        "word_length": _vote((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        "symbol_words": _vote(100 * c("n_symbols") <= 5 * c("n_words"), 100 * c("n_symbols") > 20 * c("n_words")),
        "letters": _vote(100 * c("_q_letters") >= 85 * c("word_chars"), 100 * c("_q_letters") < 70 * c("word_chars")),
        "capitals": _vote(100 * c("_q_upper") <= 15 * c("_q_letters"), 100 * c("_q_upper") > 40 * c("_q_letters")),
        "bangs": _vote(100 * c("_q_bangs") <= 2 * c("n_words"), 100 * c("_q_bangs") > 25 * c("n_words")),
        "lines": _vote(100 * c("n_dup_lines") <= 5 * c("_q_lines"), 100 * c("n_dup_lines") > 30 * c("_q_lines")),
        "repeats": _vote(100 * c("n_repeat_words") <= 5 * c("n_words"), 100 * c("n_repeat_words") > 20 * c("n_words")),
        "variety": _vote((100 * c("_q_distinct") >= 30 * c("n_words")) | (c("n_words") > 500), 100 * c("_q_distinct") < 10 * c("n_words")),
    }


def _posterior(votes: list[Column], model: dict) -> Column:
    """P(good | votes), votes independent given the class; an abstention says nothing."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for v, g, b in zip(votes, model["good"], model["bad"], strict=True):
        odds = odds + F.when(v == 1, F.lit(math.log(g / (1 - b)))).when(v == 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str], tolerance: float = TOLERANCE, most: int = MOST) -> dict:
    """EM over counted vote patterns (columns ``names`` and ``count``), until no rate moves by more than ``tolerance`` or ``most``
    steps are done. The patterns are at most 3 ** len(names) rows, whatever the number of documents, so they are gathered once
    and the steps are arithmetic on the driver; no patterns leave the model as it starts."""
    rows = sorted(tuple(r) for r in patterns.select(*names, "count").collect())
    votes, count = np.array([r[:-1] for r in rows]).reshape(len(rows), len(names)), np.array([r[-1] for r in rows], dtype=float)
    for_, against = (votes == 1).astype(float), (votes == 0).astype(float)
    prior, good, bad = PRIOR_KEPT, np.full(len(names), START_GOOD), np.full(len(names), START_BAD)
    for _ in range(most):
        odds = math.log(prior / (1 - prior)) + for_ @ np.log(good / (1 - bad)) + against @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-odds))
        kept, gone = count * p, count * (1 - p)
        rate = lambda yes, no, start, bounds: np.clip((yes + PSEUDO * start) / (yes + no + PSEUDO), *bounds)
        new = rate(kept.sum(), gone.sum(), PRIOR_KEPT, RANGE_PRIOR), rate(kept @ for_, kept @ against, START_GOOD, RANGE_GOOD), rate(gone @ against, gone @ for_, START_BAD, RANGE_BAD)
        moved = max(abs(new[0] - prior), np.abs(new[1] - good).max(), np.abs(new[2] - bad).max())
        prior, good, bad = new
        if moved <= tolerance:
            break
    return {"prior": float(prior), "good": good.tolist(), "bad": bad.tolist()}


def judged(docs: DataFrame, keys: list[str] | None = None, text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Columns ``keys`` (default: all) of each row with the measures, ``base_failed``, ``posterior`` and ``kept``."""
    keys = docs.columns if keys is None else keys
    votes = rules()
    names = [f"_q_vote_{x}" for x in votes]
    # a clashing column of the input gives way while the measures are taken, as its value isn't asked for
    source = docs.select(*keys, *([] if text in keys else [text]))
    seen = measures(source, text).withColumns(dict(zip(names, votes.values(), strict=True)))
    slim = written(seen.select(*keys, *MEASURES, *names), "quality")
    model = fit(slim.groupBy(*names).count(), names, tolerance)
    posterior = _posterior([F.col(x) for x in names], model).alias("posterior")
    return slim.select(*keys, *MEASURES, base_failed().alias("base_failed"), posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, whole and without a shuffle; columns named like measures pass through."""
    away = {c: f"_q_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in away.items()])
    kept = judged(own, list(away.values()), away[text]).where("kept")
    return kept.select(*[F.col(a).alias(c) for c, a in away.items()])
