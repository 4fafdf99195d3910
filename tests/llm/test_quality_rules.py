from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foldloom.llm import quality_rules as q

from . import brute

GOOD = " ".join(f"{a}{b} the" for a in ("morning", "evening", "winter", "summer", "river") for b in ("light", "shade", "song", "road", "house", "field"))
TEXT = st.text(alphabet=st.sampled_from("ab \n\t#|é\x0b"), max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=12))
def test_measures(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[m] for m in q.MEASURES) for r in q.measures(rows).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = brute.quality(t)
        assert got[i] == (n, chars, symbols, lines, repeats)


def judged(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in q.judged(rows, ["doc_id"]).collect()}


def test_verdicts(spark):
    junk = ["### ".join(GOOD.split()) + "###", GOOD.upper().replace(" ", "!! ") + "!!"]
    got = judged(spark, [GOOD + f" end {i}." for i in range(40)] + junk + [None, "", "too short", "a b c d e f g h i j " * 30])
    assert all(got[i]["kept"] for i in range(40))
    assert not any(got[i]["kept"] for i in range(40, 46))
    assert [got[i]["base_failed"] for i in range(42, 46)] == [True, True, True, True]


def plain_em(patterns, most, tolerance=1e-6):
    """Prior and rates from {votes: count}, by plain loops."""
    size = len(next(iter(patterns)))
    prior, good, bad = q.PRIOR_KEPT, [q.START_GOOD] * size, [q.START_BAD] * size
    rate = lambda yes, no, start, bounds: min(bounds[1], max(bounds[0], (yes + q.PSEUDO * start) / (yes + no + q.PSEUDO)))
    for _ in range(most):
        chance = {}
        for votes in patterns:
            a, b = prior, 1 - prior
            for v, g, w in zip(votes, good, bad, strict=True):
                a, b = (a * g, b * (1 - w)) if v == 1 else (a * (1 - g), b * w) if v == 0 else (a, b)
            chance[votes] = a / (a + b)
        kept = lambda i, v: sum(n * chance[k] for k, n in patterns.items() if i is None or k[i] == v)  # noqa: B023, E731
        gone = lambda i, v: sum(n * (1 - chance[k]) for k, n in patterns.items() if i is None or k[i] == v)  # noqa: B023, E731
        new = [rate(kept(None, 0), gone(None, 0), q.PRIOR_KEPT, q.RANGE_PRIOR)], [rate(kept(i, 1), kept(i, 0), q.START_GOOD, q.RANGE_GOOD) for i in range(size)], [rate(gone(i, 0), gone(i, 1), q.START_BAD, q.RANGE_BAD) for i in range(size)]
        moved = max(abs(x - y) for x, y in zip([*new[0], *new[1], *new[2]], [prior, *good, *bad], strict=True))
        (prior,), good, bad = new
        if moved <= tolerance:
            break
    return [prior, *good, *bad]


class Counted:
    """Counted patterns in the place of a table."""

    def __init__(self, patterns):
        self.rows = [(*k, n) for k, n in patterns.items()]

    def select(self, *_):
        return self

    def collect(self):
        return self.rows


def flat(model):
    return [model["prior"], *model["good"], *model["bad"]]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(*[st.sampled_from((-1, 0, 1))] * 4), st.integers(1, 5_000_000), min_size=1, max_size=6))
def test_em_on_any_votes(patterns):
    for most in (1, 300):
        got = flat(q.fit(Counted(patterns), list("abcd"), most=most))
        assert max(abs(x - y) for x, y in zip(got, plain_em(patterns, most), strict=True)) < 1e-6


def test_em_that_does_not_settle(spark):
    """Votes for which a thousand steps aren't enough."""
    patterns = {(1, 1, 1, 0): 58_852, (1, 1, 1, 1): 2_811_157, (-1, 1, -1, 0): 223_684, (-1, 1, 0, 1): 2_692_789}
    rows = spark.createDataFrame([(*k, n) for k, n in patterns.items()], "a int, b int, c int, d int, count long")
    for most in (0, 7, 1000):
        got = flat(q.fit(rows, list("abcd"), tolerance=0.0, most=most))
        assert max(abs(x - y) for x, y in zip(got, plain_em(patterns, most, 0.0), strict=True)) < 1e-9
    started = [q.PRIOR_KEPT] + [q.START_GOOD] * 4 + [q.START_BAD] * 4
    assert max(abs(x - y) for x, y in zip(flat(q.fit(rows.limit(0), list("abcd"))), started, strict=True)) < 1e-12


def test_long_repeats_are_linear(spark):
    text = "\n".join(["the same line of words again and again"] * 20_000)
    assert judged(spark, [text])[0]["n_repeat_words"] == 160_000


def test_filter_keeps_columns_rows_and_empty_tables(spark):
    schema = "n_words string, text string, kept int, doc_id long"
    rows = [("a", GOOD, 1, 1), ("a", GOOD, 1, 1), (None, None, None, None), ("b", "", 0, 2)]
    got = q.quality_filter(spark.createDataFrame(rows, schema))
    assert got.columns == ["n_words", "text", "kept", "doc_id"] and [tuple(r) for r in got.collect()] == rows[:2]
    assert q.quality_filter(spark.createDataFrame([], schema)).count() == 0
