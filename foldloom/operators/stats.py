"""Inferential tables over the fold table. Sums, ranks and pairings are DataFrame aggregates and windows; p-values come from
single numbers of an aggregated row. Normality and bootstrap work on counts of distinct values, in blocks of ranks and of draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as dist
from ..functions.scalar import mean_and_spread
from ..session import kept, new_folder, tasks_for
from .rollup import CELL, METRICS, on_all_scales

#: Comparisons and graphs, in order; graphs of the scale effect; names of the two group tests.
PAIRS = (("string_ppi", "no_graph"), ("gene_ontology", "no_graph"), ("combined", "no_graph"), ("random", "no_graph"), ("string_ppi", "random"), ("combined", "random"))
GRAPHS = ("string_ppi", "gene_ontology", "coexpression", "combined", "random", "no_graph")
SCALE_GRAPHS = ("string_ppi", "combined")
ANOVA, KRUSKAL = "one-way ANOVA (graph_type)", "Kruskal-Wallis"
COHEN_EPSILON, DRAWS, ALPHA, SEED, LEAST_NORMAL, ANOMALOUS_MSE = 1e-10, 10_000, 0.05, 42, 8, 0.5
#: Ranks, distinct values and draws that one step of a task takes on.
RANKS, VALUES, DRAW_BLOCK = 10_000, 4_096, 500
#: What a comparison goes by.
COMPARED = ("dataset", "hvg", "g1", "g2")
#: A total order of folds, where they have no number of their own.
ORDER = ("seed", "condition", *METRICS)


def _number(f, *columns: Column) -> Column:
    """A scalar function of aggregated rows: one row a test."""

    @F.pandas_udf("double")
    def run(*x: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if any(v is None or math.isnan(v) for v in row) else f(*row) for row in zip(*x, strict=True)], dtype=float)

    return run(*[c.cast("double") for c in columns])


def sums_before(counts: DataFrame, value: str | tuple[str, ...], weights: dict[str, Column], *by: str) -> DataFrame:
    """``counts`` with the sums of ``weights`` over the rows of its group (``by``) before it in the order of ``value``; rows that agree in
    all of it come in any order. Rows are dealt by ranges and summed up there; what earlier ranges hold is a row a range and
    group, so no group is one task's."""
    value = (value,) if isinstance(value, str) else value
    folder = new_folder(counts.sparkSession, "ranges")
    ranged = counts.repartitionByRange(*by, *value).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)  # ranges are drawn once
    rows = counts.sparkSession.read.schema(ranged.schema).parquet(folder)
    each = rows.groupBy("_range", *by).agg(*[F.sum(w).alias(f"_{k}") for k, w in weights.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # null-safe, as a group's key may be null
    offsets = each.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in weights])
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_range", *by).orderBy(*value).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_in_{k}") for k, w in weights.items()])
    return own.join(F.broadcast(offsets), same).select(*counts.columns, *[(F.col(f"_in_{k}") + F.col(f"_{k}")).alias(k) for k in weights])


def positions(rows: DataFrame, order: tuple[str, ...], by: tuple[str, ...], meet: list[str], *carried: str) -> DataFrame:
    """(by, carried, rn): rows numbered from 0 in ``order`` within their group (``by``). Rows are dealt by ranges and written in order, without
    what only orders them; a row's number is its place in its range and what earlier ranges hold, a row a range and group. They are
    then dealt by ``meet``, in as many tasks as there are rows for."""
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = kept(ranged.select(*by, *carried, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "positions")
    each = placed.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_before")
    offsets = each.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], before)
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    numbered = placed.join(F.broadcast(offsets), same).select(*by, *carried, (F.col("_at") + F.col("_before")).alias("rn"))
    return numbered.repartition(tasks_for(placed), *meet)


def paired(folds: DataFrame, value: str = "pearson_r", by: str = "position", pairs=PAIRS) -> DataFrame:
    """(dataset, hvg, g1, g2, rn, a, b): fold by fold, by position in order (cut at the shorter side) or by ``key`` (seed and
    condition). The comparisons are a table of six rows; a fold is sent once, whatever the number of its comparisons."""
    names = F.explode(F.array(*[F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in pairs])).alias("p")
    wanted = F.broadcast(folds.sparkSession.range(1).select(names).select("p.g1", "p.g2"))
    first, second = (sorted({p[i] for p in pairs}) for i in (0, 1))
    own = folds.where(F.col("graph_type").isin(*first, *second)).withColumn("_value", F.col(value))
    if by == "position":
        on = ["dataset", "hvg", "rn"]
        numbered = positions(own, ORDER, CELL, on, "_value")
    else:
        numbered, on = own, ["dataset", "hvg", "seed", "condition"]
    left = numbered.where(F.col("graph_type").isin(first)).select(*on, F.col("graph_type").alias("g1"), F.col("_value").alias("a"))
    right = numbered.where(F.col("graph_type").isin(second)).select(*on, F.col("graph_type").alias("g2"), F.col("_value").alias("b"))
    return left.join(right.hint("merge"), on).join(wanted, ["g1", "g2"]).select(*on, "g1", "g2", "a", "b")


def counted(pairs: DataFrame) -> DataFrame:
    """(dataset, hvg, g1, g2, a, b, c): how often each pair of values comes, made once; tests read these counts instead of pairing anew. Counts
    are given back as they are."""
    return pairs if "c" in pairs.columns else kept(pairs.groupBy(*COMPARED, "a", "b").agg(F.count("*").alias("c")), "counted")


def _differences(counts: DataFrame) -> DataFrame:
    """(dataset, hvg, g1, g2, d, c): how often each difference comes."""
    return counts.groupBy(*COMPARED, (F.col("a") - F.col("b")).alias("d")).agg(F.sum("c").alias("c"))


def _spread(counts: DataFrame) -> DataFrame:
    """(dataset, hvg, g1, g2, n_pairs, n, mean, squares) of differences: pairs, those whose difference isn't null, and of these the mean and
    the sum of squared deviations, exactly 0 where they don't vary."""
    d = _differences(counts)
    n = F.sum(F.when(F.col("d").isNotNull(), F.col("c")))
    mean = F.when(F.min("d") == F.max("d"), F.min("d")).otherwise(F.try_divide(F.sum(F.col("d") * F.col("c")), n))
    sums = d.groupBy(*COMPARED).agg(F.sum("c").alias("n_pairs"), n.alias("n"), mean.alias("mean"))
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = F.broadcast(sums.withColumnsRenamed({c: f"_{c}" for c in COMPARED}))
    return d.join(known, same).groupBy(*COMPARED, "n_pairs", "n", "mean").agg(F.sum(F.col("c") * F.pow(F.col("d") - F.col("mean"), F.lit(2.0))).alias("squares"))


def cohen(d: Column) -> Column:
    """An aggregate: the mean difference in units of its population deviation."""
    return F.avg(d) / (F.stddev_pop(d) + COHEN_EPSILON)


def paired_t(d: Column) -> Column:
    """An aggregate: null where differences don't vary."""
    return F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d)))


def shapiro(folds: DataFrame, value: str = "pearson_r") -> DataFrame:
    """dataset, hvg, graph_type, W, p, normal, n of groups of LEAST_NORMAL or more. Each distinct value takes the normal scores of
    its ranks, in blocks of RANKS. W and p of a group with a null or NaN are NaN. Above 5,000 values see
    :func:`~foldloom.functions.distributions.shapiro_from_sums`."""
    by = ("dataset", "hvg", "graph_type")
    own = folds.select(*by, F.coalesce(F.col(value), F.lit(float("nan"))).alias("x"))
    groups = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("squares")).where(F.col("n") >= LEAST_NORMAL)
    steps = sums_before(own.groupBy(*by, "x").agg(F.count("*").alias("t")), "x", {"before": F.col("t")}, *by).join(F.broadcast(groups), list(by))
    blocks = steps.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1, F.lit(RANKS).cast("long"))))

    @F.pandas_udf("m double, mm double")
    def scores(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dist.normal_scores(*row) for row in zip(first, last, n, strict=True)], columns=["m", "mm"], dtype=float)

    scored = blocks.withColumn("s", scores(F.col("before") + F.col("at") + 1, F.col("before") + F.least(F.col("at") + RANKS, F.col("t")), F.col("n")))
    held = lambda rank: F.max(F.when((F.col("before") < rank) & (F.col("before") + F.col("t") >= rank), F.col("x")))
    n = F.col("n")
    sums = scored.groupBy(*by, "n", "squares").agg(F.sum("s.mm").alias("mm"), F.sum(F.col("s.m") * (F.col("x") - F.col("mean"))).alias("mx"), *[held(r).alias(c) for c, r in (("x1", F.lit(1)), ("x2", F.lit(2)), ("x3", n - 1), ("x4", n))])

    @F.pandas_udf("w double, p double")
    def test(n: pd.Series, mm: pd.Series, mx: pd.Series, x1: pd.Series, x2: pd.Series, x3: pd.Series, x4: pd.Series, squares: pd.Series) -> pd.DataFrame:
        rows = zip(n, mm, mx, x1, x2, x3, x4, squares, strict=True)
        return pd.DataFrame([(math.nan, math.nan) if any(math.isnan(v) for v in r) else dist.shapiro_from_sums(r[0], r[1], r[2], r[3:7], r[7]) for r in rows], columns=["w", "p"], dtype=float)

    found = sums.withColumn("s", test("n", "mm", "mx", "x1", "x2", "x3", "x4", "squares"))
    normal = F.when((F.col("s.p") > ALPHA) & ~F.isnan("s.p"), "Yes").otherwise("No")
    return found.select(*by, F.round("s.w", 4).alias("W"), F.round("s.p", 6).alias("p"), normal.alias("normal"), "n")


def pass_rate(normality: DataFrame) -> DataFrame:
    return normality.agg(F.count_if(F.col("normal") == "Yes").alias("n_normal"), F.count("*").alias("n_groups"))


def _scaled(folds: DataFrame) -> DataFrame:
    return folds.join(F.broadcast(on_all_scales(folds)), ["dataset", "graph_type"], "left_semi")


def anova(folds: DataFrame, value: str = "pearson_r") -> DataFrame:
    """One-way, for each dataset and hvg, over graphs present on all scales: (dataset, hvg, statistic, d1, d2, n_groups)."""
    groups = _scaled(folds).groupBy("dataset", "hvg", "graph_type").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    sums = groups.groupBy("dataset", "hvg").agg(between.alias("ssb"), within.alias("ssw"), F.count("*").alias("n_groups"), F.sum("n").alias("n"))
    d1, d2 = F.col("n_groups") - 1, F.col("n") - F.col("n_groups")
    return sums.where("n_groups > 1").select("dataset", "hvg", F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2).alias("statistic"), d1.alias("d1"), d2.alias("d2"), "n_groups")


def kruskal(folds: DataFrame, value: str = "pearson_r") -> DataFrame:
    """(dataset, hvg, statistic, d1, n_groups): H with its correction for ties. Ranks come from counts of distinct values, dealt
    by ranges, so neither a value nor a group is one task's."""
    own = _scaled(folds)
    values = sums_before(own.groupBy("dataset", "hvg", value).agg(F.count("*").alias("t")), value, {"before": F.col("t")}, "dataset", "hvg")
    ranks = values.withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    ties = ranks.groupBy("dataset", "hvg").agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    counts = own.groupBy("dataset", "hvg", "graph_type", value).agg(F.count("*").alias("c"))
    sums = counts.join(ranks, ["dataset", "hvg", value]).groupBy("dataset", "hvg", "graph_type").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("k"))
    each = sums.groupBy("dataset", "hvg").agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.count("*").alias("n_groups"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return each.join(ties, ["dataset", "hvg"]).where("n_groups > 1").select("dataset", "hvg", F.try_divide(h, 1 - F.col("ties") / (n * n * n - n)).alias("statistic"), (F.col("n_groups") - 1).alias("d1"), "n_groups")


def group_tests(folds: DataFrame, value: str = "pearson_r") -> DataFrame:
    """dataset, hvg, test, F, p, significant, n_groups: both tests; the second's statistic also stands under F. ``significant`` goes by
    p before it is rounded."""
    a = anova(folds, value)
    a = a.select("dataset", "hvg", F.lit(ANOVA).alias("test"), "statistic", _number(dist.f_sf, F.col("statistic"), F.col("d1"), F.col("d2")).alias("p"), "n_groups")
    k = kruskal(folds, value)
    k = k.select("dataset", "hvg", F.lit(KRUSKAL).alias("test"), "statistic", _number(dist.chi2_sf, F.col("statistic"), F.col("d1")).alias("p"), "n_groups")
    significant = F.when((F.col("p") < ALPHA) & ~F.isnan("p"), "Yes").otherwise("No")
    return a.union(k).select("dataset", "hvg", "test", F.round("statistic", 4).alias("F"), F.round("p", 6).alias("p"), significant.alias("significant"), "n_groups")


def bootstrap_interval(diffs: np.ndarray, draws: int = DRAWS, alpha: float = ALPHA, seed: int = SEED, block: int = 500) -> tuple[float, float]:
    """Percentiles of Cohen's d over resamples; the generator starts anew at every call. Drawn in blocks, which leaves the
    draws as they are and bounds memory."""
    r, n, out = np.random.RandomState(seed), len(diffs), []
    for at in range(0, draws, block):
        s = diffs[r.choice(n, (min(block, draws - at), n), replace=True)]
        out.append(s.mean(axis=1) / (s.std(axis=1) + COHEN_EPSILON))
    d = np.concatenate(out)
    return float(np.percentile(d, 100 * alpha / 2)), float(np.percentile(d, 100 * (1 - alpha / 2)))


def _paths(parts: DataFrame, *by: str) -> DataFrame:
    """(by, part, path): from (by, part, c), what a part's way down a binary tree over the parts of its group passes: (level, left, all), the
    sums of c below the left child and below the node, from the top. A path is as long as the tree is deep."""
    most = parts.agg(F.max("part")).first()[0] or 0
    depth = most.bit_length()
    sums = parts.select(*by, F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "part", "c").select(*by, "level", F.expr("shiftright(part, level)").alias("node"), "c").groupBy(*by, "level", "node").agg(F.sum("c").alias("sum"))
    if not depth:
        return parts.select(*by, "part", F.expr("cast(array() as array<struct<level: int, left: bigint, all: bigint>>)").alias("path"), F.col("c").alias("n"))
    steps = parts.select(*by, "part", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")).withColumns({"node": F.expr("shiftright(part, level)"), "child": F.expr("shiftright(part, level) * 2"), "below": F.col("level") - 1})
    all_ = steps.join(sums.withColumnRenamed("sum", "all"), [*by, "level", "node"])
    both = all_.join(sums.select(*by, F.col("level").alias("below"), F.col("node").alias("child"), F.col("sum").alias("left")), [*by, "below", "child"])
    step = F.struct((-F.col("level")).alias("level"), "left", "all")
    found = both.groupBy(*by, "part").agg(F.array_sort(F.collect_list(step)).alias("path"))
    return found.withColumn("n", F.get("path", F.lit(0))["all"])


def bootstrap_sums(pairs: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(dataset, hvg, g1, g2, draw, s, q, mean, n): of each resample of the n differences the sum of their deviations from the mean, and of
    the deviations' squares.

    A resample holds multinomial counts of the distinct differences. These are dealt to parts of VALUES, and a part's count in a
    draw comes down a binary tree over the parts: at each node the count is split between its children by a binomial, from a
    generator that all parts below the node share; then the part splits its own among its values. So a task holds one part and
    the few nodes above it, and its cost grows with distinct values rather than rows. The generators start anew at every call; draws
    are those of the method, not bit for bit those of :func:`bootstrap_interval`.
    """
    by = COMPARED
    own = _differences(counted(pairs)).select(*by, F.coalesce("d", F.lit(float("nan"))).alias("d"), "c")
    base = own.groupBy(*by).agg((F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    values = sums_before(own.groupBy(*by, "d").agg(F.sum("c").alias("c")), "d", {"place": F.lit(1)}, *by).withColumn("part", F.floor(F.col("place") / VALUES).cast("int"))
    paths = _paths(values.groupBy(*by, "part").agg(F.sum("c").alias("c")), *by)
    centred = values.join(F.broadcast(base), list(by)).select(*by, "part", "place", (F.col("d") - F.col("mean")).alias("d"), "c")
    parts = centred.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("place", "d", "c"))).alias("v"))
    cells = parts.join(paths, [*by, "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAW_BLOCK))))
    cells = cells.select(*by, "part", "block", "n", F.transform("path", lambda x: -x["level"]).alias("level"), F.col("path.left").alias("left"), F.col("path.all").alias("all"), F.col("v.d").alias("d"), F.col("v.c").alias("c"), F.xxhash64(*by).alias("key"))
    # by number: a cell is a small row and a long draw, so few bytes don't make few tasks
    cells = cells.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "part", "block")

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                size, start, part = min(DRAW_BLOCK, draws - r.block * DRAW_BLOCK), [seed, int(r.key) % 2**63, int(r.block)], int(r.part)
                n = np.full(size, int(r.n))
                for level, left, all_ in zip(r.level, r.left, r.all, strict=True):
                    went = np.random.default_rng([*start, int(level), part >> int(level)]).binomial(n, left / all_)
                    n = n - went if part >> (int(level) - 1) & 1 else went
                c, x = np.asarray(r.c, dtype=float), np.asarray(r.d, dtype=float)
                mine = np.random.default_rng([*start, 0, part]).multinomial(n, c / c.sum())
                yield pd.DataFrame({"dataset": r.dataset, "hvg": r.hvg, "g1": r.g1, "g2": r.g2, "draw": r.block * DRAW_BLOCK + np.arange(size), "s": mine @ x, "q": mine @ (x * x)})

    drawn = cells.mapInPandas(run, ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by) + ", draw long, s double, q double")
    return drawn.groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).join(F.broadcast(base), list(by))


def bootstrap(pairs: DataFrame, draws: int = DRAWS, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(dataset, hvg, g1, g2, d_ci_low, d_ci_high): percentiles of Cohen's d over resamples; NaN where a difference is null or NaN."""
    mean = F.col("s") / F.col("n")
    cohens = (F.col("mean") + mean) / (F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) + COHEN_EPSILON)
    cut = lambda at: F.when(F.isnan(F.first("mean")), float("nan")).otherwise(F.percentile(cohens, F.lit(at)))
    return bootstrap_sums(pairs, draws, seed).groupBy("dataset", "hvg", "g1", "g2").agg(cut(alpha / 2).alias("d_ci_low"), cut(1 - alpha / 2).alias("d_ci_high"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(dataset, hvg, g1, g2, w, n_nonzero, ties, zeros) of signed ranks of the differences that aren't zero."""
    by, d = COMPARED, _differences(counted(pairs))
    many = lambda which: F.sum(F.when(which, F.col("c")).otherwise(0))
    steps = d.where("d <> 0").groupBy(*by, F.abs("d").alias("m")).agg(many(F.col("d") > 0).alias("up"), F.sum("c").alias("t"))
    ranked = sums_before(steps, "m", {"before": F.col("t")}, *by).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum("t").alias("n_nonzero"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    zeros = d.groupBy(*by).agg(many(F.col("d") == 0).alias("zeros"))
    n = F.coalesce("n_nonzero", F.lit(0))
    plus = F.coalesce("plus", F.lit(0.0))
    return zeros.join(sums, list(by), "left").select(*by, F.least(plus, n * (n + 1) / 2 - plus).alias("w"), n.alias("n_nonzero"), F.coalesce("ties", F.lit(0.0)).alias("ties"), "zeros")


def bonferroni(rows: DataFrame, p: str = "p") -> DataFrame:
    """p_bonf: times the number of rows, at most 1. The count is one small aggregate, sent to every row."""
    m = F.broadcast(rows.agg(F.count("*").alias("_m")))
    return rows.crossJoin(m).withColumn("p_bonf", F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def false_discovery(rows: DataFrame, p: str = "p", step_up: bool = False) -> DataFrame:
    """p_fdr: p * m / average rank, at most 1; with ``step_up`` made monotone. Ranks come from the distinct p-values,
    dealt by ranges."""
    steps = sums_before(rows.groupBy(p).agg(F.count("*").alias("_t")), p, {"_up": F.col("_t")})
    up = F.col("_up") + F.col("_t")
    m = F.broadcast(rows.agg(F.count("*").alias("_m")))
    ranked = steps.crossJoin(m).withColumn("p_fdr", F.least(F.col(p) * F.col("_m") / (up if step_up else up - F.col("_t") + (F.col("_t") + 1) / 2), F.lit(1.0)))
    if step_up:
        ranked = ranked.withColumn("p_fdr", F.min("p_fdr").over(Window.orderBy(F.desc(p))))
    return rows.join(ranked.select(p, "p_fdr"), p, "left")


def pairwise(folds: DataFrame, value: str = "pearson_r", by: str = "position") -> DataFrame:
    """The table of comparisons, :func:`compared`, of folds."""
    return compared(paired(folds, value, by))


def compared(pairs: DataFrame) -> DataFrame:
    """Of pairs or their counts: dataset, hvg, comparison, mean_diff, cohens_d and its interval ci_lo, ci_hi, t_stat, t_p, wilcoxon_p,
    n_pairs, and t_p times the number of rows (t_p_bonf) and by its rank (t_p_fdr), both from t_p as rounded. Tests of differences
    that don't vary are null or NaN, as are their corrections. Folds are paired once, and tests, a row a comparison, made once before they
    are ranked."""
    counts, keys = counted(pairs), list(COMPARED)
    n, mean, squares = F.col("n"), F.col("mean"), F.col("squares")
    d = mean / (F.sqrt(F.try_divide(squares, n)) + COHEN_EPSILON)
    t = F.try_divide(mean, F.sqrt(F.try_divide(squares, n - 1)) / F.sqrt(n))
    base = _spread(counts).select(*keys, mean.alias("mean_diff"), "n_pairs", d.alias("cohens_d"), t.alias("t"))
    both = kept(base.join(wilcoxon(counts), keys).join(bootstrap(counts), keys), "compared")
    out = both.select(
        "dataset", "hvg", F.concat("g1", F.lit(" vs "), "g2").alias("comparison"), F.round("mean_diff", 6).alias("mean_diff"), F.round("cohens_d", 4).alias("cohens_d"), F.round("d_ci_low", 4).alias("ci_lo"), F.round("d_ci_high", 4).alias("ci_hi"), F.round("t", 4).alias("t_stat"),
        F.round(_number(dist.t_two_sided, F.col("t"), F.col("n_pairs") - 1), 8).alias("t_p"),
        F.round(_number(lambda w, n, ties, zeros: dist.signed_rank_p(w, int(n), ties, zeros > 0), F.col("w"), F.col("n_nonzero"), F.col("ties"), F.col("zeros")), 8).alias("wilcoxon_p"), "n_pairs",
    )
    out = bonferroni(out, "t_p").withColumn("t_p_bonf", F.round("p_bonf", 8)).drop("p_bonf")
    return false_discovery(out, "t_p").select(*out.columns, F.round("p_fdr", 8).alias("t_p_fdr"))


def mentioning(table: DataFrame, text: str) -> DataFrame:
    return table.where(F.col("comparison").contains(text))


def scale_effect(folds: DataFrame, value: str = "pearson_r", graphs=SCALE_GRAPHS, against: str = "no_graph") -> DataFrame:
    """dataset, graph, hvg, delta_pearson and cohens_d of the paired folds: both sides are cut to the shorter one; both need rows."""
    return scale_effect_of(counted(paired(folds, value, pairs=[(g, against) for g in graphs])))


def scale_effect_of(counts: DataFrame, graphs=SCALE_GRAPHS, against: str = "no_graph") -> DataFrame:
    """:func:`scale_effect` of counted pairs, those of other comparisons left out."""
    asked = counts.where(F.col("g1").isin(list(graphs)) & (F.col("g2") == against))
    mean = lambda x: F.try_divide(F.sum(F.col(x) * F.col("c")), F.sum(F.when(F.col(x).isNotNull(), F.col("c"))))
    delta = asked.groupBy(*COMPARED).agg((mean("a") - mean("b")).alias("delta_pearson"))
    d = F.col("mean") / (F.sqrt(F.try_divide(F.col("squares"), F.col("n"))) + COHEN_EPSILON)
    each = delta.join(_spread(asked).select(*COMPARED, d.alias("cohens_d")), list(COMPARED))
    return each.select("dataset", F.col("g1").alias("graph"), "hvg", F.round("delta_pearson", 6).alias("delta_pearson"), F.round("cohens_d", 4).alias("cohens_d"))


def medians(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, median) of values that aren't null: the middle one, or the mean of the middle two. Values are counted once each and dealt
    by ranges, where the middle ranks are looked up, so no group's values meet in a task. NaN is greater than any number; a
    group without values has no row."""
    own = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_t"))
    n = own.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("_t").alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    ranked = sums_before(own, "_x", {"_before": F.col("_t")}, *by).join(n, same)
    holds = lambda rank: F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_t")), F.col("_x")))
    low, high = holds(F.floor((F.col("_n") + 1) / 2)), holds(F.floor(F.col("_n") / 2) + 1)
    return ranked.groupBy(*by).agg(((low + high) / 2).alias("median"))


def anomalies(folds: DataFrame, least: float = ANOMALOUS_MSE) -> DataFrame:
    """Groups whose mean mse is above ``least``, with its mean, median and maximum. Medians are looked up for those groups alone."""
    by = ["dataset", "hvg", "graph_type"]
    sums = folds.groupBy(*by).agg(F.avg("mse").alias("mean_mse"), F.max("mse").alias("max_mse"))
    odd = sums.where((F.col("mean_mse") > least) & ~F.isnan("mean_mse"))
    middle = medians(folds.join(odd.select(*by), by, "left_semi"), "mse", *by).withColumnRenamed("median", "median_mse")
    return odd.join(middle, by).select(*by, "mean_mse", "median_mse", "max_mse")


def paper_table(folds: DataFrame, value: str = "pearson_r", graphs=GRAPHS) -> DataFrame:
    """dataset, hvg and a column a graph: mean±std, a dash for no folds; every dataset with every scale."""
    grid = folds.select("dataset").distinct().crossJoin(F.broadcast(folds.select("hvg").distinct()))
    cells = folds.groupBy("dataset", "hvg").pivot("graph_type", list(graphs)).agg(mean_and_spread(value))
    return grid.join(cells, ["dataset", "hvg"], "left").na.fill("—", list(graphs))


def report_tables(folds: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a report by their files' names, columns and digits as reports show them. Folds are written once and paired once, and
    all tables made from these."""
    folds = kept(folds, "folds")
    pairs = counted(paired(folds))
    return {"shapiro_wilk": shapiro(folds).select("dataset", "hvg", "graph_type", "W", "p", "normal", "n"), "anova_results": group_tests(folds), "pairwise_comparisons": compared(pairs), "hvg_scale_effect": scale_effect_of(pairs), "paper_summary_table": paper_table(folds)}
