"""Corrections for many tests, permutations, clusters and correlations."""

from __future__ import annotations

import math
from math import pi as PI

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adjusted(df: DataFrame, p: str, *by: str, dependent: bool = False) -> DataFrame:
    """Append p_fdr: p values adjusted for the false discovery rate within each family; with
    dependent, for tests of any dependence."""
    family, order = W.partitionBy(*by), W.partitionBy(*by).orderBy(p)
    ranked = df.withColumn("_m", F.count("*").over(family)).withColumn("_r", F.row_number().over(order))
    # The sum of 1/k up to the family's size, as a window's sum over its ranks.
    factor = F.sum(1 / F.col("_r")).over(family) if dependent else F.lit(1.0)
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") * factor / F.col("_r"))
    later = W.partitionBy(*by).orderBy("_r").rowsBetween(0, W.unboundedFollowing)
    return ranked.withColumn("p_fdr", F.least(F.lit(1.0), F.min("_q").over(later))).drop("_m", "_r", "_q")


def holm(df: DataFrame, p: str, *by: str) -> DataFrame:
    """Append p_holm: step-down adjusted p values, never falling."""
    family, order = W.partitionBy(*by), W.partitionBy(*by).orderBy(p)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_q", F.col(p) * (F.count("*").over(family) - F.col("_r") + 1))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max("_q").over(W.partitionBy(*by).orderBy("_r")))).drop("_r", "_q")


def null_p(values: DataFrame, null: DataFrame, value: str, cells: Column, cell: str = "cell") -> DataFrame:
    """Append p: share of the null distribution at or above each value.

    The null's values are counted by distinct value first and the counts summed from above;
    each value then looks up the sum at the next null value (an as-of join by a window over
    both, dealt out by cells of the value with the cells' own sums added)."""
    null = null.select(F.col(value), cells.alias(cell)).groupBy(cell, value).agg(F.count("*").alias("_n"))
    asked_cells = values.select(cells.alias(cell), F.lit(0).cast("long").alias("_n"))
    sums = null.select(cell, "_n").union(asked_cells).groupBy(cell).agg(F.sum("_n").alias("_n"))
    above = W.orderBy(F.desc(cell)).rowsBetween(W.unboundedPreceding, -1)
    # One row per cell: cells are a bounded histogram of the value's range.
    sums = sums.select(cell, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    asked = values.withColumn(cell, cells).withColumn("_ask", F.lit(1))
    both = asked.unionByName(null.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(cell).orderBy(F.desc(value)).rangeBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_here", F.sum("_n").over(w)).where("_ask = 1")
    found = both.join(sums, cell, "left")
    return found.withColumn("p", (F.coalesce("_here", F.lit(0)) + F.coalesce("_above", F.lit(0))) / F.col("_total")).drop("_here", "_above", "_total", "_n", "_ask", cell)


def runs(df: DataFrame, order: str, over: Column, *by: str) -> DataFrame:
    """(by, cluster, first, last, n, mass): runs of consecutive places where `over` holds;
    df has column v, the value."""
    w = W.partitionBy(*by).orderBy(order)
    kept = df.withColumn("_on", over)
    kept = kept.withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    kept = kept.withColumn("cluster", F.sum("_new").over(w)).where("_on")
    return kept.groupBy(*by, "cluster").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.sum("v").alias("mass"))


def enhanced(df: DataFrame, order: str, steps: list[float], *by: str, e: float = 2 / 3, h: float = 2.0) -> DataFrame:
    """(by, order, tfce): for each place the sum over thresholds of extent^e height^h of the
    run that holds it, times the step. Values below zero form runs of their own, whose sums
    are negative."""
    width = steps[1] - steps[0] if len(steps) > 1 else steps[0]
    at = df.withColumn("_t", F.explode(F.array(*map(F.lit, [*steps, *(-s for s in steps)]))))
    w = W.partitionBy(*by, "_t").orderBy(order)
    on = at.withColumn("_on", F.when(F.col("_t") > 0, F.col("v") >= F.col("_t")).otherwise(F.col("v") <= F.col("_t")))
    on = on.withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    on = on.withColumn("_run", F.sum("_new").over(w)).where("_on")
    extent = F.count("*").over(W.partitionBy(*by, "_t", "_run"))
    score = F.pow(extent, F.lit(e)) * F.pow(F.abs("_t"), F.lit(h)) * width * F.signum("_t")
    return on.withColumn("_s", score).groupBy(*by, order).agg(F.sum("_s").alias("tfce"))


#: Rows, of all shuffles, that a task sorts at once, and rows of a group whose shuffles are dealt
#: out one by one.
TASK_ROWS, GROUP_ROWS = 2_000_000, 100_000


def permuted(df: DataFrame, key: Column, times: int, *by: str) -> DataFrame:
    """Each row in every one of `times` shuffles: perm, and place, its rank in the group by a
    hashed key of the shuffle and the row. Rows are dealt by their group and only then
    copied, within tasks of TASK_ROWS, so no copy moves or is spilled; of groups over GROUP_ROWS the
    copies are dealt out."""

    def copied(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        return at.withColumn("place", F.row_number().over(W.partitionBy("perm", *by).orderBy(key)))

    if not by:
        return copied(df)
    sizes = df.groupBy(*by).count()
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) * times / TASK_ROWS))
    if (most or 0) <= GROUP_ROWS:
        return copied(df.repartition(parts, *by))
    large = sizes.where(F.col("count") > GROUP_ROWS).select(*by)
    small = df.join(large, [*by], "left_anti").select(*df.columns)
    return copied(small.repartition(parts, *by)).unionByName(copied(df.join(large, [*by], "left_semi").select(*df.columns)))


def unpaired_t(df: DataFrame, group: Column, value: str, *by: str) -> DataFrame:
    """(by, t, n): t of two groups (group true and false) of equal variance."""
    g = df.withColumn("_g", group)
    side = lambda f, on: f(F.when(F.col("_g") == on, F.col(value)))
    s = g.groupBy(*by).agg(*(side(f, on).alias(f"{n}{int(on)}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for on in (True, False)))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return s.select(*by, ((F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))).alias("t"), (F.col("n1") + F.col("n0")).alias("n"))


def average_rank(value: str, *by: str) -> Column:
    """Rank, equal values sharing the mean of their ranks."""
    w = W.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


#: Panels of a half turn that the density of t is summed over.
PANELS = 2000


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of t with df degrees of freedom (1 or more). With t = tan(u) sqrt(df) the
    density is cos(u)^(df - 1), whose integrals are taken by Simpson's rule; the whole one
    scales the part, so no gamma function is needed."""
    end = F.atan(F.abs(t) / F.sqrt(df))

    def integral(low: Column, high: Column) -> Column:
        step = (high - low) / PANELS
        at = lambda k: F.pow(F.cos(low + k * step), df - 1)
        total = F.aggregate(F.sequence(F.lit(1), F.lit(PANELS - 1)), F.lit(0.0), lambda acc, k: acc + at(k) * F.when(k % 2 == 1, 4.0).otherwise(2.0))
        return (total + at(F.lit(0)) + at(F.lit(PANELS))) * step / 3

    # Most of the density lies near zero: the part and the rest are integrated apart.
    # Past forty deviations there is nothing left of it.
    most = F.least(F.lit(PI / 2), 40 / F.sqrt(df))
    part, rest = integral(F.lit(0.0), F.least(end, most)), integral(F.least(end, most), most)
    return F.when(t == 0, 1.0).otherwise(rest / (part + rest))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution, by Acklam's rational approximation (coefficients
    are fixed values); relative error below 1.2e-9."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(x: Column, terms: tuple[float, ...]) -> Column:
        out = F.lit(terms[0])
        for term in terms[1:]:
            out = out * x + term
        return out

    middle, tail = p - 0.5, lambda q: F.sqrt(-2 * F.ln(q))
    low, high = poly(tail(p), c) / poly(tail(p), d), -poly(tail(1 - p), c) / poly(tail(1 - p), d)
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(middle * poly(middle * middle, a) / poly(middle * middle, b))


def t_to_z(t: Column, df: Column) -> Column:
    """z of the same one-sided probability, with the sign of t."""
    return F.signum(t) * -normal_quantile(student_p(t, df) / 2)


def permutation_p(df: DataFrame, group: Column, place: Column, value: str, key: Column, times: int, *by: str) -> DataFrame:
    """(by, t, p): t of two groups, and the share of shuffles (with the true order itself)
    whose t is at least as far from zero. `group` marks the true groups, `place` the groups by
    a row's place in a shuffle."""
    true = unpaired_t(df, group, value, *by).select(*by, "t")
    shuffled = unpaired_t(permuted(df, key, times, *by), place, value, *by, "perm").select(*by, F.col("t").alias("_t"))
    far = F.count_if(F.abs("_t") >= F.abs("t")) + 1
    return true.join(shuffled, [*by]).groupBy(*by, "t").agg((far / (F.count("*") + 1)).alias("p"))


def correlation(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, r, p, n): Pearson correlation and its two-sided p."""
    c = df.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
    free = F.col("n") - 2
    t = F.col("r") * F.sqrt(free / F.greatest(F.lit(1e-300), 1 - F.col("r") * F.col("r")))
    return c.withColumn("p", F.when(free >= 1, student_p(t, free)))


def bootstrap_ratio(df: DataFrame, value: str, key: Column, times: int, *by: str) -> DataFrame:
    """(by, mean, ratio): mean of a feature over its deviation between `times` resamples.
    A row's weight in a resample is a Poisson count of mean one, drawn by a hashed number in
    [0, 1) that `key` gives for column boot, so no row moves."""
    at = df.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_u", key)
    steps = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    weight = sum(((F.col("_u") >= s).cast("int") for s in steps[1:]), (F.col("_u") >= steps[0]).cast("int"))
    each = at.withColumn("_w", weight).groupBy(*by, "boot").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("_m"))
    spread = each.groupBy(*by).agg(F.stddev_samp("_m").alias("_d"))
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return means.join(spread, [*by]).select(*by, "mean", (F.col("mean") / F.col("_d")).alias("ratio"))
