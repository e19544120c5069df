"""Signal queries: an embedding stands for a segment of 64 samples at 16 a second, the
events of a user for a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.segments import with_spectrum
from pulsegrid.plans.registry import query, table

N, FS = 64, 16
BANDS = [0.5, 1.0, 2.0, 4.0, 6.0, 8.0]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.where(F.size("x") == N)


def feature(spark: SparkSession, sf_dir: str, **values: Column) -> DataFrame:
    return segments(spark, sf_dir).select("vec_id", *(F.round(v, 6).alias(k) for k, v in values.items()))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later ones read without computing it anew."""
    return df.withColumn(name, F.explode(F.array(value)))


S = f"""s AS (SELECT vec_id, unnest(range(0, {N})) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = {N})"""
SPECTRUM = f"""{S},
spec AS (SELECT vec_id, k, sqrt(sum(v * cos(2 * pi() * k * t / {N})) ** 2 + sum(v * sin(2 * pi() * k * t / {N})) ** 2) AS a
         FROM s, (SELECT unnest(range(0, {N // 2})) AS k) GROUP BY vec_id, k)"""


@query(f"""WITH {S}, g AS (SELECT vec_id, t, floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 39)::INT AS c FROM s WINDOW w AS (PARTITION BY vec_id))
SELECT a.vec_id, round(count(DISTINCT a.c * 40 + b.c) / 1600, 6) AS psr FROM g a JOIN g b ON a.vec_id = b.vec_id AND b.t = a.t + {FS // 2} GROUP BY a.vec_id""")
def psr_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature(spark, sf_dir, psr=A.phase_space(F.col("x"), FS // 2))


@query(f"""WITH {S}, m AS (SELECT vec_id, max(v) AS m, arg_max(t, v) AS tm FROM s GROUP BY vec_id),
d AS (SELECT s.vec_id, t, CASE WHEN v > m * exp(-abs(t - tm) / {3.0 * FS}) THEN 1 WHEN t = 0 THEN 0 WHEN v < m * exp(-abs(t - tm) / {3.0 * FS}) THEN 0 END AS up
      FROM s JOIN m USING (vec_id) WHERE t < {N - 1}),
f AS (SELECT vec_id, t, last_value(up IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY t) AS up FROM d),
c AS (SELECT vec_id, up <> lag(up) OVER (PARTITION BY vec_id ORDER BY t) AS crossed FROM f)
SELECT vec_id, round(count_if(crossed) / {N / FS}, 6) AS ste FROM c GROUP BY vec_id""")
def ste_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature(spark, sf_dir, ste=A.exponential_crossings(F.col("x"), FS))


@query(f"""WITH {S}, w AS (SELECT vec_id, b, avg(abs(v)) / max(abs(v)) AS m FROM s, (SELECT unnest(range(0, {N - 2 * FS + 1}, {FS})) AS b) WHERE t >= b AND t < b + {2 * FS} GROUP BY vec_id, b)
SELECT vec_id, round(avg(m), 6) AS mav FROM w GROUP BY vec_id""")
def sliding_mav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature(spark, sf_dir, mav=A.mean_absolute_value(F.col("x"), FS))


@query(f"""WITH {S}, d AS (SELECT vec_id, t, v, v - coalesce(lag(v) OVER w, 0) AS d FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
e AS (SELECT *, d - lag(d) OVER (PARTITION BY vec_id ORDER BY t) AS e FROM d),
m AS (SELECT vec_id, sum(d * d) / {N} AS m2, sum(v * v) AS tp, sum(e * e) / {N} AS m4 FROM e GROUP BY vec_id)
SELECT vec_id, round(sqrt(m2 / tp), 6) AS mobility, round(sqrt(m4 * tp / m2 / m2), 6) AS complexity FROM m""")
def hjorth(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = once(segments(spark, sf_dir), "h", A.hjorth(F.col("x")))
    return both.select("vec_id", F.round("h.mobility", 6).alias("mobility"), F.round("h.complexity", 6).alias("complexity"))


@query(f"""WITH {S}, d AS (SELECT vec_id, t, v - lag(v) OVER (PARTITION BY vec_id ORDER BY t) AS d FROM s),
c AS (SELECT vec_id, d * lag(d) OVER (PARTITION BY vec_id ORDER BY t) < 0 AS turned FROM d)
SELECT vec_id, round(log10({N}) / (log10({N}) + log10(1 + 0.4 * count_if(turned))), 6) AS pfd FROM c GROUP BY vec_id""")
def petrosian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature(spark, sf_dir, pfd=A.petrosian(F.col("x")))


@query(f"WITH {SPECTRUM} SELECT vec_id, k, round(a * a, 6) AS power FROM spec")
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spectrum(segments(spark, sf_dir), "x", "s").select("vec_id", F.posexplode("s").alias("k", "a"))
    return rows.select("vec_id", "k", F.round(F.col("a") * F.col("a"), 6).alias("power"))


@query(f"""WITH {SPECTRUM}, p AS (SELECT vec_id, arg_max(k, a) AS pk, max(a) AS pa FROM spec WHERE k > 2 GROUP BY vec_id),
kept AS (SELECT vec_id, pk, k, CASE WHEN a >= 0.05 * pa AND k < least(20 * pk, 400) THEN a ELSE 0 END AS a FROM spec JOIN p USING (vec_id)),
f AS (SELECT vec_id, round(sum(k * a * a) / sum(a * a) * {FS / N}, 6) AS fm FROM spec GROUP BY vec_id),
m AS (SELECT vec_id, round(sum(k * a) / sum(a) / any_value(pk), 6) AS moment,
             round(sum(CASE WHEN k > 0.7 * pk AND k < 1.4 * pk THEN a ELSE 0 END) / sum(a), 6) AS a2 FROM kept GROUP BY vec_id)
SELECT vec_id, moment, a2, fm FROM m JOIN f USING (vec_id)""")
def spectral_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spectrum(segments(spark, sf_dir), "x", "a")
    rows = once(rows, "s", A.spectral_shape(F.col("a"), N, FS))
    return rows.select("vec_id", F.round("s.moment", 6).alias("moment"), F.round("s.a2", 6).alias("a2"), F.round(A.central_frequency(F.col("a"), N, FS), 6).alias("fm"))


CUTS = [int(b / FS * N) for b in BANDS]


@query(f"""WITH {SPECTRUM}, b AS (SELECT vec_id, band, sum(a) AS p FROM spec JOIN (SELECT unnest({list(range(len(CUTS) - 1))}) AS band, unnest({CUTS[:-1]}) AS lo, unnest({CUTS[1:]}) AS hi) ON k >= lo AND k < hi GROUP BY vec_id, band),
r AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS r FROM b)
SELECT vec_id, round(sum(p), 6) AS power, round(max(CASE WHEN band = 0 THEN r END), 6) AS first_ratio,
       round(-sum(CASE WHEN band < {len(CUTS) - 2} THEN r * ln(r) END) / ln({len(CUTS) - 1}), 6) AS entropy FROM r GROUP BY vec_id""")
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of bands, the first one's share, and spectral entropy."""
    rows = once(with_spectrum(segments(spark, sf_dir), "x", "a"), "p", A.band_powers(F.col("a"), BANDS, N, FS))
    p = F.col("p")
    return rows.select("vec_id", F.round(A.total(p), 6).alias("power"), F.round(p[0] / A.total(p), 6).alias("first_ratio"), F.round(A.spectral_entropy(p, len(BANDS) - 1), 6).alias("entropy"))


@query(f"""WITH {SPECTRUM}, p AS (SELECT vec_id, CASE WHEN arg_max(k, a) > 0 THEN floor({N} / arg_max(k, a) / 2) ELSE {N // 2} END AS h FROM spec GROUP BY vec_id)
SELECT a.vec_id, round(sum(abs(a.v + b.v)) / sum(abs(a.v) + abs(b.v)), 6) AS leak
FROM s a JOIN p USING (vec_id) JOIN s b ON b.vec_id = a.vec_id AND b.t = a.t + p.h GROUP BY a.vec_id""")
def vf_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spectrum(segments(spark, sf_dir), "x", "a")
    return rows.select("vec_id", F.round(A.half_period_leak(F.col("x"), F.col("a"), N), 6).alias("leak"))


@query(f"""WITH {S}, e AS (SELECT vec_id, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
p AS (SELECT vec_id, ((a > b)::INT + (a > c)::INT) * 10 + (b >= a)::INT + (b > c)::INT AS pat, count(*) AS n FROM e WHERE c IS NOT NULL GROUP BY ALL)
SELECT vec_id, round(-sum(n / {N - 2.0} * log2(n / {N - 2.0})), 6) AS entropy FROM p GROUP BY vec_id""")
def perm_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature(spark, sf_dir, entropy=A.permutation_entropy(F.col("x")))


@query(f"""WITH {S} SELECT vec_id, t, round(coalesce(sum(v) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5, 6) AS ma FROM s""")
def moving_average5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("vec_id", F.posexplode(A.moving_average(F.col("x"))).alias("t", "v"))
    return rows.select("vec_id", "t", F.round("v", 6).alias("ma"))


EVENTS = "e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events)"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("t"), "value")


@query(f"WITH {EVENTS} SELECT event_id, round(value - avg(CASE WHEN t <= 7 THEN value END) OVER (PARTITION BY user_id), 6) AS value FROM e")
def baseline_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series less its mean over the first eight samples."""
    base = F.avg(F.when(F.col("t") <= 7, F.col("value"))).over(W.partitionBy("user_id"))
    return recordings(spark, sf_dir).select("event_id", F.round(F.col("value") - base, 6).alias("value"))


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, t // 8 AS sec, value, max(value) OVER w AS top, avg(value) OVER w AS mid FROM e WINDOW w AS (PARTITION BY user_id, t // 8)),
d AS (SELECT *, avg(abs(value - mid)) OVER (PARTITION BY user_id, sec) AS dev FROM m)
SELECT user_id, sec, count_if(value >= 0.5 * top)::BIGINT AS count1, count_if(value >= mid)::BIGINT AS count2, count_if(value >= mid - dev AND value <= mid + dev)::BIGINT AS count3
FROM d GROUP BY user_id, sec""")
def per_second_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a second over half the second's largest, over its mean, and near its mean."""
    # Sums in the order of samples: what lies right at a bound depends on the last bit of the mean.
    w = W.partitionBy("user_id", "sec").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = recordings(spark, sf_dir).select("user_id", F.floor(F.col("t") / 8).alias("sec"), "t", "value")
    rows = rows.select("*", F.max("value").over(w).alias("top"), F.avg("value").over(w).alias("mid"))
    rows = rows.withColumn("dev", F.avg(F.abs(F.col("value") - F.col("mid"))).over(w))
    v = F.col("value")
    return rows.groupBy("user_id", "sec").agg(
        F.count_if(v >= 0.5 * F.col("top")).alias("count1"), F.count_if(v >= F.col("mid")).alias("count2"),
        F.count_if(v.between(F.col("mid") - F.col("dev"), F.col("mid") + F.col("dev"))).alias("count3"),
    )


@query(f"""WITH {EVENTS} SELECT event_id, round(sum(value) OVER w, 6) AS running, round(exp(sum(ln(1 + abs(value) / 1000)) OVER w), 6) AS product
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)""")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum, and running product of 1 + |value| / 1000."""
    w = W.partitionBy("user_id").orderBy("t")
    return recordings(spark, sf_dir).select("event_id", F.round(F.sum("value").over(w), 6).alias("running"), F.round(F.exp(F.sum(F.ln(1 + F.abs("value") / 1000)).over(w)), 6).alias("product"))


@query(f"""WITH {EVENTS} SELECT event_id, round(value - lag(value) OVER w, 6) AS slope, round(sum(value * value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 4) AS energy
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)""")
def window_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivative, and the sum of squares of the trailing sixteen samples."""
    w = W.partitionBy("user_id").orderBy("t")
    energy = F.sum(F.col("value") * F.col("value")).over(w.rowsBetween(-15, 0))
    return recordings(spark, sf_dir).select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("slope"), F.round(energy, 4).alias("energy"))


@query(f"""WITH {S}, k AS (SELECT unnest(range(0, 100)) AS k), p AS (SELECT k, k * {(N - 1) / 99} AS place, least(floor(k * {(N - 1) / 99}), {N - 2})::INT AS i FROM k)
SELECT a.vec_id, k, round(a.v + (b.v - a.v) * (place - i), 6) AS v FROM p JOIN s a ON a.t = i JOIN s b ON b.vec_id = a.vec_id AND b.t = i + 1""")
def rate_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples from 64, by straight lines."""
    rows = segments(spark, sf_dir).select("vec_id", F.posexplode(A.converted(F.col("x"), N, 100)).alias("k", "v"))
    return rows.select("vec_id", "k", F.round("v", 6).alias("v"))


@query(f"""WITH {S}, m AS (SELECT a.vec_id, a.t - n.t AS i, max(a.v - n.v) AS far FROM s a JOIN s n ON n.vec_id = a.vec_id - a.vec_id % 10 AND n.t < 4 AND a.t >= n.t AND a.t - n.t < {N - 4} GROUP BY ALL)
SELECT vec_id, min(i) AS place FROM m WHERE far < 0.05 GROUP BY vec_id""")
def subsequence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each series first matches the beginning of the first one of its ten."""
    rows = segments(spark, sf_dir)
    needles = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("first"), F.slice("x", 1, 4).alias("needle"))
    both = rows.join(needles, rows["vec_id"] - rows["vec_id"] % 10 == needles["first"])
    return both.select("vec_id", A.first_match(F.col("x"), F.col("needle"), 0.05).alias("place")).where("place is not null")


@query(f"""WITH {S}, a1 AS (SELECT a.vec_id, a.t, (a.v + b.v) * sqrt(0.5) AS a, (a.v - b.v) * sqrt(0.5) AS d FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.t = (a.t + 1) % {N}),
a2 AS (SELECT a.vec_id, a.t, (a.a + b.a) * sqrt(0.5) AS a, (a.a - b.a) * sqrt(0.5) AS d FROM a1 a JOIN a1 b ON a.vec_id = b.vec_id AND b.t = (a.t + 2) % {N})
SELECT a1.vec_id, round(sum(a1.d ** 2), 6) AS detail1, round(sum(a2.d ** 2), 6) AS detail2, round(sum(a2.a ** 2), 6) AS rest FROM a1 JOIN a2 USING (vec_id, t) GROUP BY a1.vec_id""")
def stationary_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of two levels of the undecimated Haar transform."""
    x = F.col
    rows = once(segments(spark, sf_dir), "a1", A.stationary_level(x("x"), N, 0, A.LOW))
    rows = once(rows, "a2", A.stationary_level(x("a1"), N, 1, A.LOW))
    energy = {"detail1": A.stationary_level(x("x"), N, 0, A.HIGH), "detail2": A.stationary_level(x("a1"), N, 1, A.HIGH), "rest": x("a2")}
    return rows.select("vec_id", *(F.round(A.squares(v), 6).alias(k) for k, v in energy.items()))
