"""Features that need numpy: see functions/kernels.py. Embeddings stand for segments of 64
samples at 16 a second."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import kernels as K
from pulsegrid.functions.segments import amplitudes, each, prepared, with_features, with_spectrum
from pulsegrid.operators import labels as L
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.signal import FS, segments


@query()
def shock_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-domain and complexity features of segments prepared once."""
    rows = with_features(segments(spark, sf_dir), "x", {"amplitude": each(K.peak_amplitude, FS)}, arrays={"x": lambda x: x})
    return with_features(rows, "x", time_features(FS), prepare=lambda x: prepared(x, FS, 6.0))


def time_features(fs: int) -> dict:
    """Kernels of prepared segments; entropy of samples over their last five seconds."""
    return {
        "tcsc": each(K.threshold_crossings, fs), "mea": each(K.lifted_exponential, fs), "hilb": K.hilbert_cells,
        "lz": each(lambda r: K.lempel_ziv(K.binarised(r))), "spen": lambda x: each(K.sample_entropy)(x[:, -5 * fs :]),
    }


#: Rate and length of the job's segments; eight embeddings in a row are a segment at 64 a second.
JOB_RATE, JOB_SECONDS, CHUNKS = 250, 8, 8


def job_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, label, x): eight whole embeddings after one another, labelled as the first."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    place = F.struct((F.col("vec_id") % CHUNKS).alias("place"), F.col("embedding").cast("array<double>").alias("x"), "label")
    held = rows.groupBy(F.floor(F.col("vec_id") / CHUNKS).alias("segment")).agg(F.sort_array(F.collect_list(place)).alias("parts"))  # eight
    # Features cost far more than their few bytes say: a fixed number of tasks, not coalesced. By a
    # hash of its own, as a second dealing by the same column would be left out of the plan.
    held = held.where(F.size("parts") == CHUNKS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("segment"))
    return held.select("segment", F.col("parts")[0]["label"].alias("label"), F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"))


@query()
def feature_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature table: segments brought to 250 samples a second, prepared once, every
    feature, and the risk class of the segment's rhythm."""
    from pulsegrid.functions import modes as D

    n = JOB_RATE * JOB_SECONDS
    raw = {"amplitude": each(K.peak_amplitude, JOB_RATE), **{f"count{k}": (lambda x, k=k: K.resonance_counts(x, JOB_RATE, k)) for k in (1, 2, 3)}}
    rows = with_features(job_segments(spark, sf_dir), "x", raw, prepare=lambda x: K.resample(x, n), arrays={"x": lambda x: x})
    modes = {tuple(f"imf{k + 1}_lz" for k in range(5)): lambda x: np.array([D.mode_features(r, JOB_RATE)[:5] for r in x])}
    rows = with_features(rows, "x", {**time_features(JOB_RATE), **modes}, prepare=lambda x: prepared(x, JOB_RATE), arrays={"x": lambda x: x, "a": amplitudes})
    x, a = F.col("x"), F.col("a")
    rows = rows.withColumn("s", F.explode(F.array(A.spectral_shape(a, n, JOB_RATE))))
    columns = {
        "tci": A.crossing_interval(x, JOB_RATE), "ste": A.exponential_crossings(x, JOB_RATE), "psr": A.phase_space(x, JOB_RATE // 2),
        "mav": A.mean_absolute_value(x, JOB_RATE), "vf": A.half_period_leak(x, a, n), "m": F.col("s.moment"), "a2": F.col("s.a2"), "fm": A.central_frequency(a, n, JOB_RATE),
    }
    rhythm = F.element_at(F.array(*map(F.lit, ("(N", "(VF", "(VT", "(VFL"))), (F.col("label") % 4 + 1).cast("int"))
    kept = [c for c in rows.columns if c not in ("x", "a", "s")]
    out = rows.select(*kept, *(v.alias(k) for k, v in columns.items()), rhythm.alias("rhythm"))
    return out.withColumn("risk", L.risk_class(F.col("rhythm"), F.col("amplitude"), F.lit(0)))


@query()
def fractal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluctuation, dimension and singular-value features."""
    features = {
        "dfa": each(K.detrended_fluctuation, [4, 8, 16]), "higuchi": each(K.higuchi, 6), "hurst": each(K.hurst),
        "svd_entropy": each(lambda r: K.singular_entropy(r, 2, 6)[0]), "fisher": each(lambda r: K.singular_entropy(r, 2, 6)[1]),
    }
    return with_features(segments(spark, sf_dir), "x", features)


@query()
def wavelet_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Morlet power by label and frequency."""
    freqs = [1.0, 2.0, 4.0]
    rows = segments(spark, sf_dir)
    powers = with_features(rows, "x", {tuple(f"p{int(f)}" for f in freqs): lambda x: K.wavelet_power(x, freqs, FS)})
    return powers.agg(*(F.avg(f"p{int(f)}").alias(f"p{int(f)}") for f in freqs), F.count("*").alias("n"))


_S = """s AS (SELECT vec_id, unnest(range(0, 64)) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64)"""


@query(f"""WITH {_S}, r AS (SELECT vec_id, 0.2 * stddev_pop(v) AS r FROM s GROUP BY vec_id),
e AS (SELECT vec_id, t, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
m AS (SELECT x.vec_id, count(*) AS cm, count(*) FILTER (x.c IS NOT NULL AND y.c IS NOT NULL AND abs(x.c - y.c) <= r) AS cp
      FROM e x JOIN e y ON x.vec_id = y.vec_id AND x.t <> y.t AND x.b IS NOT NULL AND y.b IS NOT NULL JOIN r ON r.vec_id = x.vec_id
      WHERE abs(x.a - y.a) <= r AND abs(x.b - y.b) <= r GROUP BY x.vec_id)
SELECT vec_id, round(ln((coalesce(cm, 0) + 1e-100) / (coalesce(cp, 0) + 1e-100)), 6) AS entropy FROM r LEFT JOIN m USING (vec_id)""")
def sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_features(segments(spark, sf_dir), "x", {"entropy": each(K.sample_entropy)})
    return rows.select("vec_id", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {_S}, c AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * t / 64)) AS a, sum(v * sin(2 * pi() * k * t / 64)) AS b FROM s, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL)
SELECT vec_id, j, round(sum((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (a * cos(2 * pi() * k * j / 96) + CASE WHEN k = 32 THEN 0 ELSE b * sin(2 * pi() * k * j / 96) END)) / 64, 5) AS v
FROM c, (SELECT unnest(range(0, 96)) AS j) GROUP BY vec_id, j""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """96 samples made of 64 through the Fourier transform."""
    names = tuple(f"at{j}" for j in range(96))
    wide = with_features(segments(spark, sf_dir), "x", {names: lambda x: K.resample(x, 96)})
    found = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("j"), F.round(n, 5).alias("v")) for i, n in enumerate(names))))
    return wide.select("vec_id", found.alias("f")).select("vec_id", "f.j", "f.v")


@query(f"""WITH RECURSIVE {_S}, two AS (SELECT vec_id, 0 AS back, t, v FROM s UNION ALL SELECT vec_id, 1, 63 - t, v FROM s),
m AS (SELECT vec_id, back, avg(v) FILTER (t < 10) AS slow FROM two GROUP BY ALL),
r AS (SELECT vec_id, back, -1::BIGINT AS t, 0.0::DOUBLE AS fast, slow FROM m
  UNION ALL SELECT r.vec_id, r.back, r.t + 1, 0.5 * r.fast + 0.5 * (b.v - r.slow), 0.975 * r.slow + 0.025 * b.v FROM r JOIN two b ON b.vec_id = r.vec_id AND b.back = r.back AND b.t = r.t + 1),
p AS (SELECT f.vec_id, f.t, abs(f.fast * g.fast / 2) AS size FROM r f JOIN r g ON f.vec_id = g.vec_id AND f.back = 0 AND g.back = 1 AND g.t = 63 - f.t WHERE f.t >= 0),
o AS (SELECT *, (size > stddev_pop(size) OVER (PARTITION BY vec_id))::INT AS over FROM p),
n AS (SELECT vec_id, max(over) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM o)
SELECT vec_id, sum(near)::DOUBLE AS artefacts FROM n GROUP BY vec_id""")
def blink_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples near which fast averages about slow ones stand out both ways in time."""
    return with_features(segments(spark, sf_dir), "x", {"artefacts": lambda x: K.blinks(x, 3)}).select("vec_id", "artefacts")


@query()
def band_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy within a band, without it, and of the transform's levels with six taps."""
    both = {k: (lambda x, k=k: (K.zero_phase(*K.butterworth(2, (2.0, 4.0), FS, k), x) ** 2).mean(1)) for k in ("pass", "stop")}
    names = ("detail1", "detail2", "detail3", "rest")
    levels = {names: lambda x: np.stack([(p**2).mean(1) for p in K.stationary(x, 3)], axis=1)}
    period = {"period": lambda x: K.cepstrum(x, FS).argmax(1) / FS}
    return with_features(segments(spark, sf_dir), "x", {**both, **levels, **period})


@query(f"""WITH {_S}, lim AS (SELECT vec_id, t // {FS} AS k, t % {FS} AS i, v > 0.2 * max(v) OVER (PARTITION BY vec_id, t // {FS}) AS up FROM s),
e AS (SELECT *, up AND NOT coalesce(lag(up) OVER w, false) AS rise, NOT up AND coalesce(lag(up) OVER w, false) AS fall FROM lim WINDOW w AS (PARTITION BY vec_id, k ORDER BY i)),
p AS (SELECT vec_id, k, count(*) FILTER (rise) AS n, coalesce(min(i) FILTER (rise), {FS}) AS head, CASE WHEN count(*) FILTER (rise) = 0 THEN {FS} WHEN count(*) FILTER (fall) = 0 THEN 0 ELSE {FS} - max(i) FILTER (fall) END AS tail FROM e GROUP BY vec_id, k),
n AS (SELECT b.vec_id, b.n - 1 + coalesce(b.head / nullif(b.head + a.tail, 0), 0) + coalesce(b.tail / nullif(b.tail + c.head, 0), 0) AS n
      FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.k = a.k + 1 JOIN p c ON c.vec_id = b.vec_id AND c.k = b.k + 1)
SELECT vec_id, round(avg(1000.0 / CASE WHEN n > 0 THEN n ELSE 1 END), 6) AS tci FROM n GROUP BY vec_id""")
def crossing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("vec_id", F.round(A.crossing_interval(F.col("x"), FS), 6).alias("tci"))


@query()
def mode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of the first five empirical modes, and waves of the first."""
    from pulsegrid.functions import modes as D

    names = (*(f"imf{k + 1}_lz" for k in range(5)), "imf1_amplitude", "imf1_hz")
    return with_features(segments(spark, sf_dir), "x", {names: each(D.mode_features, FS)})


@query()
def chaos_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate entropy, largest Lyapunov exponent, resonator counts and band power."""
    features = {
        "apen": each(K.approximate_entropy), "lle": each(K.lyapunov, 1, 4, FS, 4), **{f"count{k}": (lambda x, k=k: K.resonance_counts(x, FS, k)) for k in (1, 2, 3)},
        "slow": lambda x: K.band_envelope(x, 0.5, 2.0, FS), "fast": lambda x: K.band_envelope(x, 2.0, 6.0, FS),
    }
    return with_features(segments(spark, sf_dir), "x", features)


@query(f"""WITH {_S}, spec AS (SELECT vec_id, k, ln(sum(v * cos(2 * pi() * k * t / 64)) ** 2 + sum(v * sin(2 * pi() * k * t / 64)) ** 2) / ln(10) AS p FROM s, (SELECT unnest(range(1, 32)) AS k) GROUP BY vec_id, k),
m AS (SELECT k, avg(p) AS m, stddev_pop(p) AS d FROM spec JOIN embeddings USING (vec_id) WHERE label = 0 GROUP BY k)
SELECT vec_id, k, round((p - m) / d, 5) AS z FROM spec JOIN m USING (k)""")
def zscored_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log power of 31 frequencies, scaled by the mean and deviation of a baseline class."""
    rows = with_spectrum(segments(spark, sf_dir), "x", "s").select("vec_id", F.posexplode("s").alias("k", "a")).where("k between 1 and 31")
    rows = rows.select("vec_id", "k", F.log10(F.col("a") * F.col("a")).alias("p"))
    base = rows.join(table(spark, sf_dir, "embeddings").where("label = 0").select("vec_id"), "vec_id")
    base = base.groupBy("k").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("d"))
    return rows.join(F.broadcast(base), "k").select("vec_id", "k", F.round((F.col("p") - F.col("m")) / F.col("d"), 5).alias("z"))  # 31 rows
