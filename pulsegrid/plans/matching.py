"""Queries that join in time. A click stands for a reference beat, a view for a detected
one; time is in hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import detection as D
from pulsegrid.operators import matching as M
from pulsegrid.operators import scoring as Q
from pulsegrid.operators.beat_merge import merge_beats, with_pauses
from pulsegrid.plans.registry import query, table

WINDOW = 2.0
H = "epoch_us(ts) / 3.6e9"


def hours() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9


def beats(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    code = F.when(F.col("value") > 75, "V").otherwise("N")
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias("record"), hours().alias("t"), code.alias("code")).dropDuplicates(["record", "t"])


CODE = "CASE WHEN value > 75 THEN 'V' ELSE 'N' END"
NEAREST = f"""a AS (SELECT user_id AS record, {H} AS t, any_value({CODE}) AS ref FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id AS record, {H} AS t, any_value({CODE}) AS test FROM events WHERE event_type = 'view' GROUP BY 1, 2),
j AS (SELECT a.record, ref, test, a.t AS t_ref, b.t AS t_test, row_number() OVER (PARTITION BY a.record, a.t ORDER BY abs(a.t - b.t), b.t) AS x,
             row_number() OVER (PARTITION BY a.record, b.t ORDER BY abs(a.t - b.t), a.t) AS y
      FROM a JOIN b ON a.record = b.record AND abs(a.t - b.t) <= {WINDOW})"""


@query(f"WITH {NEAREST} SELECT record, ref, test, round(t_ref, 6) AS t_ref, round(t_test, 6) AS t_test FROM j WHERE x = 1 AND y = 1")
def beat_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.nearest_beats(beats(spark, sf_dir, "click"), beats(spark, sf_dir, "view"), WINDOW)
    return pairs.withColumns({c: F.round(c, 6) for c in ("t_ref", "t_test")})


@query(f"WITH {NEAREST} SELECT ref, test, count(*) AS n FROM j WHERE x = 1 AND y = 1 GROUP BY ref, test")
def beat_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(M.nearest_beats(beats(spark, sf_dir, "click"), beats(spark, sf_dir, "view"), WINDOW))


FAR = "1e300::DOUBLE"
MERGED = f"""a AS (SELECT user_id AS record, {H} AS t, min({CODE}) AS code FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id AS record, {H} AS t, min({CODE}) AS code FROM events WHERE event_type = 'view' GROUP BY 1, 2),
la AS (SELECT record, list(t ORDER BY t) AS ta, list(code ORDER BY t) AS ca FROM a GROUP BY record),
lb AS (SELECT record, list(t ORDER BY t) AS tb, list(code ORDER BY t) AS cb FROM b GROUP BY record),
recs AS (SELECT record, coalesce(ta, []) AS ta, ca, coalesce(tb, []) AS tb, cb FROM la FULL JOIN lb USING (record)),
walk(record, i, j, ref, test, t_ref, t_test) AS (
  SELECT record, 1::BIGINT, 1::BIGINT, '', '', NULL::DOUBLE, NULL::DOUBLE FROM recs
  UNION ALL
  SELECT record, i + x::INT, j + y::INT, CASE WHEN x THEN ca ELSE 'O' END, CASE WHEN y THEN cb ELSE 'O' END, CASE WHEN x THEN a END, CASE WHEN y THEN b END
  FROM (SELECT *, near OR a <= b AS x, near OR b < a AS y FROM (
    SELECT *, CASE WHEN b < a THEN a - b <= {WINDOW} AND a - b < abs(a - b2) ELSE b - a <= {WINDOW} AND b - a < abs(b - a2) END AS near FROM (
      SELECT w.record, w.i, w.j, coalesce(ta[w.i], {FAR}) AS a, coalesce(ta[w.i + 1], {FAR}) AS a2, coalesce(tb[w.j], {FAR}) AS b, coalesce(tb[w.j + 1], {FAR}) AS b2, ca[w.i] AS ca, cb[w.j] AS cb
      FROM walk w JOIN recs r ON r.record = w.record WHERE w.i <= len(ta) OR w.j <= len(tb))))),
merged AS (SELECT record, ref, test, t_ref, t_test FROM walk WHERE ref <> '')"""


def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    def coded(kind: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("record"), hours().alias("t"))
        return rows.agg(F.min(F.when(F.col("value") > 75, "V").otherwise("N")).alias("code"))

    return merge_beats(coded("click"), coded("view"), WINDOW, chunk=8)


@query(f"WITH RECURSIVE {MERGED} SELECT record, ref, test, round(t_ref, 6) AS t_ref, round(t_test, 6) AS t_test FROM merged")
def beat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairing in time order, with missed and extra beats; chunks of 16 hours."""
    return one_to_one(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("t_ref", "t_test")})


NONE = "('O', 'X')"


@query(f"""WITH RECURSIVE {MERGED} SELECT record, round(count_if(ref NOT IN {NONE} AND test NOT IN {NONE}) / nullif(count_if(ref NOT IN {NONE}), 0), 6) AS se,
round(count_if(ref NOT IN {NONE} AND test NOT IN {NONE}) / nullif(count_if(test NOT IN {NONE}), 0), 6) AS ppv, round(count_if(ref = 'V' AND test = 'V') / nullif(count_if(ref = 'V'), 0), 6) AS v_se,
round(count_if(ref = 'V' AND test = 'V') / nullif(count_if(test = 'V'), 0), 6) AS v_ppv FROM merged GROUP BY record""")
def beat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.beat_summary(one_to_one(spark, sf_dir))
    return found.select("record", *(F.round(c, 6).alias(c) for c in ("se", "ppv", "v_se", "v_ppv")))


def pauses(kind: str) -> str:
    return f"SELECT user_id AS record, {H} AS begin_t, {H} + value / 20 AS end_t FROM events WHERE event_type = '{kind}'"


def during(t: str, name: str) -> str:
    return f"EXISTS (SELECT 1 FROM {name} p WHERE p.record = m.record AND p.begin_t <= m.{t} AND p.end_t >= m.{t})"


@query(f"""WITH RECURSIVE {MERGED}, ref_off AS ({pauses("signup")}), test_off AS ({pauses("error")}), flutter AS ({pauses("purchase")})
SELECT record, CASE WHEN t_ref IS NULL AND {during("t_test", "ref_off")} THEN 'X' ELSE ref END AS ref, CASE WHEN t_test IS NULL AND {during("t_ref", "test_off")} THEN 'X' ELSE test END AS test,
round(t_ref, 6) AS t_ref, round(t_test, 6) AS t_test FROM merged m WHERE NOT (t_ref IS NULL AND {during("t_test", "flutter")})""")
def beat_merge_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shut-down detectors (X) and the reference's flutter, during which extra
    beats do not count; some hours behind a signup, an error and a purchase."""
    rows = table(spark, sf_dir, "events")
    off = lambda kind: rows.where(F.col("event_type") == kind).select(F.col("user_id").alias("record"), hours().alias("begin"), (hours() + F.col("value") / 20).alias("end"))
    found = with_pauses(one_to_one(spark, sf_dir), 8 * WINDOW, off("signup"), off("error"), off("purchase"))
    return found.withColumns({c: F.round(c, 6) for c in ("t_ref", "t_test")})


@query(f"""WITH i AS (SELECT user_id AS record, {H} AS begin_t, {H} + value / 50 AS end_t FROM events WHERE event_type = 'error')
SELECT event_id FROM events e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM i WHERE i.record = e.user_id AND {H.replace('ts', 'e.ts')} >= begin_t AND {H.replace('ts', 'e.ts')} <= end_t)""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats within an alarm's interval."""
    rows = table(spark, sf_dir, "events").withColumn("t", hours())
    alarms = rows.where("event_type = 'error'").select(F.col("user_id").alias("record"), F.col("t").alias("begin"), (F.col("t") + F.col("value") / 50).alias("end"))
    points = rows.where("event_type = 'click'").select(F.col("user_id").alias("record"), "t", "event_id")
    return M.in_intervals(points, alarms, WINDOW).select("event_id")


@query("""WITH s AS (SELECT vec_id // 8 AS src, (vec_id % 8) * 64 + unnest(range(0, 64)) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64),
e AS (SELECT event_id, event_id % (SELECT max(vec_id) // 8 + 1 FROM embeddings) AS src, event_id * 37 % 520 AS o FROM events)
SELECT event_id, count(*) AS n, round(sum(v), 6) AS total, round(arg_min(v, t), 6) AS first, round(arg_max(v, t), 6) AS last
FROM e JOIN s ON s.src = e.src AND t >= o - 20 AND t < o + 81 GROUP BY event_id HAVING count(*) = 101""")
def event_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples around events; eight embeddings in a row stand for a source's chunks."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    chunks = rows.select(F.floor(F.col("vec_id") / 8).alias("src"), (F.col("vec_id") % 8).alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))
    sources = rows.agg((F.floor(F.max("vec_id") / 8) + 1).alias("sources"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(sources))  # one row
    events = events.select("event_id", (F.col("event_id") % F.col("sources")).alias("src"), (F.col("event_id") * 37 % 520).alias("eoffset"))
    found = M.epochs(events, chunks, 20, 81, 64)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return found.select("event_id", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"), F.round(F.col("samples")[0], 6).alias("first"), F.round(F.element_at("samples", -1), 6).alias("last"))


PULSES = f"""a AS (SELECT DISTINCT user_id AS record, round({H} - 473352, 6) AS t FROM events WHERE event_type IN ('purchase', 'click')),
b AS (SELECT record, round(1.0001 * t + 3, 6) AS t FROM a WHERE round(t * 100) % 5 <> 0),
ga AS (SELECT record, t AS a, lead(t) OVER (PARTITION BY record ORDER BY t) - t AS gap FROM a),
gb AS (SELECT record, t AS b, lead(t) OVER (PARTITION BY record ORDER BY t) - t AS gap FROM b),
j AS (SELECT ga.record, a, b, count(*) OVER (PARTITION BY ga.record, a) AS n, count(*) OVER (PARTITION BY ga.record, b) AS m
      FROM ga JOIN gb ON ga.record = gb.record AND abs(ga.gap - gb.gap) <= 0.05)"""


@query(f"WITH {PULSES} SELECT record, round(regr_slope(b, a), 4) AS slope, count(*) AS n FROM j WHERE n = 1 AND m = 1 GROUP BY record")
def clock_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clocks of a record, of which one missed some pulses."""
    return clocks(spark, sf_dir).select("record", F.round("slope", 4).alias("slope"), "n")


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    a = events.select(F.col("user_id").alias("record"), F.round(hours() - 473352, 6).alias("t")).distinct()
    b = a.where(F.round(F.col("t") * 100) % 5 != 0).select("record", F.round(1.0001 * F.col("t") + 3, 6).alias("t"))
    return M.aligned(a, b, 0.05)


@query(f"""WITH {PULSES}, line AS (SELECT record, regr_slope(b, a) AS slope, regr_intercept(b, a) AS intercept FROM j WHERE n = 1 AND m = 1 GROUP BY record),
w AS (SELECT event_id, user_id AS record, {H} - 473352 AS t FROM events WHERE event_type = 'view')
SELECT event_id, round((slope * t + intercept) * 10, 3) AS eoffset FROM w JOIN line USING (record) WHERE (slope * t + intercept) * 10 >= 0 AND (slope * t + intercept) * 10 < 5000""")
def events_on_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one clock placed on the other, in samples of a tenth of an hour."""
    lines = clocks(spark, sf_dir)
    views = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.col("user_id").alias("record"), (hours() - 473352).alias("t"))
    found = M.on_source(views, lines, 10.0, lines.select("record", F.lit(5000).alias("n")))
    return found.select("event_id", F.round("eoffset", 3).alias("eoffset"))


CODES = "NNNVASFQL/EO"
CODED = f"""a AS (SELECT user_id AS record, {H} AS t, min(['{"','".join(CODES)}'][event_id % {len(CODES)} + 1]) AS code FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id AS record, {H} AS t, min(['{"','".join(CODES)}'][(event_id * 7 + 3) % {len(CODES)} + 1]) AS code FROM events WHERE event_type = 'view' GROUP BY 1, 2),
j AS (SELECT a.record, a.code AS ref, b.code AS test, a.t AS t_ref, b.t AS t_test, row_number() OVER (PARTITION BY a.record, a.t ORDER BY abs(a.t - b.t), b.t) AS x,
             row_number() OVER (PARTITION BY a.record, b.t ORDER BY abs(a.t - b.t), a.t) AS y FROM a JOIN b ON a.record = b.record AND abs(a.t - b.t) <= {WINDOW}),
paired AS (SELECT record, ref, test, t_ref, t_test FROM j WHERE x = 1 AND y = 1),
every AS (SELECT * FROM paired UNION ALL SELECT record, code, 'O', t, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM paired p WHERE p.record = a.record AND p.t_ref = a.t)
  UNION ALL SELECT record, 'O', code, NULL, t FROM b WHERE NOT EXISTS (SELECT 1 FROM paired p WHERE p.record = b.record AND p.t_test = b.t)),
m AS (SELECT record, t_ref, t_test, {{0}} AS ref, {{1}} AS test FROM every)"""
MAPPED = "CASE {0} WHEN 'N' THEN 'N' WHEN 'L' THEN 'N' WHEN 'A' THEN 'S' WHEN 'S' THEN 'S' WHEN 'V' THEN 'V' WHEN 'E' THEN 'V' WHEN 'F' THEN 'F' WHEN 'Q' THEN 'Q' WHEN '/' THEN 'Q' ELSE 'O' END"
CODED = CODED.format(MAPPED.format("ref"), MAPPED.format("test"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks against views as beats of all classes, with the missed and the extra ones."""

    def coded(kind: str, number: Column) -> DataFrame:
        code = F.element_at(F.array(*map(F.lit, CODES)), (number % len(CODES) + 1).cast("int"))
        rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
        return rows.groupBy(F.col("user_id").alias("record"), hours().alias("t")).agg(F.min(code).alias("code"))

    ref, test = coded("click", F.col("event_id")), coded("view", F.col("event_id") * 7 + 3)
    every = Q.with_missed(M.nearest_beats(ref, test, WINDOW), ref, test)
    return every.withColumns({c: Q.beat_class(F.col(c)) for c in ("ref", "test")})


@query(f"""WITH {CODED} SELECT record, ref, test, count(*) AS n FROM m GROUP BY ALL""")
def aami_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of each class of the reference by class of the detector."""
    return scored_pairs(spark, sf_dir).groupBy("record", "ref", "test").agg(F.count("*").alias("n"))


@query(f"""WITH {CODED} SELECT {", ".join(f"count_if(ref = '{a}' AND test = '{b}')::BIGINT AS {a}{b.lower()}" for a in "NSVFQOX" for b in "NSVFQOX" if a + b != "OO")} FROM m""")
def aami_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.matrix(scored_pairs(spark, sf_dir))


B = "('N', 'S', 'V', 'F', 'Q')"


@query(f"""WITH {CODED}, r AS (SELECT record, (t_ref - lag(t_ref) OVER w) - (t_test - lag(t_test) OVER w) AS off FROM m WHERE t_ref IS NOT NULL AND t_test IS NOT NULL WINDOW w AS (PARTITION BY record ORDER BY t_ref)),
e AS (SELECT record, sqrt(avg(off * off)) AS rms FROM r GROUP BY record),
c AS (SELECT record, count_if(ref IN {B} AND test IN {B}) AS qtp, count_if(ref IN {B} AND test IN ('O', 'X')) AS qfn, count_if(ref IN ('O', 'X') AND test IN {B}) AS qfp,
 count_if(ref = 'V' AND test = 'V') AS vtp, count_if(ref = 'V' AND test <> 'V') AS vfn, count_if(test = 'V' AND ref IN ('N', 'S', 'O', 'X')) AS vfp, count_if(ref <> 'V' AND test IN ('N', 'S', 'F', 'Q')) AS vtn,
 count_if(ref = 'S' AND test = 'S') AS stp, count_if(ref = 'S' AND test <> 'S') AS sfn, count_if(ref IN ('N', 'V', 'F', 'O', 'X') AND test = 'S') AS sfp FROM m GROUP BY record)
SELECT c.record, round(100 * qtp / nullif(qtp + qfn, 0), 4) AS q_se, round(100 * qtp / nullif(qtp + qfp, 0), 4) AS q_ppv, round(100 * vtp / nullif(vtp + vfn, 0), 4) AS v_se,
 round(100 * vtp / nullif(vtp + vfp, 0), 4) AS v_ppv, round(100 * vfp / nullif(vtn + vfp, 0), 4) AS v_fpr, round(100 * stp / nullif(stp + sfn, 0), 4) AS s_se,
 round(100 * stp / nullif(stp + sfp, 0), 4) AS s_ppv, round(rms, 6) AS rms_rr FROM c LEFT JOIN e USING (record)""")
def aami_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard's percentages of each record, and the error of its beat intervals."""
    pairs = scored_pairs(spark, sf_dir)
    found = Q.summary(pairs, "record").join(Q.rr_error(pairs, "record"), "record", "left")
    names = ("q_se", "q_ppv", "v_se", "v_ppv", "v_fpr", "s_se", "s_ppv")
    return found.select("record", *(F.round(n, 4).alias(n) for n in names), F.round("rms_rr", 6).alias("rms_rr"))


SAMPLES = "s AS (SELECT user_id AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, floor(value * 100)::BIGINT AS value, event_type = 'purchase' AS beat FROM events)"


def whole_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    place = (F.row_number().over(w) - 1).cast("long").alias("t")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), place, F.floor(F.col("value") * 100).alias("value"), (F.col("event_type") == "purchase").alias("beat"))


@query(f"""WITH {SAMPLES}, a AS (SELECT *, sum(value) OVER (PARTITION BY record ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5 FROM s),
l AS (SELECT *, trunc(sum(s5) OVER (PARTITION BY record ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE / 25)::BIGINT AS low FROM a),
h AS (SELECT *, coalesce(lag(low, 12) OVER w, 0) - trunc(sum(low) OVER (PARTITION BY record ORDER BY t ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)::DOUBLE / 25)::BIGINT AS high FROM l WINDOW w AS (PARTITION BY record ORDER BY t)),
d AS (SELECT *, abs(high - coalesce(lag(high, 2) OVER (PARTITION BY record ORDER BY t), 0)) AS d FROM h)
SELECT record, t, low, high, least(32000, trunc(sum(d) OVER (PARTITION BY record ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)::DOUBLE / 16)::BIGINT) AS energy FROM d""")
def qrs_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's filter chain over every record."""
    return D.qrs_energy(whole_samples(spark, sf_dir).drop("beat")).select("record", "t", "low", "high", "energy")


@query(f"""WITH {SAMPLES}, b AS (SELECT record, t, t - 1 AS stop, greatest(lag(t) OVER (PARTITION BY record ORDER BY t) + 1, t - 1 - 12) AS start FROM s WHERE beat),
g AS (SELECT * FROM b WHERE start < stop AND (SELECT count(*) FROM s WHERE s.record = b.record AND s.beat AND s.t < b.t) > 0)
SELECT g.record, g.t, round(10 * (max(value) - min(value)) / count(*)::DOUBLE, 6) AS noise FROM g JOIN s ON s.record = g.record AND s.t >= g.start AND s.t < g.stop GROUP BY g.record, g.t""")
def beat_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrest between a beat and the one before."""
    rows = whole_samples(spark, sf_dir)
    found = D.noise(rows.drop("beat"), rows.where("beat").select("record", "t"), 1, 1, 12)
    return found.select("record", "t", F.round("noise", 6).alias("noise"))


@query("""WITH x AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
b AS (SELECT vec_id, i, list_sum([((embedding[i + k + 1] > embedding[i + k])::INT) << k for k in range(0, 4)])::BIGINT AS word FROM x, (SELECT unnest(range(1, 61)) AS i)),
c AS (SELECT vec_id, w.word, count(b.word) AS n FROM (SELECT vec_id, unnest(range(0, 16))::BIGINT AS word FROM x) w LEFT JOIN b USING (vec_id, word) GROUP BY ALL),
r AS (SELECT *, n / 60.0::DOUBLE AS p, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, word) AS rank FROM c),
f AS (SELECT a.vec_id, abs(a.rank - b.rank) AS far, (CASE WHEN a.p > 0 THEN -a.p * ln(a.p) ELSE 0 END) + (CASE WHEN b.p > 0 THEN -b.p * ln(b.p) ELSE 0 END) AS weight
      FROM r a JOIN r b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 AND b.word = a.word)
SELECT vec_id, round(sum(far * weight) / nullif(sum(weight), 0) / 15, 6) AS far FROM f GROUP BY vec_id""")
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two series by the ranks of their four-step words of rises and falls."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")
    pairs = rows.where("vec_id % 2 = 0").join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(A.word_distance(F.col("embedding"), F.col("other"), 4), 6).alias("far"))
