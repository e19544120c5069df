"""Beats after detection: rhythm states, merging of two detectors, templates, types. A user of
`events` is a record; which events are beats, and when, follows from their type and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import beat_types as B
from pulsegrid.operators import rhythm_states as R
from pulsegrid.operators import scan
from pulsegrid.plans.registry import query, table
from pulsegrid.streaming import runs, templates

#: An interval this long and longer is slow; events lie 100 apart.
BRADY, APART = 300, 100


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, t, code) of the beats, in hundredths of an event."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), "ts", "event_id", "event_type")
    placed = scan.placed(rows, "record", "ts", "event_id")
    return placed.where(F.col("event_type").isin("view", "click", "purchase")).select(
        "record", (F.col("i") * APART).alias("t"), F.when(F.col("event_type") == "purchase", "V").otherwise("N").alias("code")
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, i, rr): a beat's interval is the distance to the one before, joined by place."""
    there = scan.written(scan.placed(beats(spark, sf_dir), "record", "t"), "beats")
    before = there.select("record", (F.col("i") + 1).alias("i"), F.col("t").alias("earlier"))
    return there.join(before, ["record", "i"]).select("record", (F.col("i") - 1).alias("i"), (F.col("t") - F.col("earlier")).alias("rr"))


BEATS = f"""
beats AS (
  SELECT record, t, code FROM (
    SELECT user_id AS record, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * {APART} AS t,
           CASE event_type WHEN 'purchase' THEN 'V' ELSE 'N' END AS code, event_type FROM events)
  WHERE event_type IN ('view', 'click', 'purchase'))"""


def alike(a: str, b: str) -> str:
    return f"(abs({a} - {b}) < (({a} + {b}) >> 3))"


def all_of(*tests: str) -> str:
    return "(" + " AND ".join(tests) + ")"


def early(now: int) -> tuple[str, str]:
    """The mean of the normal intervals before interval `now`, and whether it is early by them."""
    places = range(now + 1, now + 7)
    means = "list_sum(([x FOR x IN [" + ", ".join(f"CASE WHEN ty[{k}] = 'NN' THEN w{k} END" for k in places) + "] IF x IS NOT NULL])[1:4])::BIGINT >> 2"
    count = " + ".join(f"(ty[{k}] = 'NN')::INT" for k in places)
    even = " AND ".join(f"(ty[{k}] <> 'NN' OR abs(m{now} - w{k}) <= (m{now} >> 4))" for k in places)
    return means, f"coalesce({count} >= 4 AND {even} AND w{now} < m{now} - (m{now} >> 3), false)"


MEAN0, EARLY0 = early(0)
MEAN1, EARLY1 = early(1)
REGULAR = all_of(*(alike(f"w{k}", f"w{k + 1}") for k in range(3)))
PAIRS = all_of(*(alike(f"w{k}", f"w{k + 2}") for k in range(6)), *(f"NOT {alike(f'w{k}', f'w{k + 1}')}" for k in range(6)))
SHORT = "(w0 < w1 - (w1 >> 2))"
THIRD = all_of(SHORT, alike("w1", "w2"), alike("2 * w2", "(w3 + w4)"), alike("w4", "w0"), alike("w5", "w2"))
SAME = alike("w0", "w1")
#: Type, class and what the type before becomes (empty: as it is), for every step.
STEP = f"""
CASE WHEN i < 3 THEN 'QQ,Q,'
WHEN ty[1] = 'QQ' THEN CASE WHEN {REGULAR} THEN 'NN,N,' WHEN {PAIRS} AND w0 < w1 THEN 'NV,V,VN' WHEN {PAIRS} THEN 'VN,N,NV' WHEN {THIRD} THEN 'NV,V,NN' ELSE 'QQ,Q,' END
WHEN ty[1] = 'NN' THEN CASE WHEN e0 AND w1 < {BRADY} THEN 'NV,V,' WHEN e0 THEN 'QQ,Q,' WHEN {SAME} THEN 'NN,N,' WHEN {SHORT} AND {alike("w0", "w2")} AND ty[2] = 'NN' THEN 'NN,N,'
  WHEN {SHORT} AND w1 < {BRADY} THEN 'NV,V,' WHEN {SHORT} THEN 'QQ,Q,' ELSE 'QQ,N,' END
WHEN ty[1] = 'NV' THEN CASE WHEN e1 AND {SAME} THEN 'NN,N,NN' WHEN NOT e1 AND {SAME} THEN 'VV,V,' WHEN w0 > w1 THEN 'VN,N,' ELSE 'QQ,Q,' END
WHEN ty[1] = 'VN' THEN CASE WHEN n0 <> 0 AND {alike("w0", "n0")} THEN 'NN,N,' WHEN v0 <> 0 AND abs(n1 - w0) < abs(v0 - w0) AND {alike("n1", "w0")} THEN 'NN,N,'
  WHEN v0 <> 0 AND abs(n1 - w0) > abs(v0 - w0) AND {alike("v0", "w0")} THEN 'NV,V,' ELSE 'QQ,Q,' END
ELSE CASE WHEN {SAME} THEN 'VV,V,' WHEN {SHORT} THEN 'QQ,Q,' ELSE 'VN,N,' END END"""
LATEST = lambda kind: "coalesce(" + ", ".join(f"CASE WHEN ty[{k}] = '{kind}' THEN w{k} END" for k in range(2, 8)) + ", 0)"
STATES = f"""{BEATS},
rr AS (SELECT record, row_number() OVER w - 2 AS i, t - lag(t) OVER w AS rr FROM beats WINDOW w AS (PARTITION BY record ORDER BY t)),
lists AS (SELECT record, list(rr ORDER BY i) AS rrs FROM rr WHERE i >= 0 GROUP BY record),
steps(record, i, ty, said, flag) AS (
  SELECT record, -1::BIGINT, ['', '', '', '', '', '', ''], '', false FROM lists
  UNION ALL
  SELECT record, i, [split_part(said, ',', 1), CASE split_part(said, ',', 3) WHEN '' THEN ty[1] ELSE split_part(said, ',', 3) END] || ty[2:6], said,
         i >= 3 AND ty[1] = 'QQ' AND split_part(said, ',', 3) IN ('VN', 'NV') AND said <> 'NV,V,NN'
  FROM (SELECT *, {STEP} AS said FROM (SELECT *, {EARLY0} AS e0, {EARLY1} AS e1, CASE WHEN n0 = 0 AND v0 <> 0 THEN (w1 + v0) >> 1 ELSE n0 END AS n1
        FROM (SELECT *, {MEAN0} AS m0, {MEAN1} AS m1, {LATEST("NN")} AS n0, {LATEST("NV")} AS v0
        FROM (SELECT s.record, s.i + 1 AS i, s.ty, {", ".join(f"CASE WHEN s.i + 2 > {k} THEN l.rrs[s.i + 2 - {k}] ELSE 0 END AS w{k}" for k in range(8))}
              FROM steps s JOIN lists l USING (record) WHERE s.i + 1 < len(l.rrs))))))"""


@query(f"WITH RECURSIVE {STATES} SELECT record, i, split_part(said, ',', 1) AS kind, split_part(said, ',', 2) AS class, flag AS bigeminy FROM steps WHERE i >= 0")
def rhythm_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and class of every beat interval, records cut into chunks of 16."""
    return R.rhythm_states(intervals(spark, sf_dir), BRADY, size=16).select("record", "i", "kind", "class", "bigeminy")


def shapes(rows: DataFrame) -> DataFrame:
    """Embeddings as the samples of beats, dealt over four records, one a second."""
    record, points = (F.col("vec_id") % 4).alias("record"), F.col("embedding").cast("array<double>").alias("points")
    return rows.select(record, F.col("vec_id").alias("t"), F.timestamp_seconds(1_704_067_200 + F.col("vec_id")).alias("ts"), points)


@query()
def beat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of every beat among those that its record has had so far."""
    return templates.match(shapes(table(spark, sf_dir, "embeddings")))


@query()
def beat_templates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream; the last ten seconds are not closed yet."""
    stream = shapes(runs.read(spark, sf_dir, "embeddings")).withWatermark("ts", "10 seconds")
    return runs.settled(templates.match_stream(stream), "shapes")


#: Beats with the features that typing asks for, made from the events' own values.
FEATURES = f"""
f0 AS (SELECT user_id AS record, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * {APART} AS t, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events),
f1 AS (SELECT *, row_number() OVER w - 1 AS i, t - lag(t) OVER w AS rr FROM f0 WHERE event_type IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY record ORDER BY t)),
f AS (SELECT record, i, coalesce(rr, 0) AS rr, CASE WHEN k % 33 = 0 THEN NULL WHEN event_type = 'purchase' THEN 1 WHEN k % 10 = 0 THEN 2 ELSE 0 END AS shape,
  CASE WHEN rr < lag(rr) OVER w THEN 'V' WHEN rr = lag(rr) OVER w THEN 'N' ELSE 'Q' END AS class, 5 + k % 12 AS width, value / 25 AS likeness, k AS muscle, k % 30 AS motion, k * 7 % 150 AS base
  FROM f1 WINDOW w AS (PARTITION BY record ORDER BY i))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), "ts", "event_id", "event_type", "value", k.alias("k"))
    rows = scan.placed(rows, "record", "ts", "event_id", name="t").withColumn("t", F.col("t") * APART).where(F.col("event_type").isin("view", "click", "purchase"))
    there = scan.written(scan.placed(rows, "record", "t"), "features")
    # The beats before by windows over chunks: one sort in a task, where joins by place take five.
    before = W.partitionBy("record", "chunk").orderBy("i")
    both = scan.with_halo(there, 2, 0, B.SIZE).withColumns({"t1": F.lag("t", 1).over(before), "t2": F.lag("t", 2).over(before)}).where("own")
    rr, before, k = F.col("t") - F.col("t1"), F.col("t1") - F.col("t2"), F.col("k")
    shape = F.when(k % 33 == 0, None).when(F.col("event_type") == "purchase", 1).when(k % 10 == 0, 2).otherwise(0)
    return both.select(
        "record", "i", F.coalesce(rr, F.lit(0)).alias("rr"), shape.alias("shape"), F.when(rr < before, "V").when(rr == before, "N").otherwise("Q").alias("class"),
        (5 + k % 12).alias("width"), (F.col("value") / 25).alias("likeness"), k.alias("muscle"), (k % 30).alias("motion"), (k * 7 % 150).alias("base"),
    )


def commonest(values: str) -> str:
    return f"(list_sort([[-len([x FOR x IN {values} IF x = v]), v] FOR v IN list_distinct({values})])[1][2])"


DOMINANT = f"""{FEATURES},
d0 AS (SELECT *, CASE WHEN class = 'N' AND width < {B.NORMAL_WIDTH} AND shape = lag(shape) OVER (PARTITION BY record ORDER BY i) THEN shape END AS normal FROM f),
d1 AS (SELECT *, list(shape) FILTER (shape IS NOT NULL) OVER w AS shapes_, list(normal) FILTER (normal IS NOT NULL) OVER w AS normals_, count(*) FILTER (class = 'Q' AND shape IS NOT NULL) OVER w AS odd_
  FROM d0 WINDOW w AS (PARTITION BY record ORDER BY i ROWS BETWEEN {B.MONITORED - 1} PRECEDING AND CURRENT ROW)),
d2 AS (SELECT *, {commonest("normals_")} AS best_, {commonest("shapes_")} AS most_ FROM d1),
d AS (SELECT * EXCLUDE (normal, shapes_, normals_, odd_, best_, most_), odd_ <= {B.IRREGULAR} AS steady,
  CASE WHEN best_ IS NULL OR len([x FOR x IN shapes_ IF x = most_]) >= 2 * len([x FOR x IN shapes_ IF x = best_]) OR len([x FOR x IN shapes_ IF x = best_]) >= 2 * len([x FOR x IN normals_ IF x = best_]) THEN most_ ELSE best_ END AS dominant FROM d2)"""


@query(f"WITH {DOMINANT} SELECT record, i, coalesce(dominant, -1) AS dominant, steady FROM d")
def dominant_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant shape of the last 180 beats (-1: none yet), and whether their rhythm is steady."""
    found = B.with_dominant(features(spark, sf_dir), 256)
    return found.select("record", "i", F.coalesce("dominant", F.lit(-1)).alias("dominant"), "steady")


def less(c: str, by: int) -> str:
    return f"({c} - ({c} >> {by}))"


AFTER = f"""{DOMINANT},
p0 AS (SELECT *, coalesce(shape, -1) AS s FROM d),
p1 AS (SELECT *, coalesce({", ".join(f"CASE WHEN lag(s, {k}) OVER w = lag(s, {k + 1}) OVER w THEN lag(rr, {k}) OVER w END" for k in range(1, 6))}, 0) AS usual,
  lag(s) OVER w AS s_before, lead(s) OVER w AS s_next, lead(rr) OVER w AS pause, lead(dominant) OVER w AS dom FROM p0 WINDOW w AS (PARTITION BY record ORDER BY i)),
p2 AS (SELECT record, i, shape, CASE WHEN s_next = dom AND s_before = dom AND (s <> dom AND {less("usual", 3)} >= rr AND {less("pause", 3)} >= usual OR i > 2 AND likeness > 2.5) THEN 2
    WHEN s_next = dom AND s_before = dom AND s <> dom AND {less("usual", 4)} > rr AND usual + (usual >> 4) < pause THEN 1 ELSE 0 END AS symbol,
  CASE WHEN {less("usual", 3)} > rr AND {less("pause", 3)} > usual THEN 'V' WHEN i > 2 THEN class ELSE 'Q' END AS post_rhythm,
  row_number() OVER (PARTITION BY record, shape ORDER BY i) AS place FROM p1 WHERE shape IS NOT NULL AND i >= 2 AND s_next IS NOT NULL),
h(record, shape, place, state) AS (
  SELECT DISTINCT record, shape, 0::BIGINT, 0::BIGINT FROM p2
  UNION ALL
  SELECT p2.record, p2.shape, p2.place, ((h.state << 1) & 255) | CASE p2.symbol WHEN 2 THEN 1 WHEN 1 THEN (h.state & 3 = 3 OR bit_count(h.state) >= 6)::BIGINT ELSE 0 END
  FROM h JOIN p2 ON p2.record = h.record AND p2.shape = h.shape AND p2.place = h.place + 1),
post AS (SELECT p2.record, i, p2.shape, CASE WHEN state & 1 = 1 THEN 'V' ELSE 'Q' END AS post_class, post_rhythm, CASE WHEN bit_count(state & 15) >= 3 OR bit_count(state) >= 6 THEN 'V' ELSE 'Q' END AS shape_class
  FROM p2 JOIN h USING (record, shape, place))"""


@query(f"WITH RECURSIVE {AFTER} SELECT * FROM post")
def post_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second thoughts on every beat once the next has come."""
    return B.second_thoughts(B.with_dominant(features(spark, sf_dir), 256), 64)


RULES_SQL = f"""CASE WHEN dominant IS NULL THEN '1Q' WHEN dominant_even AND class = 'V' AND likeness > 1.0 AND steady THEN '2V' WHEN width < 9 THEN '3N' WHEN shape IS NULL AND class <> 'V' THEN '5N'
WHEN shapes = 8 AND seen = 1 AND class = 'Q' THEN '6N' WHEN likeness < 1.2 AND class = 'N' THEN '7N' WHEN likeness < 1.5 AND post_rhythm = 'N' THEN '8N' WHEN likeness < 2.0 AND class <> 'V' AND dominant_uneven THEN '9N'
WHEN likeness > 2.5 AND seen >= 3 AND post_rhythm = 'V' AND steady THEN '10V'
WHEN width >= 11 AND (width - dominant_width >= 4 AND dominant_width < 14 OR width - dominant_width >= 6) AND muscle < 45 AND motion < 14 AND base < 100 AND shape IS NOT NULL AND seen > 1 THEN '11V'
WHEN class = 'V' AND steady THEN '12V' WHEN class = 'N' AND steady THEN '14N' WHEN width > dominant_width AND likeness > 3.5 AND width >= 10 THEN '15V' WHEN width < 10 THEN '16N'
WHEN width - dominant_width < 2 THEN '17N' WHEN likeness < 1.5 THEN '18N' WHEN muscle > 75 THEN '19N' ELSE '20V' END"""


@query(f"""WITH RECURSIVE {AFTER},
r0 AS (SELECT d.*, CASE WHEN d.shape IS NOT NULL THEN row_number() OVER (PARTITION BY d.record, d.shape ORDER BY d.i) END AS seen, 3 + d.i % 6 AS shapes, 6 + dominant * 2 AS dominant_width, d.i % 3 = 0 AS dominant_even,
  d.i % 4 = 1 AS dominant_uneven, p.post_rhythm, p.shape_class FROM d LEFT JOIN post p ON p.record = d.record AND p.i = d.i),
r AS (SELECT *, {RULES_SQL} AS said FROM r0)
SELECT record, i, regexp_extract(said, '[0-9]+')::INT AS rule, CASE WHEN shape_class = 'V' THEN 'V' ELSE regexp_extract(said, '[A-Z]') END AS class FROM r""")
def beat_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every beat: that of its shape if most of the shape's last beats were
    premature, else by the table of rules."""
    beats_ = scan.written(B.with_dominant(features(spark, sf_dir), 256), "dominant")
    after = B.second_thoughts(beats_, 64).select("record", "i", "post_rhythm", "shape_class")
    shaped = scan.placed(beats_.where("shape is not null").withColumn("series", F.to_json(F.struct("record", "shape"))).select("series", "record", "i"), "series", "i", name="seen")
    rows = beats_.join(after, ["record", "i"], "left").join(shaped.select("record", "i", (F.col("seen") + 1).alias("seen")), ["record", "i"], "left")
    rows = rows.withColumns({"shapes": 3 + F.col("i") % 6, "dominant_width": 6 + F.col("dominant") * 2, "dominant_even": F.col("i") % 3 == 0, "dominant_uneven": F.col("i") % 4 == 1})
    return B.by_rules(rows).select("record", "i", "rule", F.when(F.col("shape_class") == "V", "V").otherwise(F.col("rule_class")).alias("class"))


@query("""WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, floor(unnest(embedding)::DOUBLE * 1000)::BIGINT AS v FROM embeddings WHERE len(embedding) = 64),
r AS (SELECT vec_id, i, abs(v - 2 * lag(v) OVER w + lag(v, 2) OVER w) AS d FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
s AS (SELECT vec_id, i, sum(d) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM r WHERE i >= 4 AND i < 60),
m AS (SELECT vec_id, max(s) AS m FROM s WHERE i < 27 OR i > 43 GROUP BY vec_id),
h AS (SELECT vec_id, greatest(max(v), 0) - least(min(v), 0) AS h FROM x WHERE i >= 25 AND i < 40 GROUP BY vec_id)
SELECT vec_id, CASE WHEN h >= 4 THEN floor(m * 10 / (h >> 2))::BIGINT ELSE 0 END AS noise FROM m JOIN h USING (vec_id)""")
def muscle_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-frequency noise of embeddings taken as beats of 64 samples."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000))
    return rows.select("vec_id", A.muscle_noise(x, 32).cast("long").alias("noise"))


@query("""WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY vec_id),
s AS (SELECT x.vec_id, i, v > m + d AS high, abs(v) > 2 * d AS far FROM x JOIN m USING (vec_id))
SELECT vec_id, count_if(NOT far)::BIGINT AS kept, count_if(high AND far)::BIGINT AS both_, coalesce(min(i) FILTER (high AND NOT far), -1) AS first FROM s GROUP BY vec_id""")
def sample_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that are left once the far ones are taken away, and those both high and far."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), F.posexplode(x).alias("i", "v"))
    stats = rows.groupBy("vec_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"), F.first("x").alias("x"))
    places = lambda test: F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: test(F.get(F.col("x"), i)))
    sets = stats.select("vec_id", places(lambda v: F.lit(True)).alias("all"), places(lambda v: v > F.col("m") + F.col("d")).alias("high"), places(lambda v: F.abs(v) > 2 * F.col("d")).alias("far"))
    size = lambda a: F.size(a).cast("long")
    first = F.coalesce(F.array_min(F.array_except("high", "far")), F.lit(-1)).cast("long")
    return sets.select("vec_id", size(F.array_except("all", "far")).alias("kept"), size(F.array_intersect("high", "far")).alias("both_"), first.alias("first"))
