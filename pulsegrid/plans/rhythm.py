"""Rhythm queries. `events` stands for annotated recordings: a user is a record, an event a
sample, its order the sample number, its type the annotation code and `value` the signal."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import labels as L
from pulsegrid.operators import spans as S
from pulsegrid.plans.registry import query, table

SIZE = 4
RATE = 1.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, t, seq, code, sub_type, aux, value) of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.when(F.col("event_type") == "signup", "+").when(F.col("event_type") == "error", "~").when(F.col("event_type") == "purchase", "V").otherwise("N")
    rhythm = F.element_at(F.array(*map(F.lit, ("(N", "(VF", "(VT", "(NOISE"))), (k % 4 + 1).cast("int"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("event_id").alias("seq"),
        code.alias("code"), (k % 2).alias("sub_type"), rhythm.alias("aux"), "value",
    )


SAMPLES = """
samples AS (
  SELECT user_id AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id AS seq,
         CASE event_type WHEN 'signup' THEN '+' WHEN 'error' THEN '~' WHEN 'purchase' THEN 'V' ELSE 'N' END AS code,
         json_extract_string(props, '$.k')::INT % 2 AS sub_type,
         ['(N', '(VF', '(VT', '(NOISE'][json_extract_string(props, '$.k')::INT % 4 + 1] AS aux, value
  FROM events)"""
SPANS = f"""{SAMPLES},
marks AS (
  SELECT record, t, seq, code, sub_type, CASE WHEN code = '+' THEN aux END AS chosen,
         last_value(CASE WHEN code = '+' THEN aux END IGNORE NULLS) OVER (PARTITION BY record ORDER BY t, seq) AS latest,
         lead(t) OVER (PARTITION BY record ORDER BY t, seq) AS next_t
  FROM samples WHERE code IN ('+', '~')),
spans AS (
  SELECT record, rhythm, t AS begin_t, coalesce(next_t, n) AS end_t
  FROM (SELECT *, nullif(coalesce(chosen, CASE WHEN code = '~' AND sub_type = 0 THEN latest END), '(NOISE') AS rhythm FROM marks)
  JOIN (SELECT record, count(*) AS n FROM samples GROUP BY record) USING (record)
  WHERE rhythm IS NOT NULL AND coalesce(next_t, n) > t)"""
SEGMENTS = f"""{SPANS},
segments AS (
  SELECT record, rhythm, b AS begin_t, b + {SIZE} AS end_t
  FROM (SELECT record, rhythm, unnest(range(begin_t, end_t - {SIZE}, {SIZE})) AS b FROM spans))"""
FACTS = f"""{SEGMENTS},
facts AS (
  SELECT g.record, g.rhythm, g.begin_t, (count_if(s.t > g.begin_t AND s.code IN ('N', 'V')) + 1)::BIGINT AS n_beats,
         max(s.value) - min(s.value) AS amplitude
  FROM segments g JOIN samples s ON s.record = g.record AND s.t >= g.begin_t AND s.t < g.end_t
  GROUP BY g.record, g.rhythm, g.begin_t)"""
CORRECTIONS = """
corrections AS (
  SELECT doc_id % 150 AS record, doc_id % 60 AS begin_t,
         arg_min(CASE WHEN toxic = 1 THEN 'X' WHEN quality = 1 THEN 'C' ELSE '(B' END, doc_id) AS label
  FROM labels GROUP BY ALL)"""


def spans_of(marked: DataFrame) -> DataFrame:
    return S.spans(marked, marked.groupBy("record").agg(F.count("*").alias("n")))


def all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(samples(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, rhythm, begin, n_beats, amplitude) of every segment."""
    marked = samples(spark, sf_dir)
    cut = S.segments(all_spans(spark, sf_dir), SIZE)
    held = S.on_segments(cut, marked.select("record", "t", "code", "value"), SIZE)
    beats = F.count_if(F.col("code").isin("N", "V") & (F.col("t") > F.col("begin"))) + 1
    return held.groupBy("record", "rhythm", "begin").agg(beats.alias("n_beats"), (F.max("value") - F.min("value")).alias("amplitude"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "X").when(F.col("quality") == 1, "C").otherwise("(B")
    named = table(spark, sf_dir, "labels").select((F.col("doc_id") % 150).alias("record"), (F.col("doc_id") % 60).alias("begin"), "doc_id", label.alias("label"))
    return named.groupBy("record", "begin").agg(F.min_by("label", "doc_id").alias("label"))


@query(f"WITH {SPANS} SELECT record, rhythm, begin_t, end_t FROM spans")
def spans_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_spans(spark, sf_dir).select("record", "rhythm", F.col("begin").alias("begin_t"), F.col("end").alias("end_t"))


@query(f"WITH {SEGMENTS} SELECT record, rhythm, begin_t, end_t FROM segments")
def segments_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments(all_spans(spark, sf_dir), SIZE).select("record", "rhythm", F.col("begin").alias("begin_t"), F.col("end").alias("end_t"))


@query(f"WITH {FACTS} SELECT record, begin_t, n_beats, round(amplitude, 6) AS amplitude, round(n_beats / {SIZE / RATE} * 60, 6) AS heart_rate FROM facts")
def segment_beat_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = S.heart_rate(F.col("n_beats"), F.lit(SIZE), RATE)
    return facts(spark, sf_dir).select("record", F.col("begin").alias("begin_t"), "n_beats", F.round("amplitude", 6).alias("amplitude"), F.round(rate, 6).alias("heart_rate"))


AHA = f"""
CASE WHEN rhythm = '(VF' THEN CASE WHEN amplitude > {L.COARSE_MV} THEN 1 ELSE 2 END
     WHEN rhythm = '(VT' THEN CASE WHEN n_beats / {SIZE / RATE} * 60 >= {L.RAPID_BPM} THEN 1 ELSE 2 END ELSE 0 END"""


@query(f"""WITH {FACTS} SELECT record, begin_t, {AHA} AS risk,
  rhythm || CASE WHEN rhythm = '(VF' THEN CASE WHEN amplitude > {L.COARSE_MV} THEN ':coarse' ELSE ':fine' END
                 WHEN rhythm = '(VT' THEN CASE WHEN n_beats / {SIZE / RATE} * 60 >= {L.RAPID_BPM} THEN ':rapid' ELSE ':slow' END ELSE '' END AS detail
FROM facts""")
def risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.col("rhythm"), F.col("amplitude"), S.heart_rate(F.col("n_beats"), F.lit(SIZE), RATE))
    return facts(spark, sf_dir).select("record", F.col("begin").alias("begin_t"), L.risk_class(*args).alias("risk"), L.risk_name(*args).alias("detail"))


@query(f"""WITH {FACTS}, {CORRECTIONS}
SELECT record, begin_t, CASE WHEN label IS NOT NULL AND label <> 'C' THEN label ELSE rhythm END AS rhythm
FROM facts LEFT JOIN corrections USING (record, begin_t)""")
def corrections_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = L.correct(facts(spark, sf_dir), corrections(spark, sf_dir))
    return fixed.select("record", F.col("begin").alias("begin_t"), "rhythm")


@query(f"""WITH {FACTS}, {CORRECTIONS}
SELECT record, begin_t, rhythm FROM facts f WHERE NOT EXISTS (
  SELECT 1 FROM corrections c WHERE c.record = f.record AND c.begin_t = f.begin_t)""")
def corrections_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = facts(spark, sf_dir).join(corrections(spark, sf_dir), ["record", "begin"], "left_anti")
    return left.select("record", F.col("begin").alias("begin_t"), "rhythm")


@query(f"""WITH {FACTS}, {CORRECTIONS}, known AS (SELECT DISTINCT rhythm FROM facts),
kept AS (
  SELECT f.record, f.begin_t, CASE WHEN label IS NOT NULL AND label <> 'C' THEN label ELSE f.rhythm END AS rhythm
  FROM facts f LEFT JOIN corrections USING (record, begin_t))
SELECT rhythm, count(*) AS n_segments, count(DISTINCT record) AS n_records FROM kept WHERE rhythm <> 'X' GROUP BY rhythm""")
def rhythm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and records of each rhythm, after corrections and without excluded ones."""
    kept = L.keep_rhythms(L.correct(facts(spark, sf_dir), corrections(spark, sf_dir)), [])
    return kept.groupBy("rhythm").agg(F.count("*").alias("n_segments"), F.countDistinct("record").alias("n_records")).orderBy("rhythm")


@query(f"""WITH {SAMPLES}, beats AS (SELECT record, t, code, t - lag(t) OVER (PARTITION BY record ORDER BY t, seq) AS rr FROM samples WHERE code IN ('N', 'V'))
SELECT record, round(avg(rr), 6) AS rr_mean, round(stddev_pop(rr), 6) AS rr_std, round(stddev_pop(rr) / avg(rr), 6) AS rr_cv,
       round(avg(CASE WHEN code = 'V' THEN 1.0 ELSE 0.0 END), 6) AS v_ratio
FROM beats WHERE rr IS NOT NULL GROUP BY record""")
def beat_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beat intervals of each record; the first beat has none and is left out."""
    w = W.partitionBy("record").orderBy("t", "seq")
    beats = samples(spark, sf_dir).where(F.col("code").isin("N", "V")).withColumn("rr", F.col("t") - F.lag("t").over(w)).where("rr is not null")
    mean, std = F.avg("rr"), F.stddev_pop("rr")
    return beats.groupBy("record").agg(
        F.round(mean, 6).alias("rr_mean"), F.round(std, 6).alias("rr_std"), F.round(std / mean, 6).alias("rr_cv"),
        F.round(F.avg(F.when(F.col("code") == "V", 1.0).otherwise(0.0)), 6).alias("v_ratio"),
    )


@query(f"""WITH {SAMPLES}, beats AS (SELECT record, t, code, coalesce(code <> lag(code) OVER (PARTITION BY record ORDER BY t, seq), true) AS starts
                       FROM samples WHERE code IN ('N', 'V')),
runs AS (SELECT *, sum(starts::INT) OVER (PARTITION BY record ORDER BY t) AS run FROM beats)
SELECT record, code, min(t) AS begin_t, count(*) AS n_beats FROM runs GROUP BY record, code, run HAVING count(*) >= 3""")
def beat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more consecutive beats of one type."""
    w = W.partitionBy("record").orderBy("t", "seq")
    beats = samples(spark, sf_dir).where(F.col("code").isin("N", "V"))
    beats = beats.withColumn("starts", F.coalesce(F.col("code") != F.lag("code").over(w), F.lit(True)).cast("int"))
    runs = beats.withColumn("run", F.sum("starts").over(w)).groupBy("record", "code", "run")
    return runs.agg(F.min("t").alias("begin_t"), F.count("*").alias("n_beats")).where("n_beats >= 3").drop("run")


@query(f"""WITH {FACTS} SELECT record, begin_t, '(ASYS' AS label FROM facts WHERE amplitude < 20 AND rhythm <> '(ASYS'""")
def low_amplitude_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections for segments of almost no amplitude (here 20 units of value)."""
    flat = facts(spark, sf_dir).where((F.col("amplitude") < 20) & (F.col("rhythm") != "(ASYS"))
    return flat.select("record", F.col("begin").alias("begin_t"), F.lit("(ASYS").alias("label"))


NOTES = ("VT", "Ventricular tachycardia ", " vf", "VENTRICULAR FIBRILLATION?", "sinus rhythm ", "vt?", "(VFIB")


@query(f"""WITH n AS (SELECT event_id, {list(NOTES)}[event_id % {len(NOTES)} + 1] || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END AS note FROM events),
r AS (SELECT *, CASE WHEN lower(trim(note)) = 'vt' OR lower(trim(note)) LIKE 'ventricular tac%' THEN '(VT' WHEN lower(trim(note)) = 'vf' OR lower(trim(note)) LIKE 'ventricular fib%' THEN '(VF' END AS rhythm FROM n)
SELECT event_id, rhythm, CASE trim(note) WHEN '(VFIB' THEN '(VF' ELSE trim(note) END AS canonical FROM r WHERE rhythm IS NOT NULL OR trim(note) = '(VFIB'""")
def note_rhythms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhythms named by free-text notes (here made of the event's number), and aliases; other
    notes are left out."""
    notes = F.element_at(F.array(*map(F.lit, NOTES)), (F.col("event_id") % len(NOTES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(notes, F.when(F.col("event_id") % 3 == 0, " ").otherwise("")).alias("note"))
    named = rows.withColumn("rhythm", L.monitored_rhythm(F.col("note"))).withColumn("canonical", L.canonical(F.trim("note")))
    return named.where(F.col("rhythm").isNotNull() | (F.col("canonical") != F.trim("note"))).select("event_id", "rhythm", "canonical")


#: Records of each source by their remainder, and the rhythms that a source leaves out or alone
#: takes (fixed values).
SOURCES = {"mitdb": (0, None, None), "vfdb": (1, ["(VT"], None), "cudb": (2, ["(N"], None), "edb": (3, None, None), "mghdb": (4, None, ["(VT", "(VF"])}


@query(f"""WITH {SEGMENTS}, s AS (SELECT ['mitdb', 'vfdb', 'cudb', 'edb', 'mghdb'][record % 5 + 1] AS source, * FROM segments)
SELECT source, record, rhythm, begin_t FROM s WHERE NOT (source = 'vfdb' AND rhythm = '(VT') AND NOT (source = 'cudb' AND rhythm = '(N') AND (source <> 'mghdb' OR rhythm IN ('(VT', '(VF'))""")
def federated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of five sources together, each with its own records and rhythms; a source's
    rule holds on its spans, before they are cut."""
    rows = samples(spark, sf_dir)
    parts = []
    for name, (remainder, left_out, alone) in SOURCES.items():
        spans = spans_of(rows.where(F.col("record") % 5 == remainder))
        spans = spans if left_out is None else spans.where(~F.col("rhythm").isin(left_out))
        spans = spans if alone is None else spans.where(F.col("rhythm").isin(alone))
        parts.append(S.segments(spans, SIZE).select(F.lit(name).alias("source"), "record", "rhythm", F.col("begin").alias("begin_t")))
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"""WITH {FACTS} SELECT record, begin_t,
  CASE WHEN rhythm = '(VF' THEN CASE WHEN amplitude > {L.COARSE_MV} THEN 1 ELSE 2 END WHEN rhythm = '(VT' THEN CASE WHEN n_beats / {SIZE / RATE} * 60 >= {L.RAPID_BPM} THEN 1 ELSE 2 END ELSE 0 END AS aha,
  (rhythm = '(VF')::INT AS vf, (rhythm IN ('(VF', '(VFL'))::INT AS vf_vfl, (rhythm IN ('(VF', '(VFL', '(VT'))::INT AS vf_vfl_vt,
  CASE rhythm WHEN '(VF' THEN 1 WHEN '(VT' THEN 2 ELSE 0 END AS kind FROM facts""")
def label_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelling method side by side."""
    r, rate = F.col("rhythm"), S.heart_rate(F.col("n_beats"), F.lit(SIZE), RATE)
    methods = {"aha": L.label(r, "aha", F.col("amplitude"), rate), "vf": L.label(r, "0"), "vf_vfl": L.label(r, "1"), "vf_vfl_vt": L.label(r, "2"), "kind": L.label(r, "3")}
    return facts(spark, sf_dir).select("record", F.col("begin").alias("begin_t"), *(v.alias(k) for k, v in methods.items()))


@query(f"""WITH {FACTS}, {CORRECTIONS}, c AS (SELECT f.*, label FROM facts f LEFT JOIN corrections USING (record, begin_t))
SELECT record, begin_t, CASE WHEN label IN ('(VF', '(VT') THEN 'X' WHEN label IS NOT NULL AND label <> 'C' THEN label ELSE rhythm END AS rhythm FROM c
WHERE coalesce(label, 'C') NOT IN ('X', '(VF', '(VT')""")
def corrections_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections after which shockable rhythms of unknown amplitude or rate are left out."""
    fixed = L.correct(facts(spark, sf_dir), corrections(spark, sf_dir), shockable_to_excluded=True)
    return L.keep_rhythms(fixed, []).select("record", F.col("begin").alias("begin_t"), "rhythm")
