"""Evaluation queries: `labels` as predictions (quality the truth, toxic the prediction),
`embeddings` and `conversations` for classes and repeated tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import evaluation as E
from pulsegrid.operators import labels as L
from pulsegrid.operators import spans as S
from pulsegrid.operators.labels import RAPID_BPM
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.rhythm import FACTS, RATE, SIZE, facts


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    named = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))
    return named.join(docs, "doc_id")


BASE = "p AS (SELECT d.doc_id, lang, source, quality AS truth, toxic AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
COUNTS = """count_if(truth = 1 AND predicted = 1)::BIGINT AS tp, count_if(truth = 0 AND predicted = 1)::BIGINT AS fp,
  count_if(truth = 0 AND predicted = 0)::BIGINT AS tn, count_if(truth = 1 AND predicted = 0)::BIGINT AS fn"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 THEN 0.0 ELSE ({a}) / nullif({b}, 0)::DOUBLE END"


SCORES = ", ".join(
    f"round({ratio(a, b)}, 6) AS {n}"
    for n, a, b in (("se", "tp", "tp + fn"), ("sp", "tn", "tn + fp"), ("ppv", "tp", "tp + fp"), ("acc", "tp + tn", "tp + fp + tn + fn"))
)


@query(f"WITH {BASE}, c AS (SELECT lang, {COUNTS} FROM p GROUP BY lang) SELECT *, {SCORES} FROM c")
def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.binary(predictions(spark, sf_dir), "lang")


MULTI = f"""{BASE}, m AS (SELECT lang, truth + predicted AS truth, (doc_id % 3)::INT AS predicted FROM p),
c AS (SELECT lang, class, {COUNTS.replace('truth =', '(truth = class)::INT =').replace('predicted =', '(predicted = class)::INT =')}
      FROM m, (SELECT unnest([0, 1, 2]) AS class) GROUP BY lang, class)"""


@query(f"WITH {MULTI} SELECT *, {SCORES} FROM c")
def confusion_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("lang", (F.col("truth") + F.col("predicted")).alias("truth"), (F.col("doc_id") % 3).cast("int").alias("predicted"))
    return E.one_vs_rest(p, [0, 1, 2], "lang")


@query(f"""WITH {BASE}, c AS (SELECT source, {COUNTS} FROM p GROUP BY source)
SELECT source, round(0.5 * ({ratio('fn', 'tp + fn')} + {ratio('fp', 'tn + fp')}), 6) AS ber,
       round({ratio('2 * tp', '2 * tp + fn + fp')}, 6) AS f1, round({ratio('1.25 * tp', '1.25 * tp + 0.25 * fn + fp')}, 6) AS f_half,
       round({ratio('5 * tp', '5 * tp + 4 * fn + fp')}, 6) AS f2 FROM c""")
def score_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced error rate and F scores by source."""
    c = E.binary(predictions(spark, sf_dir), "source")
    scores = {"ber": E.balanced_error(), "f1": E.f_beta(1), "f_half": E.f_beta(0.5), "f2": E.f_beta(2)}
    return c.select("source", *(F.round(v, 6).alias(k) for k, v in scores.items()))


@query(f"""WITH {FACTS}, p AS (SELECT rhythm, CASE WHEN rhythm = '(VF' THEN CASE WHEN amplitude > 50 THEN 1 ELSE 2 END WHEN rhythm = '(VT' THEN CASE WHEN n_beats / {SIZE / RATE} * 60 >= {RAPID_BPM} THEN 1 ELSE 2 END ELSE 0 END AS truth,
  (begin_t // {SIZE} + record) % 3 AS predicted FROM facts),
k AS (SELECT rhythm, truth, CASE WHEN predicted = 2 THEN 0 ELSE predicted END AS predicted FROM p WHERE truth <> 2),
c AS (SELECT rhythm, {COUNTS} FROM k GROUP BY ROLLUP (rhythm)) SELECT coalesce(rhythm, 'overall') AS rhythm, tp, fp, tn, fn, {SCORES} FROM c""")
def aha_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shock or none by rhythm and overall; segments between the two are left out, and
    predictions of that class count as none. (Coarse is over 50 units of value here.)"""
    g = facts(spark, sf_dir)
    rate = S.heart_rate(F.col("n_beats"), F.lit(SIZE), RATE)
    truth = L.label(F.col("rhythm"), "aha", F.col("amplitude") / 50 * L.COARSE_MV, rate)
    rows = g.select("rhythm", truth.alias("truth"), ((F.floor(F.col("begin") / SIZE) + F.col("record")) % 3).cast("int").alias("predicted"))
    c = E.without_between(rows).rollup("rhythm").agg(*(v.alias(k) for k, v in E.counts(F.col("truth"), F.col("predicted")).items()))
    return c.select(F.coalesce("rhythm", F.lit("overall")).alias("rhythm"), "tp", "fp", "tn", "fn", *(F.round(v, 6).alias(k) for k, v in E.scores().items()))


@query(f"""WITH {MULTI}, e AS (SELECT *, tp + fn AS n, CASE WHEN tp = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fn + fp)::DOUBLE END AS f1, CASE WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * fn + fp)::DOUBLE END AS fh,
  CASE WHEN tp = 0 THEN 0.0 ELSE 5 * tp / (5 * tp + 4 * fn + fp)::DOUBLE END AS f2 FROM c WHERE tp + fn + fp > 0),
g AS (SELECT lang, avg(1 - recall) FILTER (n > 0) AS ber, avg(f1) AS f1_macro, max(f1) FILTER (class = 1) AS f1_binary, sum(f2 * n) / sum(n) AS f_beta,
  CASE count(*) FILTER (n > 0) WHEN 2 THEN max(fh) FILTER (class = 1) WHEN 3 THEN max(recall) FILTER (class = 1) ELSE 0 END AS custom, max(recall) FILTER (class = 1) AS max_recall FROM e GROUP BY lang)
SELECT lang, round(ber, 6) AS ber, round(f1_macro, 6) AS f1_macro, round(f1_binary, 6) AS f1_binary, round(f_beta, 6) AS f_beta, round(custom, 6) AS custom, round(max_recall, 6) AS max_recall FROM g""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score that models are chosen by, of three classes."""
    p = predictions(spark, sf_dir).select("lang", (F.col("truth") + F.col("predicted")).alias("truth"), (F.col("doc_id") % 3).cast("int").alias("predicted"))
    names = ("ber", "f1_macro", "f1_binary", "f_beta", "custom", "max_recall")
    return E.class_scores(p, [0, 1, 2], 1, "lang").select("lang", *(F.round(n, 6).alias(n) for n in names))


@query(f"WITH {BASE} SELECT doc_id, truth, predicted FROM p WHERE (truth <> 0 AND predicted = 0) OR (truth = 0 AND predicted = 1)")
def critical_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where(E.critical(F.col("truth"), F.col("predicted"))).select("doc_id", "truth", "predicted")


@query("SELECT label, round(sum(n) OVER () / n, 6) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.class_weights(table(spark, sf_dir, "embeddings"), "label").withColumn("weight", F.round("weight", 6))


@query("""SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY (vec_id % 1000003) * 2654435761 % 1000003)
  <= ceil(count(*) OVER (PARTITION BY label) * 0.3))::INT AS is_test FROM embeddings""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return E.stratified_split(rows, "label", F.col("vec_id") % 1000003 * F.lit(2654435761) % 1000003, 0.3)


@query("""SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS code, (lang = 'en')::INT AS is_en FROM documents""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as numbers in the order of their names, and one class against the rest."""
    from pyspark.ml.feature import StringIndexer

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    coded = StringIndexer(inputCol="lang", outputCol="code", stringOrderType="alphabetAsc").fit(docs).transform(docs)
    return coded.select("doc_id", "lang", F.col("code").cast("long").alias("code"), (F.col("lang") == "en").cast("int").alias("is_en"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang NOT IN ('de', 'es') AND source IN ('src0', 'src3')")
def exclude_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where(~F.col("lang").isin("de", "es") & F.col("source").isin("src0", "src3"))
