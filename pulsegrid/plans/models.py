"""Model queries with pyspark.ml. `embeddings` stand for feature rows, `label` for rhythms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import evaluation as E
from pulsegrid.operators import training as M
from pulsegrid.plans.registry import query, table

def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components as features, three classes and a fixed split by a formula of the id. Of
    embeddings of several lengths those of the commonest count."""
    df = table(spark, sf_dir, "embeddings").where("embedding is not null")
    width = df.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()["n"]
    df = df.where(F.size("embedding") == width)
    y = F.when(F.col("embedding")[0] > 0.1, 1).when(F.col("embedding")[1] > 0.1, 2).otherwise(0)
    cols = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(width)]
    df = df.select("vec_id", *cols, y.cast("double").alias("y"))
    return E.stratified_split(df, "y", F.col("vec_id") % 1000003 * F.lit(2654435761) % 1000003, 0.3)


def features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "f"]


@query()
def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled logistic regression with cross-validation, scored by class on the test part."""
    df = rows(spark, sf_dir)
    model = M.train(df.where("is_test = 0"), features(df), "y", "logistic_regression", folds=3)
    return E.one_vs_rest(M.predict(model, df.where("is_test = 1"), "y"), [0, 1, 2])


@query()
def feature_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds that each drop the feature of the least squared weight."""
    df = rows(spark, sf_dir).where("is_test = 0")
    return M.eliminate(df, features(df), "y", keep=4)


@query()
def kmeans_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes within each of three clusters of scaled and normalised features."""
    df = rows(spark, sf_dir)
    return M.clusters(df, features(df), 3).groupBy("cluster", "y").agg(F.count("*").alias("n"))


@query()
def univariate_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the label each feature alone explains on held-out rows."""
    df = rows(spark, sf_dir)
    return M.univariate(df, features(df), "y")


@query()
def pca_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of unit variance: mean and deviation of each over all rows."""
    df = rows(spark, sf_dir)
    white = M.whitened(df, features(df), 3)
    return white.agg(*(F.round(f(F.get("white", F.lit(k))), 6).alias(f"{n}{k}") for k in range(3) for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


@query()
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hold-outs of boosted trees, the best of them, and their means."""
    df = rows(spark, sf_dir).drop("is_test")
    return M.experiment(df, features(df), "y", "adaboost", 3, lambda k: (F.col("vec_id") % 1000003 * F.lit(2654435761) + k * 40503) % 1000003)
