"""Training protocols over pyspark.ml: scaled pipelines with cross-validation, feature
elimination, clustering and single-feature regressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, Normalizer, PolynomialExpansion, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.estimators import Boosted, FourierFeatures
from pulsegrid.operators.evaluation import stratified_split
from pulsegrid.operators.scan import written


#: Names of the classifiers.
ESTIMATORS = ("logistic_regression", "random_forest", "gradient_boosting", "adaboost", "svc_linear", "svc_poly", "svc_rbf", "mlp1", "mlp2")


def estimator(name: str, label: str, inputs: int = 0, classes: int = 3) -> tuple[list[Estimator], list[dict]]:
    """Stages and parameter grid of a named classifier over the column `scaled`; the networks need
    to know how many features and classes there are."""
    on = {"featuresCol": "scaled", "labelCol": label}
    grid = ParamGridBuilder()
    if name == "logistic_regression":
        lr = C.LogisticRegression(**on, maxIter=50)
        return [lr], grid.addGrid(lr.regParam, [0.0, 0.01]).build()
    if name == "random_forest":
        rf = C.RandomForestClassifier(**on, seed=1)
        return [rf], grid.addGrid(rf.numTrees, [20, 50]).build()
    if name == "gradient_boosting":
        return [C.OneVsRest(classifier=C.GBTClassifier(**on, maxIter=10, seed=1), **on)], grid.build()
    if name == "svc_linear":
        return [C.OneVsRest(classifier=C.LinearSVC(**on), **on)], grid.build()
    if name == "svc_poly":
        wide = PolynomialExpansion(degree=2, inputCol="scaled", outputCol="wide")
        at = {"featuresCol": "wide", "labelCol": label}
        return [wide, C.OneVsRest(classifier=C.LinearSVC(**at), **at)], grid.build()
    if name == "svc_rbf":
        at = {"featuresCol": "waves", "labelCol": label}
        return [FourierFeatures("scaled", "waves", gamma=1 / max(1, inputs)), C.OneVsRest(classifier=C.LinearSVC(**at, maxIter=30), **at)], grid.build()
    if name == "adaboost":
        return [Boosted("scaled", label)], grid.build()
    if name in ("mlp1", "mlp2"):
        hidden = [max(4, inputs // 2)] * int(name[-1])
        return [C.MultilayerPerceptronClassifier(**on, layers=[inputs, *hidden, classes], maxIter=50, seed=1)], grid.build()
    raise ValueError(f"no estimator {name}; there are {ESTIMATORS}")


def pipeline(features: list[str], stages: list[Estimator]) -> Pipeline:
    """Features to -1..1, as the training rows have them, then the stages."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), MinMaxScaler(min=-1, max=1, inputCol="features", outputCol="scaled"), *stages])


def spread(df: DataFrame, name: str) -> DataFrame:
    """df written once, for fits that read it many times: in a part for every task that runs at
    the same time, whatever few tasks made it (a split ranks the rows of a class in one)."""
    session = df.sparkSession
    key = F.xxhash64(*(c for c in df.columns))
    return written(df.repartition(max(2, session.sparkContext.defaultParallelism), key), name)


def train(df: DataFrame, features: list[str], label: str, name: str, folds: int = 5, metric: str = "f1") -> PipelineModel:
    """The best of the grid by cross-validation, over folds that a hash of the row gives."""
    classes = int(df.agg(F.max(label)).first()[0] or 0) + 1 if name.startswith("mlp") else 0
    stages, grid = estimator(name, label, len(features), classes)
    if len(grid) < 2:
        return pipeline(features, stages).fit(df)
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(*features), F.lit(folds)).cast("int"))
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    search = CrossValidator(estimator=pipeline(features, stages), estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, foldCol="_fold")
    return search.fit(folded).bestModel


def predict(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    return model.transform(df).select(F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"))


def eliminate(df: DataFrame, features: list[str], label: str, keep: int) -> DataFrame:
    """(feature, place): features dropped one by one by least squared weight; those left
    have place 1, the last to go 2."""
    left, gone = list(features), []
    # Features are scaled one by one, so once for all rounds.
    rows = df.select(*features, label)
    rows = spread(pipeline(features, []).fit(rows).transform(rows).select("scaled", label), "elimination")
    while len(left) > keep:
        slicer = VectorSlicer(inputCol="scaled", outputCol="left", indices=[features.index(f) for f in left])
        model = C.LogisticRegression(featuresCol="left", labelCol=label, maxIter=25).fit(slicer.transform(rows))
        weights = (model.coefficientMatrix.toArray() ** 2).sum(axis=0)
        gone.append(left.pop(int(weights.argmin())))
    places = [(f, 1) for f in left] + [(f, len(gone) + 1 - i) for i, f in enumerate(gone)]
    return df.sparkSession.createDataFrame(places, "feature string, place int")


def elimination_order(df: DataFrame, features: list[str], label: str) -> list[str]:
    """Features by when a linear machine gives them up: the last to go first. Each round fits to
    those that are left and drops the one of least squared weight over all classes."""
    left, gone = list(features), []
    while len(left) > 1:
        on = {"featuresCol": "scaled", "labelCol": label}
        model = pipeline(left, [C.OneVsRest(classifier=C.LinearSVC(**on, maxIter=20), **on)]).fit(df).stages[-1]
        weights = sum(m.coefficients.toArray() ** 2 for m in model.models)
        gone.append(left.pop(int(weights.argmin())))
    return [*left, *reversed(gone)]


def experiment(df: DataFrame, features: list[str], label: str, name: str, times: int, key: Callable[[int], Column], share: float = 0.3, keep: int | None = None) -> DataFrame:
    """(iteration, n, accuracy, f1, best) of `times` hold-outs, and a last row (iteration null) of
    their means. A hold-out is a stratified split by key(iteration), a fit of the named
    estimator and the scores of its test rows; with `keep`, on the features that a linear machine
    keeps longest on its training rows. The best is the first whose f1 no earlier one reaches."""
    rows, best, chosen = [], None, None
    for k in range(times):
        split = spread(stratified_split(df, label, key(k), share).select(*features, label, "is_test"), "holdout")
        fit, test = split.where("is_test = 0"), split.where("is_test = 1")
        own = features if keep is None else elimination_order(fit, features, label)[:keep]
        told = predict(train(fit, own, label, name, folds=3), test, label).withColumns({c: F.col(c).cast("double") for c in ("truth", "predicted")})
        told = written(told, "predictions")
        score = lambda metric: MulticlassClassificationEvaluator(labelCol="truth", predictionCol="predicted", metricName=metric).evaluate(told)
        rows.append((k, told.count(), score("accuracy"), score("f1")))
        if best is None or rows[-1][3] > best:
            best, chosen = rows[-1][3], k
    mean = [sum(r[c] for r in rows) / len(rows) for c in (2, 3)]
    out = [(k, n, a, f, k == chosen) for k, n, a, f in rows] + [(None, sum(r[1] for r in rows), *mean, None)]
    return df.sparkSession.createDataFrame(out, "iteration int, n long, accuracy double, f1 double, best boolean")


def clusters(df: DataFrame, features: list[str], k: int) -> DataFrame:
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="even"),
        Normalizer(p=2, inputCol="even", outputCol="unit"), KMeans(k=k, seed=1, featuresCol="unit", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop("raw", "even", "unit")


def univariate(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, r2) of a forest over each feature alone, on rows with is_test."""
    scores, df = [], spread(df.select(*features, label, "is_test"), "univariate")  # of which each fit reads one feature
    for f in features:
        made = VectorAssembler(inputCols=[f], outputCol="one").transform(df)
        model = RandomForestRegressor(featuresCol="one", labelCol=label, numTrees=10, maxDepth=4, seed=1).fit(made.where("is_test = 0"))
        scores.append((f, float(RegressionEvaluator(labelCol=label, metricName="r2").evaluate(model.transform(made.where("is_test = 1"))))))
    return df.sparkSession.createDataFrame(scores, "feature string, r2 double")


def whitened(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Append white: the k first principal components, centred and of unit variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="even"),
        PCA(k=k, inputCol="even", outputCol="parts"), StandardScaler(withMean=True, inputCol="parts", outputCol="unit"),
    ]
    made = Pipeline(stages=stages).fit(df).transform(df)
    return made.withColumn("white", vector_to_array("unit")).drop("raw", "even", "parts", "unit")
