"""Estimators that pyspark.ml does not have: boosting over weighted rows, and random features
for the radial kernel. Both are stages of a pipeline like any other."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.scan import written


class FourierFeatures(Transformer):
    """Random cosine features: the product of two rows' features is, on average, the radial kernel
    exp(-gamma |x - y|^2) of the rows. `size` features, drawn from `seed`."""

    def __init__(self, inputs: str, output: str, size: int = 100, gamma: float = 1.0, seed: int = 1):
        super().__init__()
        self.inputs, self.output, self.size, self.gamma, self.seed = inputs, output, size, gamma, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        first = df.select(F.size(vector_to_array(self.inputs)).alias("n")).first()
        if first is None:
            return df.withColumn(self.output, F.col(self.inputs))
        rng = np.random.default_rng(self.seed)
        turns = rng.normal(0, math.sqrt(2 * self.gamma), (self.size, first["n"]))
        shifts = rng.uniform(0, 2 * math.pi, self.size)
        table = F.array(*(F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(turns.tolist(), shifts.tolist())))
        x = vector_to_array(self.inputs)

        def wave(row):
            return F.transform(table, lambda t: math.sqrt(2 / self.size) * F.cos(F.aggregate(F.zip_with(row, t["w"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + t["b"]))

        return df.withColumn(self.output, array_to_vector(F.element_at(F.transform(F.array(x), wave), 1)))


class Boosted(Estimator):
    """Boosting over several classes: each round fits a small tree to weighted rows, and the rows
    that it gets wrong weigh more in the next. Rounds end early when a tree errs on nothing, or is
    no better than a guess. Weights are a column, written every few rounds so that plans stay short."""

    def __init__(self, features: str, label: str, rounds: int = 10, depth: int = 2, seed: int = 1, every: int = 4):
        super().__init__()
        self.features, self.label, self.rounds, self.depth, self.seed, self.every = features, label, rounds, depth, seed, every

    def _fit(self, df: DataFrame) -> Boosted.Fitted:
        rows = df.select(self.features, self.label).withColumn("_w", F.lit(1.0))
        classes = rows.select(F.max(self.label)).first()[0]
        if classes is None:
            raise ValueError("there are no rows to learn from")
        classes, trees = int(classes) + 1, []
        for k in range(self.rounds):
            tree = DecisionTreeClassifier(featuresCol=self.features, labelCol=self.label, weightCol="_w", maxDepth=self.depth, seed=self.seed, predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q")
            model = tree.fit(rows)
            told = model.transform(rows).select(self.features, self.label, "_w", (F.col("_p") != F.col(self.label)).alias("_off"))
            off, total = told.agg(F.sum(F.when(F.col("_off"), F.col("_w")).otherwise(0.0)), F.sum("_w")).first()
            share = off / total
            if share >= 1 - 1 / max(classes, 2):
                break
            say = math.log((1 - share) / max(share, 1e-10)) + math.log(max(classes - 1, 1))
            trees.append((model, say))
            if share == 0:
                break
            rows = told.select(self.features, self.label, (F.col("_w") * F.when(F.col("_off"), F.exp(F.lit(say))).otherwise(1.0) / total).alias("_w"))
            if k % self.every == self.every - 1:
                rows = written(rows, "boosting")
        if not trees:  # nothing is better than a guess: the first tree stands
            trees.append((model, 1.0))
        return Boosted.Fitted(trees, classes)

    class Fitted(Model):
        def __init__(self, trees: list, classes: int):
            super().__init__()
            self.trees, self.classes = trees, classes

        def _transform(self, df: DataFrame) -> DataFrame:
            out, names = df, []
            for k, (model, _) in enumerate(self.trees):
                names.append(f"_p{k}")
                out = model.copy().setPredictionCol(names[-1]).setRawPredictionCol("").setProbabilityCol("").transform(out)
            votes = [sum((F.when(F.col(n) == c, say).otherwise(0.0) for n, (_, say) in zip(names, self.trees)), F.lit(0.0)) for c in range(self.classes)]
            best = F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(-c).alias("c")) for c, v in enumerate(votes))))
            return out.withColumn("prediction", (-best["c"]).cast("double")).drop(*names)
