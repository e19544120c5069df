"""Confusion counts and scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where a is 0, null where b alone is."""
    return F.when(a == 0, 0.0).otherwise(F.try_divide(a, b))


def counts(truth: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp, tn and fn of 0/1 columns as aggregates."""
    return {
        "tp": F.count_if((truth == 1) & (predicted == 1)), "fp": F.count_if((truth == 0) & (predicted == 1)),
        "tn": F.count_if((truth == 0) & (predicted == 0)), "fn": F.count_if((truth == 1) & (predicted == 0)),
    }


def scores() -> dict[str, Column]:
    """Sensitivity, specificity, precision and accuracy from columns tp, fp, tn, fn."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return {"se": ratio(tp, tp + fn), "sp": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "acc": ratio(tp + tn, tp + fp + tn + fn)}


def binary(df: DataFrame, *by: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Confusion counts and scores by group."""
    found = df.groupBy(*by).agg(*(v.alias(k) for k, v in counts(F.col(truth), F.col(predicted)).items()))
    return found.select(*by, "tp", "fp", "tn", "fn", *(F.round(v, 6).alias(k) for k, v in scores().items()))


def one_vs_rest(df: DataFrame, classes: list, *by: str) -> DataFrame:
    """The same for each class against the others, in one pass over the rows."""
    rows = df.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    hit = lambda c: (F.col(c) == F.col("class")).cast("int")
    return binary(rows.withColumn("truth", hit("truth")).withColumn("predicted", hit("predicted")), *by, "class")


def f_beta(beta: float) -> Column:
    """From columns tp, fp, fn."""
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    b = beta * beta
    return ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def balanced_error() -> Column:
    """Half the sum of the error rates of both classes."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return 0.5 * (ratio(fn, tp + fn) + ratio(fp, tn + fp))


def critical(truth: Column, predicted: Column) -> Column:
    """A missed shock, or a shock where none was due."""
    return ((truth != 0) & (predicted == 0)) | ((truth == 0) & (predicted == 1))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): all rows over the rows of the class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select(label, (F.col("total") / F.col("n")).alias("weight"))  # total: one row


def stratified_split(df: DataFrame, label: str, key: Column, share: float) -> DataFrame:
    """Append is_test: of each class, rows in the order of a hashed key until `share` of
    them. Counts by class and hash cell come first, so no class is sorted in one task."""
    cell = F.floor(key / 1000)
    cells = df.groupBy(F.col(label).alias("_label"), cell.alias("_cell")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("_label").orderBy("_cell")
    whole = W.partitionBy("_label")
    cells = cells.select("_label", "_cell", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("size"))
    placed = df.withColumn("_key", key).withColumn("_cell2", F.floor(F.col("_key") / 1000))
    placed = placed.join(cells, (placed[label].eqNullSafe(cells["_label"])) & (placed["_cell2"] == cells["_cell"]))
    within = W.partitionBy("_label", "_cell").orderBy("_key")
    rank = F.col("before") + F.row_number().over(within)
    return placed.withColumn("is_test", (rank <= F.ceil(F.col("size") * share)).cast("int")).drop("_label", "_cell", "_cell2", "_key", "before", "size")


def class_scores(df: DataFrame, classes: list[int], shocked: int, *by: str) -> DataFrame:
    """One row per group from rows (by, truth, predicted): balanced error over the classes
    that occur, mean F1, F1 of the shocked class, F2 weighted by the classes' sizes, the score
    for choosing models (F0.5 with two classes, recall of the shocked class with three) and
    the recall of the shocked class."""
    each = one_vs_rest(df, classes, *by).withColumn("n", F.col("tp") + F.col("fn")).where("tp + fn + fp > 0")
    on = lambda c: F.max(F.when(F.col("class") == shocked, c))
    true = F.col("n") > 0
    recall = ratio(F.col("tp"), F.col("n"))
    found = each.groupBy(*by).agg(
        F.avg(F.when(true, 1 - recall)).alias("ber"), F.avg(f_beta(1)).alias("f1_macro"), on(f_beta(1)).alias("f1_binary"),
        (F.sum(f_beta(2) * F.col("n")) / F.sum("n")).alias("f_beta"), on(f_beta(0.5)).alias("_half"), on(recall).alias("max_recall"), F.count_if(true).alias("_classes"),
    )
    custom = F.when(F.col("_classes") == 2, F.col("_half")).when(F.col("_classes") == 3, F.col("max_recall")).otherwise(0.0)
    return found.withColumn("custom", custom).drop("_half", "_classes")


def without_between(df: DataFrame, between: int = 2) -> DataFrame:
    """Rows whose truth is not the class between shock and none; predictions of it count as none."""
    return df.where(F.col("truth") != between).withColumn("predicted", F.when(F.col("predicted") == between, 0).otherwise(F.col("predicted")))
