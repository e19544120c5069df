"""Beat-by-beat scores of a detector against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Beat codes by class of the scoring standard (fixed values): normal, supraventricular,
#: ventricular, fusion, unknown. Every other code is no beat (O).
CLASSES = {"N": "NLRB", "S": "JAaSejn", "V": "VrE", "F": "F", "Q": "Q/f?"}
LABELS = ("N", "S", "V", "F", "Q", "O", "X")


def beat_class(code: Column, supraventricular: bool = True) -> Column:
    """Class of a beat code; without `supraventricular` those beats count as normal."""
    out = F.lit("O")
    for name, codes in CLASSES.items():
        out = F.when(code.isin(*codes), "N" if name == "S" and not supraventricular else name).otherwise(out)
    return out


def with_missed(pairs: DataFrame, ref: DataFrame, test: DataFrame) -> DataFrame:
    """pairs (record, ref, test, t_ref, t_test) and the beats (record, t, code) of either side
    that stand in none: a missed beat has test O, an extra one ref O."""
    none = F.lit(None).cast("double")
    missed = ref.join(pairs.select("record", F.col("t_ref").alias("t")), ["record", "t"], "left_anti")
    extra = test.join(pairs.select("record", F.col("t_test").alias("t")), ["record", "t"], "left_anti")
    missed = missed.select("record", F.col("code").alias("ref"), F.lit("O").alias("test"), F.col("t").alias("t_ref"), none.alias("t_test"))
    extra = extra.select("record", F.lit("O").alias("ref"), F.col("code").alias("test"), none.alias("t_ref"), F.col("t").alias("t_test"))
    return pairs.select("record", "ref", "test", "t_ref", "t_test").unionByName(missed).unionByName(extra)


def matrix(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts of every (ref, test) as one row of columns, Nn to Xx, by group."""
    cells = [F.count_if((F.col("ref") == a) & (F.col("test") == b)).alias(f"{a}{b.lower()}") for a in LABELS for b in LABELS if (a, b) != ("O", "O")]
    return pairs.groupBy(*by).agg(*cells)


def rr_error(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, rms_rr): root mean square of the differences of intervals between beats paired in a row."""
    w = W.partitionBy("record").orderBy("t_ref")
    both = pairs.where("t_ref is not null and t_test is not null")
    off = (F.col("t_ref") - F.lag("t_ref").over(w)) - (F.col("t_test") - F.lag("t_test").over(w))
    return both.withColumn("_off", off).groupBy(*by).agg(F.sqrt(F.avg(F.col("_off") * F.col("_off"))).alias("rms_rr"))


def summary(pairs: DataFrame, *by: str) -> DataFrame:
    """Percentages by group: sensitivity and predictivity of beats, of ventricular and of
    supraventricular ones, and the rate of false ventricular ones."""
    ref, test = F.col("ref"), F.col("test")
    beat = lambda c: c.isin("N", "S", "V", "F", "Q")
    share = lambda a, b: 100 * F.try_divide(F.count_if(a), F.count_if(a) + F.count_if(b))
    # A test beat that the reference calls fusion or unknown is no false ventricular beat.
    v_false = (test == "V") & ref.isin("N", "S", "O", "X")
    v_right = (ref != "V") & (test != "V") & beat(test)
    return pairs.groupBy(*by).agg(
        share(beat(ref) & beat(test), beat(ref) & ~beat(test)).alias("q_se"), share(beat(ref) & beat(test), ~beat(ref) & beat(test)).alias("q_ppv"),
        share((ref == "V") & (test == "V"), (ref == "V") & (test != "V")).alias("v_se"), share((ref == "V") & (test == "V"), v_false).alias("v_ppv"),
        share(v_false, v_right).alias("v_fpr"),
        share((ref == "S") & (test == "S"), (ref == "S") & (test != "S")).alias("s_se"), share((ref == "S") & (test == "S"), ~ref.isin("S", "Q") & (test == "S")).alias("s_ppv"),
    )
