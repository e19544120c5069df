"""Statistics queries over dimensions of `embeddings`, `lineitem` and `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import decomposition
from pulsegrid.operators import stats as S
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.signal import recordings

# A p value made of a row's numbers, the same in both engines.
P = "((l_orderkey * 7919 + l_linenumber * 104729) % 100003 + 1) / 100003.0"
PV = f"p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS family, {P} AS p FROM lineitem)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100003 + 1) / F.lit(100003.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("family"), p.alias("p"))


FDR = """SELECT id, line, round(least(1.0, min(q) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_fdr
FROM (SELECT *, p * m * {factor} / r AS q FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS r FROM p))"""


@query(f"WITH {PV} {FDR.format(factor='1.0')}")
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjusted(p_values(spark, sf_dir), "p", "family").select("id", "line", F.round("p_fdr", 6).alias("p_fdr"))


@query(f"WITH {PV} {FDR.format(factor='list_sum([1.0::DOUBLE / k for k in range(1, m + 1)])')}")
def fdr_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjusted(p_values(spark, sf_dir), "p", "family", dependent=True).select("id", "line", F.round("p_fdr", 6).alias("p_fdr"))


@query(f"""WITH {PV} SELECT id, line, round(least(1.0, max(q) OVER (PARTITION BY family ORDER BY r)), 6) AS p_holm
FROM (SELECT *, p * (m - r + 1) AS q FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p) AS r FROM p))""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holm(p_values(spark, sf_dir), "p", "family").select("id", "line", F.round("p_holm", 6).alias("p_holm"))


@query("""WITH o AS (SELECT o_orderkey, floor(o_totalprice / 100) AS v FROM orders), n AS (SELECT floor(l_extendedprice / 100) AS v FROM lineitem),
c AS (SELECT v, count(*) AS n FROM n GROUP BY v), s AS (SELECT v, sum(n) OVER (ORDER BY v DESC) AS above FROM c)
SELECT o_orderkey, round(coalesce((SELECT min_by(above, v) FROM s WHERE s.v >= o.v), 0) / (SELECT count(*) FROM n), 6) AS p FROM o""")
def pval_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a null distribution at or above each value."""
    values = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("v"))
    null = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 100).alias("v"))
    return S.null_p(values, null, "v", F.floor(F.col("v") / 50)).select("o_orderkey", F.round("p", 6).alias("p"))


EVENTS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"


@query(f"""WITH {EVENTS}, o AS (SELECT *, v > 60 AS hot, (v > 60 AND NOT coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY t) > 60, false))::INT AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS cluster FROM o)
SELECT user_id, cluster::BIGINT AS cluster, min(t) AS first, max(t) AS last, count(*) AS n, round(sum(v), 6) AS mass FROM r WHERE hot GROUP BY user_id, cluster""")
def cluster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recordings(spark, sf_dir).select("user_id", "t", F.col("value").alias("v"))
    return S.runs(rows, "t", F.col("v") > 60, "user_id").withColumn("mass", F.round("mass", 6))


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, t, h, CASE WHEN h > 0 THEN v - 50 >= h ELSE v - 50 <= h END AS hot FROM e, (SELECT unnest([10.0, 20.0, 30.0, 40.0, -10.0, -20.0, -30.0, -40.0]) AS h)),
o AS (SELECT *, (hot AND NOT coalesce(lag(hot) OVER (PARTITION BY user_id, h ORDER BY t), false))::INT AS new FROM a),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, h ORDER BY t) AS run FROM o),
x AS (SELECT *, count(*) OVER (PARTITION BY user_id, h, run) AS n FROM r WHERE hot)
SELECT user_id, t, round(sum(pow(n, 2.0::DOUBLE / 3) * h * h * 10 * sign(h)), 4) AS tfce FROM x GROUP BY user_id, t""")
def tfce_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster enhancement of both tails about 50."""
    rows = recordings(spark, sf_dir).select("user_id", "t", (F.col("value") - 50).alias("v"))
    return S.enhanced(rows, "t", [10.0, 20.0, 30.0, 40.0], "user_id").withColumn("tfce", F.round("tfce", 4))


@query("""WITH d AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v, label FROM embeddings)
SELECT dim, round(corr(v, label), 6) AS r, count(*) AS n FROM d GROUP BY dim""")
def pearson_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return long.groupBy("dim").agg(F.round(F.corr(F.col("v").cast("double"), F.col("label").cast("double")), 6).alias("r"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v, label FROM embeddings),
r AS (SELECT dim, rank() OVER (PARTITION BY dim ORDER BY v) + (count(*) OVER (PARTITION BY dim, v) - 1) / 2 AS a,
             rank() OVER (PARTITION BY dim ORDER BY label) + (count(*) OVER (PARTITION BY dim, label) - 1) / 2 AS b FROM d)
SELECT dim, round(corr(a, b), 6) AS rho FROM r GROUP BY dim""")
def spearman_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    ranked = long.select("dim", S.average_rank("v", "dim").alias("a"), S.average_rank("label", "dim").alias("b"))
    return ranked.groupBy("dim").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("""WITH a AS (SELECT l_suppkey AS supp, l_quantity AS v, perm, row_number() OVER (PARTITION BY perm, l_suppkey ORDER BY (l_orderkey * (2 * perm + 1) * 31 + l_linenumber * 17) % 10007, l_orderkey, l_linenumber, l_quantity) AS place
  FROM lineitem, (SELECT unnest(range(0, 5)) AS perm)),
s AS (SELECT supp, perm, count(*) FILTER (place % 2 = 0) AS n1, count(*) FILTER (place % 2 = 1) AS n0, avg(v) FILTER (place % 2 = 0) AS m1, avg(v) FILTER (place % 2 = 1) AS m0,
             var_samp(v) FILTER (place % 2 = 0) AS v1, var_samp(v) FILTER (place % 2 = 1) AS v0 FROM a GROUP BY ALL)
SELECT supp, perm, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 6) AS t FROM s""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t of two halves of each group under five shuffles within the group."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("v"), "l_orderkey", "l_linenumber")
    key = F.struct((F.col("l_orderkey") * (2 * F.col("perm") + 1) * 31 + F.col("l_linenumber") * 17) % 10007, "l_orderkey", "l_linenumber", "v")
    shuffled = S.permuted(rows, key, 5, "supp")
    return S.unpaired_t(shuffled, F.col("place") % 2 == 0, "v", "supp", "perm").select("supp", F.col("perm").cast("long").alias("perm"), F.round("t", 6).alias("t"))


@query("""WITH d AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64),
m AS (SELECT label AS cluster, dim, avg(v) AS m FROM d GROUP BY ALL),
far AS (SELECT vec_id, label, cluster, sum((v - m) ** 2) AS far FROM d JOIN m USING (dim) GROUP BY ALL),
near AS (SELECT vec_id, label, arg_min(cluster, (far, cluster)) AS cluster FROM far GROUP BY ALL),
c AS (SELECT cluster, label, count(*) AS n FROM near GROUP BY ALL)
SELECT cluster, label, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS place FROM c""")
def cluster_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes among the members of each cluster, the largest first; a member's cluster is the
    nearest class mean."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    counts = nearest_mean(rows, class_means(rows), "cluster").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "label")))


def class_means(rows: DataFrame, *by: str) -> DataFrame:
    """(by, label, mean) of rows (by, label, x): the mean vector of each class."""
    each = rows.select(*by, "label", F.posexplode("x").alias("dim", "v")).groupBy(*by, "label", "dim").agg(F.avg("v").alias("m"))
    return each.groupBy(*by, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda d: d["m"]).alias("mean"))


def nearest_mean(rows: DataFrame, means: DataFrame, name: str, *by: str) -> DataFrame:
    """rows with the label whose mean is nearest, of equally near ones the smallest, as `name`."""
    mine = means.groupBy(*by).agg(F.collect_list(F.struct("label", "mean")).alias("means"))  # one row per class
    both = rows.join(F.broadcast(mine), [*by]) if by else rows.crossJoin(F.broadcast(mine))
    far = lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    nearest = F.array_min(F.transform("means", lambda c: F.struct(far(c["mean"]).alias("far"), c["label"].alias("label"))))
    return both.withColumn(name, nearest["label"]).drop("means")


HASH = "((vec_id % 1000003) * 2654435761 + it * 40503) % 1000003"


@query(f"""WITH v AS (SELECT vec_id, label, embedding, it, row_number() OVER (PARTITION BY it, label ORDER BY {HASH}, vec_id) <= ceil(count(*) OVER (PARTITION BY it, label) * 0.3) AS test
  FROM embeddings, (SELECT unnest(range(0, 5)) AS it) WHERE len(embedding) = 64),
d AS (SELECT vec_id, label, it, test, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM v),
m AS (SELECT it, label AS class, dim, avg(v) AS m FROM d WHERE NOT test GROUP BY ALL),
far AS (SELECT it, vec_id, label, class, sum((v - m) ** 2) AS far FROM d JOIN m USING (it, dim) WHERE test GROUP BY ALL),
p AS (SELECT it, vec_id, label, arg_min(class, (far, class)) AS predicted FROM far GROUP BY ALL),
s AS (SELECT it, count(*) AS n, avg((label = predicted)::INT) AS accuracy, avg((label = predicted)::INT) FILTER (label = 1) AS max_recall FROM p GROUP BY it)
SELECT it, n, round(accuracy, 6) AS accuracy, round(max_recall, 6) AS max_recall, round(avg(accuracy) OVER (), 6) AS mean, round(stddev_pop(accuracy) OVER (), 6) AS std FROM s""")
def repeated_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stratified splits at once: class means of each split's training rows, accuracy and
    recall of class 1 over its test rows, and the mean and deviation of all splits."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("it"))
    whole = W.partitionBy("it", "label")
    key = (F.col("vec_id") % 1000003 * F.lit(2654435761) + F.col("it") * 40503) % 1000003
    rows = rows.withColumn("test", F.row_number().over(whole.orderBy(key, "vec_id")) <= F.ceil(F.count("*").over(whole) * 0.3))
    found = nearest_mean(rows.where("test"), class_means(rows.where("not test"), "it"), "predicted", "it")
    hit = (F.col("label") == F.col("predicted")).cast("int")
    each = found.groupBy("it").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("label") == 1, hit)).alias("max_recall"))
    total = each.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))
    out = each.crossJoin(F.broadcast(total))  # one row
    return out.select(F.col("it").cast("long").alias("it"), "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "max_recall", "mean", "std")))


@query(f"""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events), o AS (SELECT *, v > 60 AS hot, (v > 60 AND NOT coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY t) > 60, false))::INT AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM o)
SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, run) AS cluster FROM r WHERE hot""")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected places over a threshold, from an edge table of neighbours in time."""
    from pulsegrid.operators import graph

    rows = recordings(spark, sf_dir).select("user_id", "t", F.col("event_id").alias("node"), F.col("value").alias("v"))
    following = F.lead("node").over(W.partitionBy("user_id").orderBy("t"))
    edges = rows.select(F.col("node").alias("src"), following.alias("dst")).where("dst is not null")
    return graph.clusters(rows.where("v > 60").select("node"), edges)


#: The integral of the density of t by the same substitution, scaled by the gamma function.
STUDENT = """1 - 2 / sqrt(pi()) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) * atan(abs(t) / sqrt(df)) / 4000 / 3 *
  list_sum([(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs(t) / sqrt(df)) * k / 4000), df - 1) for k in range(0, 4001)])"""


@query(f"""WITH d AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v, label FROM embeddings),
c AS (SELECT dim, corr(v, label) AS r, count(*) - 2 AS df FROM d GROUP BY dim), t AS (SELECT *, r * sqrt(df / (1 - r * r)) AS t FROM c)
SELECT dim, round(r, 6) AS r, round({STUDENT}, 5) AS p, df + 2 AS n FROM t""")
def correlation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each feature with the class, and its two-sided p."""
    long = table(spark, sf_dir, "embeddings").select(F.col("label").cast("double").alias("label"), F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    return S.correlation(long, "v", "label", "dim").select("dim", F.round("r", 6).alias("r"), F.round("p", 5).alias("p"), "n")


@query("""WITH h AS (SELECT l_suppkey AS supp, l_quantity AS v, l_orderkey, l_linenumber, l_returnflag = 'N' AS true_group FROM lineitem),
tt AS (SELECT supp, count(*) FILTER (true_group) AS n1, count(*) FILTER (NOT true_group) AS n0, avg(v) FILTER (true_group) AS m1, avg(v) FILTER (NOT true_group) AS m0,
              var_samp(v) FILTER (true_group) AS v1, var_samp(v) FILTER (NOT true_group) AS v0 FROM h GROUP BY supp),
t AS (SELECT supp, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t FROM tt),
a AS (SELECT supp, v, perm, row_number() OVER (PARTITION BY perm, supp ORDER BY (l_orderkey * (2 * perm + 1) * 31 + l_linenumber * 17) % 10007, l_orderkey, l_linenumber, v) AS place
      FROM h, (SELECT unnest(range(0, 19)) AS perm)),
s AS (SELECT supp, perm, count(*) FILTER (place % 2 = 0) AS n1, count(*) FILTER (place % 2 = 1) AS n0, avg(v) FILTER (place % 2 = 0) AS m1, avg(v) FILTER (place % 2 = 1) AS m0,
             var_samp(v) FILTER (place % 2 = 0) AS v1, var_samp(v) FILTER (place % 2 = 1) AS v0 FROM a GROUP BY ALL),
u AS (SELECT supp, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS s FROM s)
SELECT supp, round(t, 6) AS t, round((count(*) FILTER (abs(s) >= abs(t)) + 1)::DOUBLE / (count(*) + 1), 6) AS p FROM t JOIN u USING (supp) GROUP BY supp, t""")
def permutation_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of the difference between two kinds of rows in each group, from nineteen shuffles."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("v"), "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("kind"))
    key = F.struct((F.col("l_orderkey") * (2 * F.col("perm") + 1) * 31 + F.col("l_linenumber") * 17) % 10007, "l_orderkey", "l_linenumber", "v")
    found = S.permutation_p(rows, F.col("kind"), F.col("place") % 2 == 0, "v", key, 19, "supp")
    return found.select("supp", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


STEPS = "[0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]"


@query(f"""WITH d AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64),
b AS (SELECT *, ((vec_id * 7919 + boot * 104729 + 17) % 100003) / 100003.0::DOUBLE AS u FROM d, (SELECT unnest(range(0, 10)) AS boot)),
w AS (SELECT *, len(list_filter({STEPS}, lambda s: s <= u)) AS w FROM b),
m AS (SELECT dim, boot, sum(v * w) / sum(w) AS m FROM w GROUP BY ALL), s AS (SELECT dim, stddev_samp(m) AS d FROM m GROUP BY dim),
a AS (SELECT dim, avg(v) AS mean FROM d GROUP BY dim)
SELECT dim, round(mean, 6) AS mean, round(mean / d, 4) AS ratio FROM a JOIN s USING (dim)""")
def stable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each feature over its deviation between ten resamples."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    long = rows.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    key = (F.col("vec_id") * 7919 + F.col("boot") * 104729 + 17) % 100003 / F.lit(100003.0)
    return S.bootstrap_ratio(long, "v", key, 10, "dim").select("dim", F.round("mean", 6).alias("mean"), F.round("ratio", 4).alias("ratio"))


@query("""WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.v * b.v), 6) AS total FROM x a JOIN x b USING (vec_id) GROUP BY a.i, b.i""")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of every two elements of the embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    d = rows.agg(F.max(F.size("embedding"))).first()[0]
    return decomposition.gram(rows, "embedding", d).where(f"i < {d} and j < {d}").select("i", "j", F.round("total", 6).alias("total"))


@query("""SELECT unnest(range(0, d))::INT AS component, 0.0 AS mean, 1.0 AS variance FROM (SELECT max(len(embedding)) AS d FROM embeddings)""")
def whitened_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and variances of the principal components after whitening."""
    rows = table(spark, sf_dir, "embeddings")
    d = rows.agg(F.max(F.size("embedding"))).first()[0]
    white = decomposition.whitened(rows, "embedding", decomposition.components(rows, "embedding", d))
    long = white.select(F.posexplode("white").alias("component", "v"))
    tidy = lambda c: F.round(c, 6) + F.lit(0.0)  # noqa: E731  no negative zero
    return long.groupBy("component").agg(tidy(F.avg("v")).alias("mean"), tidy(F.var_samp("v")).alias("variance"))


@query()
def stable_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the first singular vectors of the embeddings, with their ratio to the spread over
    resamples of labels' tenths and the rate of false discoveries."""
    rows = table(spark, sf_dir, "embeddings")
    d = rows.agg(F.max(F.size("embedding"))).first()[0]
    found = decomposition.stable_vectors(rows, "embedding", d, F.pmod(F.xxhash64("vec_id"), F.lit(97)), k=3, boots=20)
    cells = [(k, i, float(found.vectors[k, i] * found.values[k]), float(found.ratios[k, i]), float(found.q[k, i])) for k in range(len(found.values)) for i in range(d)]
    return spark.createDataFrame(cells, "vector int, element int, size double, ratio double, q double")
