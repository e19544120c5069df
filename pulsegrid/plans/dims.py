"""Labelled-array queries: `lineitem` as an array over supplier, month and line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import dims as D
from pulsegrid.plans.registry import query, table


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), month.alias("month"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("v"))


CUBE = "c AS (SELECT l_suppkey AS supp, year(l_shipdate) * 12 + month(l_shipdate) AS month, l_linenumber AS line, l_orderkey AS order_id, l_quantity AS v FROM lineitem)"


@query(f"""WITH {CUBE} SELECT supp, line, bool_and(v <> 0) AS "all", bool_or(v <> 0) AS "any", arg_min(order_id, (-v, order_id)) AS argmax, arg_min(order_id, (v, order_id)) AS argmin,
max(v) AS max, min(v) AS min, round(avg(v), 6) AS mean, round(sum(v), 6) AS sum, round(log10(product(v)), 4) AS log_prod, max(v) - min(v) AS ptp, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS var, count(v) AS n
FROM c GROUP BY supp, line""")
def dim_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.reduce(cube(spark, sf_dir), ["supp", "line"], "v", "order_id")
    found = found.withColumn("log_prod", F.round(F.log10("prod"), 4)).drop("prod")
    return found.withColumns({k: F.round(k, 6) for k in ("mean", "sum", "std", "var")})


@query(f"""WITH {CUBE} SELECT supp, CASE WHEN line < 3 THEN 'low' WHEN line < 6 THEN 'mid' ELSE 'high' END AS label, round(avg(v), 6) AS mean FROM c GROUP BY ALL""")
def bin_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = D.binned(F.col("line"), [(0, 3, "low"), (3, 6, "mid"), (6, 1e9, "high")])
    return cube(spark, sf_dir).groupBy("supp", label.alias("label")).agg(F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {CUBE}, d AS (SELECT month, floor((row_number() OVER (ORDER BY month) - 1) * 6 / count(*) OVER ())::BIGINT AS bin FROM (SELECT DISTINCT month FROM c))
SELECT line, bin, round(avg(v), 6) AS mean FROM c JOIN d USING (month) GROUP BY ALL""")
def bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six bins of equal counts of months."""
    return D.equal_bins(cube(spark, sf_dir), "month", 6).groupBy("line", "bin").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {CUBE} SELECT 'a' AS part, supp, order_id, line, v FROM c WHERE month % 2 = 0 UNION ALL SELECT 'b', supp, order_id, line, v FROM c WHERE line > 4""")
def extend_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube(spark, sf_dir)
    one = rows.where("month % 2 = 0").select(F.lit("a").alias("part"), "supp", "order_id", "line", "v")
    return D.extend(one, rows.where("line > 4").select("v", "line", "order_id", "supp", F.lit("b").alias("part")))


@query(f"WITH {CUBE} SELECT supp, order_id, line, v FROM c WHERE supp IN (1, 5, 9) AND ((line > 2) <> (v > 25))")
def select_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, and exclusive or of two conditions."""
    rows = D.select(cube(spark, sf_dir), "supp in (1, 5, 9)", ["supp", "month", "line", "order_id"])
    return rows.where((F.col("line") > 2) != (F.col("v") > 25)).select("supp", "order_id", "line", "v")


@query(f"WITH {CUBE} SELECT supp, freq, count(*) AS n, round(sum(v * freq), 6) AS total FROM c, (SELECT unnest([2, 4, 8]) AS freq) GROUP BY ALL")
def add_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.add_dim(cube(spark, sf_dir), "freq", [2, 4, 8])
    return rows.groupBy("supp", "freq").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("freq")), 6).alias("total"))


@query(f"""WITH {CUBE} SELECT supp, order_id, line, row_number() OVER (PARTITION BY supp ORDER BY v, order_id, line) - 1 AS place FROM c""")
def argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("supp").orderBy("v", "order_id", "line")
    return cube(spark, sf_dir).select("supp", "order_id", "line", (F.row_number().over(w) - 1).alias("place"))


#: Line numbers of an order.
LINES = range(1, 8)


@query(f"""WITH {CUBE} SELECT supp, month, {", ".join(f"round(sum(v) FILTER (line = {k}), 6) AS l{k}" for k in LINES)} FROM c GROUP BY supp, month""")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension turned into columns."""
    wide = cube(spark, sf_dir).groupBy("supp", "month").pivot("line", list(LINES)).agg(F.round(F.sum("v"), 6))
    return wide.select("supp", "month", *(F.col(str(k)).alias(f"l{k}") for k in LINES))


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_tax ** 2), 6) AS radius, round(atan2(l_tax, l_quantity), 6) AS angle, round(degrees(atan2(l_tax, l_quantity)), 6) AS deg FROM lineitem""")
def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.atan2("l_tax", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.hypot("l_quantity", "l_tax"), 6).alias("radius"), F.round(angle, 6).alias("angle"), F.round(F.degrees(angle), 6).alias("deg"))


PLACES = "m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT month FROM c))"


@query(f"""WITH {CUBE}, {PLACES} SELECT 'one' AS part, supp, 0 AS month, order_id, line, v FROM c JOIN m USING (month) WHERE place = 3
UNION ALL SELECT 'slice', supp, month, order_id, line, v FROM c JOIN m USING (month) WHERE place >= 2 AND place < total - 4 AND place % 5 = 2
UNION ALL SELECT 'list', supp, month, order_id, line, v FROM c JOIN m USING (month) WHERE place IN (0, 7, total - 1)""")
def dim_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month, every fifth of a range of months, and three months, by their places."""
    rows = cube(spark, sf_dir)
    parts = {"one": D.index(rows, month=3).withColumn("month", F.lit(0)), "slice": D.index(rows, month=slice(2, -4, 5)), "list": D.index(rows, month=[0, 7, -1])}
    columns = ["supp", "month", "order_id", "line", "v"]
    one, *rest = (df.select(F.lit(name).alias("part"), *columns) for name, df in parts.items())
    for df in rest:
        one = one.unionByName(df)
    return one


@query(f"""WITH {CUBE} SELECT supp, order_id, line, CASE WHEN supp < 4 AND line = 2 THEN -1.0 WHEN month % 12 = 3 THEN v * 2 ELSE v END AS v FROM c""")
def dim_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values set where coordinates are chosen."""
    rows = D.assign(cube(spark, sf_dir), F.col("month") % 12 == 3, "v", F.col("v") * 2)
    return D.assign(rows, (F.col("supp") < 4) & (F.col("line") == 2), "v", F.lit(-1.0)).select("supp", "order_id", "line", "v")


@query("""SELECT event_id, user_id, value * 2 AS twice, true AS no_offset, true AS no_note FROM events""")
def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of events added, of values and empty ones, and removed."""
    rows = D.add_fields(table(spark, sf_dir, "events"), twice=F.col("value") * 2, eoffset="long", note="string")
    rows = D.remove_fields(rows, "ts", "event_type", "value", "props")
    return rows.select("event_id", "user_id", "twice", F.isnull("eoffset").alias("no_offset"), F.isnull("note").alias("no_note"))


@query(f"""WITH {CUBE}, s AS (SELECT supp, line, sum(v) AS v FROM c GROUP BY ALL),
a AS (SELECT supp, row_number() OVER (ORDER BY supp) - 1 AS k FROM (SELECT DISTINCT supp FROM s)), b AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS k FROM (SELECT DISTINCT line FROM s))
SELECT k AS diagonal, round(v, 6) AS v, round(sum(v) OVER (), 6) AS trace FROM s JOIN a USING (supp) JOIN b USING (line, k)""")
def dim_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal and trace of suppliers against lines."""
    sums = cube(spark, sf_dir).groupBy("supp", "line").agg(F.sum("v").alias("v"))
    found = D.diagonal(sums, "supp", "line")
    total = found.agg(F.sum("v").alias("trace"))
    return found.crossJoin(F.broadcast(total)).select("diagonal", F.round("v", 6).alias("v"), F.round("trace", 6).alias("trace"))  # one row


@query(f"""WITH {CUBE}, {PLACES} SELECT line, (place >= 5)::INT + (place >= 20)::INT AS bin, round(median(v), 6) AS v FROM c JOIN m USING (month) GROUP BY ALL""")
def bin_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bins of months split at given places, each reduced by a function of one's own."""

    def middle(values: list, counts: list) -> float:
        half, seen, below = sum(counts), 0, None
        for v, n in zip(values, counts):
            seen += n
            if below is None and 2 * seen >= half:
                below = v
            if 2 * seen > half:
                return (below + v) / 2

    rows = D.split_bins(cube(spark, sf_dir), "month", [5, 20])
    return D.by_bin(rows, ["line", "bin"], "v", middle).withColumn("v", F.round("v", 6))


@query(f"""WITH {CUBE} SELECT supp, line, again, count(*) AS n, round(sum(v), 6) AS v FROM c, (SELECT unnest(range(0, 3)) AS again) WHERE line IN (1, 4) GROUP BY ALL""")
def dim_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines taken, everything three times over."""
    rows = D.repeat(D.index(cube(spark, sf_dir), line=[0, 3]), "line", 3)
    return rows.groupBy("supp", "line", F.col("again").cast("long").alias("again")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("v"))


GRID = "g AS (SELECT vec_id, unnest(range(0, len(embedding))) AS t, unnest(embedding)::DOUBLE AS v, dense_rank() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("t", "v"))


@query(f"""WITH {GRID}, n AS (SELECT max(t) + 1 AS n FROM g), f AS (SELECT p * n + t AS place, v FROM g, n) SELECT place // 32 AS a, place // 8 % 4 AS b, place % 8 AS c, v FROM f""")
def reshaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by element as an array of three dimensions."""
    return D.reshaped(grid(spark, sf_dir), ["vec_id", "t"], {"a": -1, "b": 4, "c": 8}).select("a", "b", "c", "v")


@query(f"""WITH {GRID}, n AS (SELECT max(p) + 1 AS n FROM g) SELECT t * n + p AS place, t AS vec_id, vec_id AS t, v FROM g, n WHERE t % 3 <> 1""")
def swapped_and_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three elements, dimensions changed about, and their places one behind the other."""
    rows = grid(spark, sf_dir)
    width = rows.agg(F.max("t") + 1).first()[0]
    whole = D.flattened(D.swapped(rows, "vec_id", "t"), ["vec_id", "t"])
    return D.compressed(whole, "vec_id", [k % 3 != 1 for k in range(width)]).select("place", "vec_id", "t", "v")
