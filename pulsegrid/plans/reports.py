"""Report queries: error logs, averages, merges, importances, rankings, lookups. A part of
`lineitem` stands for a sample, an order line for a test of it, its flag for the class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.plans.registry import query, table


def tests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("sample"), F.col("l_orderkey").alias("iter"), F.col("l_returnflag").alias("predicted"), F.col("l_linestatus").alias("run"), "l_discount", "l_tax")


def error_log(tests: DataFrame, truth: str, *by: str) -> DataFrame:
    """(by, tested, errors, error_rate, predict): predict is the commonest prediction, of
    equally common ones the smallest."""
    votes = tests.groupBy(*by, "predicted").agg(F.count("*").alias("n"))
    most = F.min_by("predicted", F.struct(-F.col("n"), F.col("predicted")))
    errors = F.sum(F.when(F.col("predicted") != truth, F.col("n")).otherwise(0))
    return votes.groupBy(*by).agg(F.sum("n").alias("tested"), errors.alias("errors"), F.round(errors / F.sum("n"), 6).alias("error_rate"), most.alias("predict"))


VOTES = "v AS (SELECT l_partkey AS sample, l_returnflag AS predicted, count(*) AS n FROM lineitem GROUP BY ALL)"
LOG = f"""{VOTES}, log AS (
  SELECT sample, sum(n)::BIGINT AS tested, coalesce(sum(n) FILTER (predicted <> 'N'), 0)::BIGINT AS errors,
         round(coalesce(sum(n) FILTER (predicted <> 'N'), 0) / sum(n), 6) AS error_rate FROM v GROUP BY sample),
best AS (SELECT sample, predicted AS predict FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, predicted) AS r FROM v) WHERE r = 1)"""


@query(f"WITH {LOG} SELECT sample, tested, errors, error_rate, predict FROM log JOIN best USING (sample)")
def error_log_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_log(tests_of(spark, sf_dir), "N", "sample")


@query(f"""WITH {LOG} SELECT sample, error_rate, row_number() OVER (ORDER BY error_rate DESC, sample) AS place FROM log WHERE error_rate > 0.5
  QUALIFY place <= 100""")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred samples of the highest error rate (a number, not its text)."""
    log = error_log(tests_of(spark, sf_dir), "N", "sample").where("error_rate > 0.5")
    top = log.orderBy(F.desc("error_rate"), "sample").limit(100)
    w = W.orderBy(F.desc("error_rate"), "sample")
    return top.select("sample", "error_rate", F.row_number().over(w).alias("place"))  # a hundred rows


@query("""SELECT l_partkey AS sample, coalesce(count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'N'), 0)::BIGINT AS errors_f,
  coalesce(count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'N'), 0)::BIGINT AS errors_o, count(*) AS tested FROM lineitem GROUP BY ALL""")
def error_log_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of errors for each run."""
    tests = tests_of(spark, sf_dir)
    wide = tests.groupBy("sample").pivot("run", ["F", "O"]).agg(F.count_if(F.col("predicted") != "N"))
    sizes = tests.groupBy("sample").agg(F.count("*").alias("tested"))
    return wide.join(sizes, "sample").select("sample", F.coalesce("F", F.lit(0)).alias("errors_f"), F.coalesce("O", F.lit(0)).alias("errors_o"), "tested")


@query("""WITH a AS (SELECT l_returnflag AS kind, avg(l_discount) AS se, avg(l_tax) AS sp, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT kind, n, printf('%.2f%%', se * 100) AS se, printf('%.2f%%', sp * 100) AS sp FROM a""")
def report_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column means as percentages."""
    percent = lambda c: F.format_string("%.2f%%", F.avg(c) * 100)
    return tests_of(spark, sf_dir).groupBy(F.col("predicted").alias("kind")).agg(F.count("*").alias("n"), percent("l_discount").alias("se"), percent("l_tax").alias("sp"))


@query("""WITH r AS (SELECT 1 AS file, l_orderkey AS iter, l_linenumber AS line, l_returnflag AS raw FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT 2, l_orderkey, l_linenumber, l_quantity::INT::VARCHAR FROM lineitem WHERE l_linestatus = 'O')
SELECT iter, count(*) AS n, round(avg(coalesce(try_cast(raw AS DOUBLE), 0)), 6) AS mean,
       round(max(file + line / 100.0), 6) AS latest FROM r GROUP BY iter""")
def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports put together; what is not a number counts as 0."""
    lines = table(spark, sf_dir, "lineitem")
    one = lines.where("l_linestatus = 'F'").select(F.lit(1).alias("file"), F.col("l_orderkey").alias("iter"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("raw"))
    two = lines.where("l_linestatus = 'O'").select(F.lit(2).alias("file"), F.col("l_orderkey").alias("iter"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").cast("string").alias("raw"))
    value = F.coalesce(F.col("raw").try_cast("double"), F.lit(0.0))
    return one.unionByName(two).groupBy("iter").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(F.col("file") + F.col("line") / 100), 6).alias("latest"))


def importance(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, feature, coef, place): mean of the rows' unit vectors, by size of the mean."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v))
    long = rows.withColumn("norm", norm).where("norm > 0").select(label, "norm", F.posexplode(vector).alias("feature", "v"))
    means = long.groupBy(label, "feature").agg(F.avg(F.col("v").cast("double") / F.col("norm")).alias("coef"))
    w = W.partitionBy(label).orderBy(F.desc(F.abs("coef")), "feature")
    return means.select(label, "feature", F.round("coef", 6).alias("coef"), F.row_number().over(w).alias("place"))


@query("""WITH n AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS feature, unnest(embedding)::DOUBLE AS v, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS norm FROM embeddings),
m AS (SELECT label, feature, avg(v / norm) AS coef FROM n WHERE norm > 0 GROUP BY ALL)
SELECT label, feature, round(coef, 6) AS coef, row_number() OVER (PARTITION BY label ORDER BY abs(coef) DESC, feature) AS place FROM m""")
def coef_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query("""WITH d AS (SELECT label, unnest(range(0, 64)) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64),
t AS (SELECT feature, sum(v) AS s, count(*) AS n FROM d GROUP BY feature), c AS (SELECT label, feature, sum(v) AS s, count(*) AS n FROM d GROUP BY label, feature),
w AS (SELECT label, feature, abs(c.s / c.n - (t.s - c.s) / (t.n - c.n)) AS weight FROM c JOIN t USING (feature) WHERE t.n > c.n),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, feature) AS place FROM w)
SELECT label, feature, CASE WHEN place <= 16 THEN 1 ELSE place - 15 END AS rank FROM k""")
def elimination_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features go in the order of how little they tell a class from the rest, until sixteen
    are left: survivors rank 1, the last to go 2, and so on."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    long = rows.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "v"))
    sums = long.groupBy("label", "feature").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = W.partitionBy("feature")
    rest = (F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0))
    told = sums.select("label", "feature", F.abs(F.col("s") / F.col("n") - rest).alias("weight")).where("weight is not null")
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("weight"), "feature"))
    return told.select("label", "feature", F.greatest(F.lit(1), place - 15).alias("rank"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as tab-separated text with a header, and read again."""
    from pulsegrid.sources import reports
    from pulsegrid.sources.shared import shared_dir

    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    path = shared_dir(spark, "report")
    reports.write(found, path)
    return reports.read(spark, path, found.schema)


HOST = r"^[a-z]+://([^/:?#]+)"


@query(f"SELECT regexp_extract(url, '{HOST}', 1) AS venue, count(*) AS n FROM pages GROUP BY 1")
def venue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", HOST, 1).alias("venue")).agg(F.count("*").alias("n"))


def closest(value: Column, names: list[str]) -> Column:
    """The name at the smallest edit distance; of equally near ones the first in order."""
    return F.array_min(F.array(*(F.struct(F.levenshtein(value, F.lit(n)).alias("far"), F.lit(n).alias("name")) for n in names)))["name"]


COLOURS = ["almond", "azure", "black", "forest", "ivory", "lime", "navy", "rose"]  # a fixed list of venues


@query(f"""SELECT p_partkey, (SELECT n FROM (SELECT unnest({COLOURS}) AS n) ORDER BY levenshtein(lower(p_name), n), n LIMIT 1) AS nearest FROM part""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", closest(F.lower("p_name"), COLOURS).alias("nearest"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, hash_key FROM (
  SELECT *, (o_orderkey * 31) % 97 AS hash_key FROM orders)""")
def column_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values of some columns laid over old rows by key."""
    from pulsegrid.operators.store import upsert

    orders = table(spark, sf_dir, "orders").withColumn("hash_key", F.col("o_orderkey") * 31 % 97)
    old = orders.select("o_orderkey", "o_custkey", F.lit("open").alias("state"), "hash_key")
    new = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("done").alias("state"))
    return upsert(old, new, ["o_orderkey"])


@query("""WITH a AS (SELECT l_partkey AS sample, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS e FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
b AS (SELECT l_partkey AS sample, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS e FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT sample, coalesce(a.n, 0) + coalesce(b.n, 0) AS tested, coalesce(a.e, 0) + coalesce(b.e, 0) AS errors,
       round((coalesce(a.e, 0) + coalesce(b.e, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 6) AS error_rate FROM a FULL JOIN b USING (sample)""")
def error_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of several runs put together by sample, not by place in the file."""
    tests = tests_of(spark, sf_dir)
    logs = [error_log(tests.where(F.col("run") == run), "N", "sample") for run in ("F", "O")]
    both = logs[0].unionByName(logs[1]).groupBy("sample").agg(F.sum("tested").alias("tested"), F.sum("errors").alias("errors"))
    return both.withColumn("error_rate", F.round(F.col("errors") / F.col("tested"), 6))


@query("""SELECT l_partkey AS sample, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (starts_with(l_shipdate::VARCHAR, '1995') OR starts_with(l_shipdate::VARCHAR, '1996'))
AND try_cast(l_tax::VARCHAR AS DOUBLE) > 0.04 GROUP BY 1""")
def error_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, prefix and rate filters; a rate that is no number drops its row."""
    rows = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("string")
    kept = rows.where(F.col("l_returnflag").isin("A", "R") & (day.startswith("1995") | day.startswith("1996")) & (F.col("l_tax").cast("string").try_cast("double") > 0.04))
    return kept.groupBy(F.col("l_partkey").alias("sample")).agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT regexp_extract(url, '{HOST}', 1) AS venue, page_id FROM pages), c AS (SELECT venue, count(*) AS freq FROM v GROUP BY venue)
SELECT DISTINCT page_id, venue, freq FROM v JOIN c USING (venue)""")
def venue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with what a dimension says of them, each once."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("venue"))
    return pages.join(pages.groupBy("venue").agg(F.count("*").alias("freq")), "venue").select("page_id", "venue", "freq").distinct()


@query("""WITH t AS (SELECT l_partkey AS sample, l_linenumber AS line, min(l_returnflag) AS p FROM lineitem GROUP BY ALL)
SELECT sample, """ + ", ".join(f"coalesce(max(p) FILTER (line = {k}), 'N/A') AS line{k}" for k in range(1, 8)) + " FROM t GROUP BY sample")
def error_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of what was predicted for each sample in each run (here: line number), a column for
    each, written as text and read again."""
    from pulsegrid.sources import reports
    from pulsegrid.sources.shared import shared_dir

    log = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sample"), F.concat(F.lit("line"), F.col("l_linenumber")).alias("run")).agg(F.min("l_returnflag").alias("p"))
    path = shared_dir(spark, "log")
    wide = reports.wide(log, ["sample"], "run", "p", [f"line{k}" for k in range(1, 8)])
    reports.write(wide, path, sep=",")
    return reports.read(spark, path, wide.schema, sep=",")


@query("""WITH r AS (SELECT o_orderpriority AS kind, count(*) AS n, avg(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT kind, n::DOUBLE AS n, round(price, 4) AS price FROM r UNION ALL SELECT 'average', avg(n), round(avg(price), 4) FROM r""")
def report_with_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report and the row of its means."""
    from pulsegrid.sources import reports

    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("price"))
    return reports.with_average(rows, "kind", ["n", "price"]).select("kind", "n", F.round("price", 4).alias("price"))
