"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted rate(s) times on average, rate(s) being the source's target
share of the corpus over its present share. Its count is drawn from a Poisson distribution
of that mean by inverting the distribution at a number that a seeded hash of its id gives,
so a rerun or a retried task draws the same. Each document is exploded by its count and
the copies are dealt out and sorted by a hash of their own: a global shuffle.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import hinted, written

#: Relative weights of the registered query; every other source weighs 1.
WEIGHTS = {"src0": 2.0}
SEED = 11
#: A larger mean is split into equal parts of at most this, each with a hash of its own
#: (a sum of Poisson counts is one again), so the inverse stays within TERMS terms.
PART_MEAN = 16.0
TERMS = 100
#: Sources whose rates are broadcast; with more the rates are joined as any table.
MOST_SOURCES = 10_000
#: Names of helper columns, taken from documents only if they clash.
RATE, COPY, ORDER = "mix_rate", "copy", "shuffle_key"


def rates(df: DataFrame, weights: dict[str, float], source: str = "source", text: str = "text") -> DataFrame:
    """(mix_source, mix_rate) per source: target share over present share, by code points.

    Every document weighs one code point more than its text, so that sources of empty texts
    have a share. A null source is a source of its own, of weight 1. Where all weights are
    zero no source has a rate; a negative weight is a ValueError.
    """
    if any(value < 0 for value in weights.values()):
        raise ValueError(f"weights must not be negative: {weights}")
    size = F.coalesce(F.length(text), F.lit(0)) + 1
    mass = df.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).cast("double").alias("mass"))
    weight = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(F.col("mix_source") == name, F.lit(float(value))).otherwise(weight)
    mass = written(mass.withColumn("weight", weight), "mix_mass")
    total = mass.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass")).otherwise(0.0)
    return mass.crossJoin(F.broadcast(total)).select("mix_source", rate.alias(RATE))  # total: one row


def cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, ... TERMS events."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["c"])


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the key."""
    digest = F.substring(F.md5(F.concat_ws(":", *key)), 1, 13)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(df: DataFrame, weights: dict[str, float], seed: int = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Rows of df, each as often as its draw says, with copy (int, from 1), mix_rate (double)
    and shuffle_key (string) appended, in the order of shuffle_key within partitions that
    shuffle_key deals out.

    Weights are relative target shares of code points. Rows with equal ids draw alike;
    a null id draws as the text "null". Null texts and sources are kept as they are. An empty
    table gives an empty one; columns of df named copy, mix_rate or shuffle_key are replaced.
    """
    df = df.drop(RATE, COPY, ORDER)
    # The columns go by numbers meanwhile: whatever their names, none clashes.
    names = {name: f"c{i}" for i, name in enumerate(df.columns)}
    df, id_col, source, text = df.toDF(*names.values()), names[id_col], names[source], names[text]
    wanted = written(rates(df, weights, source, text), "mix_rates")
    wanted = hinted(wanted, MOST_SOURCES)
    parts = F.greatest(F.lit(1), F.ceil(F.col(RATE) / PART_MEAN).cast("int"))
    wanted = wanted.withColumn("mix_parts", parts).withColumn("mix_curve", cumulative(F.col(RATE) / F.col("mix_parts")))
    drawn = df.join(wanted, df[source].eqNullSafe(wanted["mix_source"])).drop("mix_source")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    seed_text = F.lit(str(seed))

    def draw(acc: Column, part: Column) -> Column:
        at = uniform(seed_text, name, part.cast("string"))
        return acc + F.size(F.filter("mix_curve", lambda c: c <= at))

    count = F.aggregate(F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0), draw)
    drawn = drawn.withColumn("mix_count", count).drop("mix_curve", "mix_parts").where("mix_count > 0")
    copies = drawn.withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col("mix_count")))).drop("mix_count")
    copies = copies.withColumn(ORDER, F.md5(F.concat_ws(":", seed_text, F.lit("order"), name, F.col(COPY).cast("string"))))
    copies = copies.repartition(ORDER).sortWithinPartitions(ORDER)
    return copies.select(*(F.col(number).alias(name) for name, number in names.items()), RATE, COPY, ORDER)


#: The same in DuckDB, for documents and WEIGHTS. Terms of the curve are written out with
#: logarithms instead of one after another.
MIX_SQL = f"""
WITH mass AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS mass,
         CASE {" ".join(f"WHEN source = '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source),
rate AS (
  SELECT source, weight / sum(weight) OVER () * sum(mass) OVER () / mass AS mix_rate FROM mass),
curve AS (
  SELECT source, mix_rate, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT *, exp(-mix_rate / parts + k * ln(mix_rate / parts) - lgamma(k + 1)) AS p
        FROM (SELECT source, mix_rate, greatest(1, ceil(mix_rate / {PART_MEAN}))::INT AS parts FROM rate),
             range(0, {TERMS + 1}) AS r(k))),
curves AS (SELECT source, any_value(mix_rate) AS mix_rate, any_value(parts) AS parts, list(c) AS cs FROM curve GROUP BY source),
draws AS (
  SELECT d.doc_id, d.source, c.mix_rate, c.cs, unnest(range(1, c.parts + 1)) AS part
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN curves c ON d.source IS NOT DISTINCT FROM c.source),
counts AS (
  SELECT doc_id, source, any_value(mix_rate) AS mix_rate,
         sum(len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part), 1, 13))::BIGINT / {float(1 << 52)})))::INT AS n
  FROM draws GROUP BY doc_id, source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy,
       md5('{SEED}:order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.copy) AS shuffle_key
FROM documents d
JOIN (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM counts) c
  ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source
"""
