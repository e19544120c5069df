"""Series too long for one task: places without a window, and automata run as parallel scans.

An automaton reads a chunk from any state to some state, so a chunk is a map from entry
state to exit state. Maps of neighbouring chunks are composed, level by level, until one block
of a record's chunks is left; going down again gives each chunk the state that it is entered in, and all
chunks are then read at the same time, each from its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.sources.shared import shared_dir, ship

#: Chunks of a block: so many maps meet in one row.
FAN = 256


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, group: str, *order: str, name: str = "i") -> DataFrame:
    """df with the place (from 0) of each row in its group by `order`, without a task for a
    group: rows are sorted by range and written, so that the numbers that follow are of one
    reading; the sizes of the parts, one row each, give where a part starts."""
    sort = [group, *order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", (before - F.col("_low")).alias("_shift")))  # one row per partition
    whole = ranged.join(starts, "_part").withColumn("_at", F.col("_at") + F.col("_shift")).drop("_part", "_shift")
    firsts = whole.groupBy(group).agg(F.min("_at").alias("_first"))
    both = whole.join(firsts.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", "_group")


def entries(maps: DataFrame, first: int = 0) -> DataFrame:
    """(record, chunk, entry): the state in which each chunk is entered, the first of a record
    in `first`. maps: a written table (record, chunk, map), one row for each chunk that has
    something to read; map holds the exit state of every entry state."""
    most = maps.groupBy("record").count().agg(F.max("count")).first()[0]
    alone = most is None or most <= FAN
    blocks = maps.withColumn("block", F.lit(0).cast("long") if alone else F.floor(F.col("chunk") / FAN))
    lists = blocks.groupBy("record", "block").agg(F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("maps"))
    if alone:
        lists = lists.withColumn("entry", F.lit(first))
    else:
        step = lambda whole, m: F.transform(whole, lambda s: F.get(m["map"], s))
        rest = F.slice("maps", 2, F.size("maps"))
        composed = lists.select("record", F.col("block").alias("chunk"), F.aggregate(rest, F.element_at("maps", 1)["map"], step).alias("map"))
        above = entries(written(composed, "maps"), first)
        lists = lists.join(above.withColumnRenamed("chunk", "block"), ["record", "block"])
    walk = F.aggregate("maps", F.array("entry"), lambda seen, m: F.concat(seen, F.array(F.get(m["map"], F.element_at(seen, -1)))))
    pairs = F.arrays_zip(F.transform("maps", lambda m: m["chunk"]).alias("chunk"), F.slice(walk, F.lit(1), F.size("maps")).alias("entry"))
    return lists.select("record", F.explode(pairs).alias("p")).select("record", "p.chunk", "p.entry")


def with_halo(df: DataFrame, back: int, ahead: int, size: int, place: str = "i") -> DataFrame:
    """df dealt into chunks of `size` places, each with `back` rows before and `ahead` rows behind
    it: windows by (record, chunk) then see what windows by record would, in bounded groups.
    Filter on `own` afterwards; size is not below back or ahead."""
    if size < max(back, ahead):
        raise ValueError("a chunk is at least as long as what it looks at beside it")
    home = F.floor(F.col(place) / size)
    at = F.col(place) % size
    to = F.filter(F.array(F.when(at < ahead, home - 1), home, F.when(at >= size - back, home + 1)), lambda c: c.isNotNull())
    return df.withColumn("chunk", F.explode(to)).withColumn("own", F.col("chunk") == home)


def automaton(steps: DataFrame, table: list[list[int]], first: int = 0, size: int = 4096) -> DataFrame:
    """(record, i, state): the state before each step of a finite automaton. steps: (record, i,
    symbol), i without gaps from 0; table[symbol][state] is the state behind. Null records are
    left out; chunks of `size` steps are read at the same time."""
    ship(steps.sparkSession)
    moves = np.array(table, np.int32)
    kind = steps.schema["record"].dataType.simpleString()
    rows = steps.where("record is not null").groupBy("record", F.floor(F.col("i") / size).alias("chunk"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("i", "symbol"))).alias("rows"))
    chunks = written(rows.select("record", "chunk", F.col("rows.i").alias("i"), F.col("rows.symbol").alias("symbols")), "symbols")

    def summed(batches):
        for batch in batches:
            found = []
            for symbols in batch.column("symbols").to_pylist():
                image = np.arange(moves.shape[1])
                for s in symbols:
                    image = moves[s][image]
                found.append(image.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("record"), batch.column("chunk"), pa.array(found, pa.list_(pa.int32()))], names=["record", "chunk", "map"])

    entered = entries(written(chunks.mapInArrow(summed, f"record {kind}, chunk long, map array<int>"), "symbol_maps"), first)

    def read(batches):
        for batch in batches:
            of, places, states = [], [], []
            for k, (i, symbols, state) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "symbols", "entry")))):
                for place, s in zip(i, symbols):
                    of.append(k)
                    places.append(place)
                    states.append(state)
                    state = table[s][state]
            yield pa.RecordBatch.from_arrays([batch.column("record").take(pa.array(of, pa.int64())), pa.array(places, pa.int64()), pa.array(states, pa.int32())], names=["record", "i", "state"])

    return chunks.join(entered, ["record", "chunk"]).mapInArrow(read, f"record {kind}, i long, state int")
