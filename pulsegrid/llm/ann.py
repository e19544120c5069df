"""Approximate nearest neighbours: an NN-descent graph and greedy search over it.

Distinct vectors are the nodes. A first graph comes from trees of random planes that halve
a sample at its medians, so tight groups are spread over many leaves; leaves are compared
within themselves, one over BLOCK in slabs along a direction of the tree's own. Then rounds of NN-descent: each node's neighbours and reverse neighbours
meet at the node (a join of the edges with the vectors), every pair of them that was not
together before is compared, and each node keeps its nearest. Rounds end when few edges
change. A query starts at its own node and walks the graph: its best unexpanded candidates
are joined with the graph, their neighbours are scored, and so on until the best of them
are all expanded. All survivors are scored exactly, in double precision.

The graph and the walk work on unit vectors of single precision; every row is a node of the graph.
`sim` is the negated squared distance of two unit vectors, which orders as the cosine does and
keeps its digits where near copies have cosines close to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import written

#: Neighbours of a node in the graph.
DEGREE = 24
TREES = 8
#: Nodes that a hyperplane leaf aims at, and the most that are compared with one another.
LEAF, BLOCK = 1500, 4096
#: Bytes of the sample that the trees are cut by, and its rows in a leaf at least.
SAMPLE_BYTES, LEAF_SAMPLE = 16 << 20, 16
#: Neighbours that a leaf hands on for a node.
LEAF_NEAREST = 12
#: Members of a node's meeting: those new to it first, in a hashed order.
MEETING = 56
ROUNDS = 8
#: Rounds end when a smaller share of the edges is new.
SETTLED = 0.02
#: Candidates that a query keeps, those that it expands in a hop, and the most hops.
BEAM, STRIDE, HOPS = 240, 48, 10
SEED = 17

EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("sim", T.FloatType())])


def valid(vector: Column) -> Column:
    """Not null or zero, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with one key, as arrays by column; rows come sorted by key. A run of more
    than `most` rows is cut."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        return {
            n: np.frombuffer(b"".join(table[n].to_pylist()), np.float32).reshape(table.num_rows, -1) if n == "q" else table[n].to_numpy()
            for n in table.column_names
        }

    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        for a, b in zip(cuts, np.r_[cuts[1:], len(keys)]):
            if held and keys[a] != last:
                yield out()
                held, size = [], 0
            last = keys[a]
            while a < b:
                take = min(b - a, most - size)
                held.append(batch.slice(a, take))
                a, size = a + take, size + take
                if size == most:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def edges_out(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim, pa.float32())], names=EDGE.names)


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Small results put together into batches."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            yield edges_out(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        yield edges_out(*(np.concatenate(x) for x in zip(*held)))


def units(nodes: DataFrame) -> DataFrame:
    """(id, q): unit vectors as bytes of single precision."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    made = nodes.select(F.col("node").alias("id"), "vector", norm.alias("norm"))
    made = made.select("id", F.transform("vector", lambda x: x / F.col("norm")).alias("unit"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("q", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("unit")
            flat = unit.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in flat.astype(np.float32)], pa.binary())], names=schema.names)

    return made.mapInArrow(run, schema)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The negated squared distance of every row of a to every row of b, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return 2 * (a @ b.T) - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)


def halved(sample: np.ndarray, normals: np.ndarray) -> list[np.ndarray]:
    """By level of a tree, the medians of the sample's projections in each of its parts."""
    leaf, cuts = np.zeros(len(sample), np.int64), []
    for level in range(normals.shape[1]):
        along = sample @ normals[:, level]
        order = np.lexsort((along, leaf))
        ends = np.searchsorted(leaf[order], np.arange((1 << level) + 1))
        cut = np.zeros(1 << level, np.float32)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        cut[full] = along[order[(ends[full] + ends[full + 1]) // 2]]
        leaf = leaf * 2 + (along > cut[leaf])
        cuts.append(cut)
    return cuts


def leaf_of(q: np.ndarray, normals: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    leaf = np.zeros(len(q), np.int64)
    for level, cut in enumerate(cuts):
        leaf = leaf * 2 + (q @ normals[:, level] > cut[leaf])
    return leaf


def first_graph(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """Edges from the leaves of random trees: a leaf's nodes are compared with one another."""
    part = max(1, int(np.ceil(n * 4 * dim / SAMPLE_BYTES)))
    taken = vectors.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(part)) == 0).select("q").toArrow()["q"].to_pylist()
    sample = np.frombuffer(b"".join(taken), np.float32).reshape(len(taken), dim)
    planes = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    planes = min(planes, int(np.log2(max(len(sample) / LEAF_SAMPLE, 1))))
    normals = np.random.default_rng(SEED).standard_normal((TREES, dim, planes + 1)).astype(np.float32)
    cuts = [halved(sample, normals[tree, :, :planes]) for tree in range(TREES)]
    dealt = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("along", T.FloatType()), T.StructField("id", T.LongType()), T.StructField("q", T.BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            for tree in range(TREES):
                leaf = leaf_of(q, normals[tree], cuts[tree]) * TREES + tree
                along = pa.array(q @ normals[tree, :, planes], pa.float32())
                yield pa.RecordBatch.from_arrays([pa.array(leaf), along, batch.column("id"), batch.column("q")], names=dealt.names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for g in sorted_groups(batches, "leaf", BLOCK):
                q, ids = g["q"], g["id"]
                k = min(LEAF_NEAREST, len(ids) - 1)
                if k < 1:
                    continue
                for start in range(0, len(ids), 512):
                    sims = closeness(q[start : start + 512], q)
                    at = np.arange(len(sims))
                    sims[at, start + at] = -np.inf
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield np.repeat(ids[start + at], k), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()

        return gathered(parts())

    leaves = vectors.mapInArrow(deal, dealt).repartition("leaf").sortWithinPartitions("leaf", "along", "id")
    return leaves.mapInArrow(near, EDGE)


def nearest(edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(u, v, sim, fresh): each node's nearest, pairs once; fresh unless an edge was old."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    w = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= degree).drop("n")


def descend(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """One round: candidate edges from the meetings at every node."""
    both = graph.select(F.col("u").alias("at"), F.col("v").alias("id"), "fresh")
    both = both.union(graph.select(F.col("v").alias("at"), F.col("u").alias("id"), "fresh"))
    w = W.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("at", "id"), "id")
    members = both.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
    members = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MEETING).drop("n")
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("held"))
    least = F.when(F.col("held") >= DEGREE, F.col("worst")).otherwise(F.lit(-5.0)).cast("float")
    known = vectors.join(worst, vectors["id"] == worst["u"], "left").select("id", "q", F.coalesce(least, F.lit(-5.0).cast("float")).alias("worst"))
    met = members.join(known, "id").repartition("at").sortWithinPartitions("at")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for g in sorted_groups(batches, "at", MEETING):
                q, ids, fresh = g["q"], g["id"], g["fresh"].astype(bool)
                sims = closeness(q, q)
                better = (sims > g["worst"][:, None]) & (fresh[:, None] | fresh)
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                if len(i):
                    yield ids[i], ids[j], sims[i, j]

        return gathered(parts())

    return met.select("at", "id", "fresh", "q", "worst").mapInArrow(meet, EDGE)


def build(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """The neighbour graph (u, v, sim, fresh) of all vectors."""
    graph = written(nearest(first_graph(vectors, n, dim).withColumn("fresh", F.lit(True))), "graph")
    for _ in range(ROUNDS):
        found = descend(graph, vectors).withColumn("fresh", F.lit(True))
        graph = written(nearest(graph.withColumn("fresh", F.lit(False)).unionByName(found)), "graph")
        total, fresh = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= SETTLED * total:
            break
    return graph


def scored(rows: DataFrame) -> DataFrame:
    """(s, node, sim) from rows (s, node, a, b): the closeness of two columns of vectors."""
    schema = T.StructType([T.StructField("s", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sim", T.FloatType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) for c in "ab")
                sim = -((a - b) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("node"), pa.array(sim, pa.float32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def walk(starts: DataFrame, graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """(s, node, sim): the best candidates of each start node s, by greedy search."""
    # Reverse edges too, of each node its nearest: a node may be near one that has nearer ones.
    near = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim").withColumn("n", F.row_number().over(near)).where(F.col("n") <= DEGREE)
    edges = written(graph.select("u", "v").union(back.select("u", "v")).distinct(), "walked")
    a = starts.join(vectors, starts["s"] == vectors["id"]).select("s", F.col("q").alias("a"))
    a = written(a, "starts")
    pool = a.select("s", F.col("s").alias("node"), F.lit(0.0).cast("float").alias("sim"), F.lit(False).alias("done"))
    by = W.partitionBy("s").orderBy(F.desc("sim"), "node")
    ahead = W.partitionBy("s", "done").orderBy(F.desc("sim"), "node")
    for _ in range(HOPS):
        pool = pool.withColumn("go", ~F.col("done") & (F.row_number().over(ahead) <= STRIDE))
        pool = written(pool, "pool")
        go = pool.where("go")
        if not go.head(1):
            break
        reached = go.join(edges, go["node"] == edges["u"]).select("s", F.col("v").alias("node")).distinct()
        reached = reached.join(pool.select("s", "node"), ["s", "node"], "left_anti")
        rows = reached.join(vectors, reached["node"] == vectors["id"]).select("s", "node", F.col("q").alias("b")).join(a, "s")
        new = scored(rows.select("s", "node", "a", "b")).withColumn("done", F.lit(False))
        old = pool.select("s", "node", "sim", (F.col("done") | F.col("go")).alias("done"))
        pool = old.unionByName(new).withColumn("n", F.row_number().over(by)).where(F.col("n") <= BEAM).drop("n")
    return pool.select("s", "node", "sim")


def cosine(a: Column, b: Column) -> Column:
    """In double precision, component by component in order."""
    add: Callable[[Column, Column], Column] = lambda acc, x: acc + x
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), add)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the column `queries` marks its k
    nearest other rows found, by cosine, ties to the smaller id.

    Rows with a null id or vector, a zero vector, or null or non-finite components take no
    part; nor do vectors of another length than most have (of equally common ones the
    longest). Equal vectors are one node of the graph, and stand for their k + 1 smallest
    ids. Rows that repeat an id with an equal vector count once. An empty table gives an
    empty one; with fewer than k other rows all are returned.
    """
    rows = df.where(valid(F.col(vector)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 1
    rows = rows.where(F.size("vector") == dim).dropDuplicates(["vec_id", "vector"])
    rows = written(rows, "vectors")
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    members = ranked.groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    members = written(members, "nodes")
    n = members.count()
    vectors = written(units(members), "units")
    graph = build(vectors, n, dim)
    asking = rows.where("asks").join(members, "vector").select(F.col("vec_id").alias("query_id"), "node")
    asking = written(asking, "asking")
    found = walk(asking.select(F.col("node").alias("s")).distinct(), graph, vectors)
    mine = members.select(F.col("node").alias("s"), F.col("vector").alias("a"))
    theirs = members.select("node", F.col("vector").alias("b"), "ids")
    exact = found.join(theirs, "node").join(mine, "s").select("s", cosine(F.col("a"), F.col("b")).alias("score"), F.explode("ids").alias("vec_id"))
    top = exact.withColumn("n", F.row_number().over(W.partitionBy("s").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    answers = asking.join(written(top, "answers"), asking["node"] == F.col("s")).where("query_id <> vec_id")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
