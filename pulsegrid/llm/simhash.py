"""SimHash near-duplicates linked through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of its
segments' bit counts. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so near fingerprints are near in this grid. Of the two halves
of the vector (16 segments each) one is at distance 2 or less when the whole is at 4 or
less, and two lattice points at distance 2 share a lattice cell at distance 1 from both.
Each distinct fingerprint is therefore dealt to its own cell and the cells one step away, in
each half; fingerprints that meet in a cell are verified exactly. A cell's fingerprints are
searched by breadth first, so a cell yields a spanning forest, never all its pairs; cells
over BLOCK members are split into blocks whose pairs are separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import map_texts, written
from pulsegrid.llm.components import components

SHINGLE = 4
SEED = 42
#: Most differing bits of a link. The cells below are right for four or fewer.
NEAR = 4
#: Fingerprints of one cell that one task compares at once.
BLOCK = 4096
#: Cells with more fingerprints than this are searched one by one, smaller ones together.
SHORT = 8


def hash_shingles(text: str) -> list[int]:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE)))]


def fold(hashes: list[int]) -> int:
    """The fingerprint, as a signed 64-bit integer: bits set in over half the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append fp (long) to df; a null text counts as empty and has fingerprint zero."""

    def make():
        return lambda texts: [[fold(hash_shingles(t)) for t in texts]]

    return map_texts(df, make, [("fp", pa.int64(), T.LongType())], text, keep)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index into fps): each fingerprint's own cell and those one step away, by half.

    A cell is a long: the half in bit 32, sixteen two-bit counts below.
    """
    one = np.uint64(1)
    counts = fps - ((fps >> one) & np.uint64(0x5555555555555555))  # bit counts of each pair
    out, index = [], []
    everyone = np.arange(len(fps))
    for half in (0, 1):
        own = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        tag = np.int64(half) << np.int64(32)
        out.append(own | tag)
        index.append(everyone)
        for k in range(16):
            field = (own >> (2 * k)) & 3
            for step, able in ((1, field < 2), (-1, field > 0)):
                out.append((own[able] + step * (1 << (2 * k))) | tag)
                index.append(everyone[able])
    return np.concatenate(out), np.concatenate(index)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges between positions that connect whatever near links connect, and no more."""
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= NEAR
            if near.any():
                found = rest[near]
                edges += [(x, y) for y in found]
                reached += list(found)
                rest = rest[~near]
    return edges


LINKS = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("block", T.IntegerType())]
)


def _out(a, b, cell=None, block=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a, pa.int64()),
            pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
            pa.nulls(n, pa.int64()) if cell is None else pa.array(np.full(n, cell, np.int64)),
            pa.nulls(n, pa.int32()) if block is None else pa.array(np.full(n, block, np.int32)),
        ],
        names=LINKS.names,
    )


def _large(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    if edges := forest(fps.view(np.uint64)):
        at = np.array(edges)
        yield _out(fps[at[:, 0]], fps[at[:, 1]])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link the fingerprints of each cell; rows come sorted by cell. Holds BLOCK rows of a
    cell at most: of a larger cell every block is linked within itself and handed on."""
    held_cells, held, blocks = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for batch in batches:
        cell = np.concatenate([held_cells, batch.column("cell").to_numpy()])
        fp = np.concatenate([held, batch.column("fp").to_numpy()])
        last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        if last and blocks:  # the large cell has ended in this batch
            end = int(np.searchsorted(cell, cell[0], side="right"))
            yield from _large(fp[:end])
            yield _out(fp[:end], None, cell[0], blocks)
            cell, fp, last, blocks = cell[end:], fp[end:], last - end, 0
        yield from _finished(cell[:last], fp[:last])
        held_cells, held = cell[last:], fp[last:]
        while len(held) > BLOCK:
            yield from _large(held[:BLOCK])
            yield _out(held[:BLOCK], None, held_cells[0], blocks)
            held_cells, held, blocks = held_cells[BLOCK:], held[BLOCK:], blocks + 1
    if blocks and len(held):
        yield from _large(held)
        yield _out(held, None, held_cells[0], blocks)
    else:
        yield from _finished(held_cells, held)


def _finished(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within whole cells: short cells all at once, others one by one."""
    if len(cell) < 2:
        return
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    size_of = np.repeat(sizes, sizes)
    a, b = [], []
    few = (size_of > 1) & (size_of <= SHORT)
    c, f = cell[few], fp[few]
    for d in range(1, SHORT):
        if len(c) <= d:
            break
        near = (c[d:] == c[:-d]) & (np.bitwise_count(f[d:].view(np.uint64) ^ f[:-d].view(np.uint64)) <= NEAR)
        a.append(f[:-d][near])
        b.append(f[d:][near])
    for k in np.flatnonzero(sizes > SHORT):
        fps = fp[starts[k] : starts[k] + sizes[k]]
        if len(fps) > BLOCK:
            for i in range(0, len(fps), BLOCK):
                yield from _large(fps[i : i + BLOCK])
                yield _out(fps[i : i + BLOCK], None, cell[starts[k]], i // BLOCK)
        elif edges := forest(fps.view(np.uint64)):
            at = np.array(edges)
            a.append(fps[at[:, 0]])
            b.append(fps[at[:, 1]])
    if a and (pairs := np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)).size:
        yield _out(pairs[:, 0], pairs[:, 1])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link the two blocks of each pair; rows come sorted by pair."""
    held_pair, held = None, []
    for batch in batches:
        pairs = batch.column("pair").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy()
        cuts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else []
        for start, end in zip(cuts, [*cuts[1:], len(pairs)]):
            if pairs[start] != held_pair:
                if held:
                    yield from _large(np.concatenate(held))
                held_pair, held = pairs[start], []
            held.append(fps[start:end])
    if held:
        yield from _large(np.concatenate(held))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, long, each once) that connect
    exactly what links of NEAR bits or fewer connect."""
    key = T.StructType([T.StructField("cell", T.LongType()), T.StructField("fp", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for start in range(0, len(fps), 5000):
                part = fps[start : start + 5000]
                cell, at = cells(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[at])], names=key.names)

    dealt = distinct.select("fp").mapInArrow(deal, key)
    found = written(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_runs, LINKS), "links")
    near = found.where("b is not null").select("a", "b")
    large = found.where("block is not null").select(F.col("a").alias("fp"), "cell", "block")
    if not large.head(1):
        return near
    counts = large.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    spread = large.join(F.broadcast(counts), "cell") if counts.count() <= 100_000 else large.join(counts, "cell")
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    pair = F.format_string("%d:%d:%d", "cell", F.least("block", "other"), F.greatest("block", "other"))
    across = spread.select(pair.alias("pair"), "fp").repartition("pair").sortWithinPartitions("pair")
    return near.union(across.mapInArrow(_block_pairs, LINKS).select("a", "b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id_col, fp (long) and component_id, the smallest id among the
    rows whose fingerprints are reachable by links of four differing bits or fewer.

    Null and wordless texts have fingerprint zero and link like any other. Rows with a null
    id keep it and take part in links; they never give a component its id unless all of its
    ids are null. Repeated rows give repeated results; an empty table gives an empty one.
    """
    fps = written(fingerprints(df.select(id_col, text), text, [id_col]), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = written(components(links(classes)), "roots")
    reached = roots.select(F.col("node").alias("fp"), "root").union(roots.select("root", "root").distinct())
    least = reached.join(classes, "fp").groupBy("root").agg(F.min("least").alias("over_all"))
    over = reached.join(least, "root").select("fp", "over_all")
    named = classes.join(over, "fp", "left").select("fp", F.coalesce("over_all", "least").alias("component_id"))
    # Both sides written: their join is then a plain one, of which Spark can split a hot key.
    return fps.join(written(named, "named"), "fp").select(id_col, "fp", "component_id")
