"""Types of beat intervals from the intervals before them, for records of any length.

An interval is unknown, normal to normal, normal to premature, premature to normal or between
two premature beats. Its type follows from the last eight intervals and the types of the last
seven, and may put the one before right. Of those types an automaton's state keeps what later
steps can ask for: the last, which of the six before were normal, and where among these
the latest premature one is. Chunks of intervals are read from all states at once (states
that have met are followed together), and scan.entries() ties the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.scan import entries, written
from pulsegrid.sources.shared import ship

QQ, NN, NV, VN, VV = range(5)
KINDS = ("QQ", "NN", "NV", "VN", "VV")
CLASSES = ("N", "V", "Q")
NORMAL, PREMATURE, UNKNOWN = range(3)
#: Intervals that a type looks back to, itself included, and those typed QQ at a record's start.
BACK, LEARNING = 8, 3
#: States: type before, normal ones among the six before that, place of the latest premature.
NORMALS, PLACES = 64, 7
STATES = 5 * NORMALS * PLACES
FRESH = QQ * NORMALS * PLACES + PLACES - 1
#: Intervals of a chunk.
SIZE = 4096

_BITS = (np.arange(64)[:, None] >> np.arange(6)) & 1 == 1
#: The first four set bits of a mask, as weights over its six places; whether it has four.
_FOUR = _BITS & (np.cumsum(_BITS, axis=1) <= 4)
_HAS_FOUR = _FOUR.sum(axis=1) == 4
_FIRST = _BITS.argmax(axis=1)


def alike(a, b):
    """Within an eighth of their sum."""
    return np.abs(a - b) < ((a + b) >> 3)


def brief(a, b):
    """Less than three quarters."""
    return a < b - (b >> 2)


def early(now: np.ndarray, before: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Whether an interval is an eighth short of an even rhythm: of the six before it, the first
    four normal ones make the mean, from which no normal one is off by over a sixteenth.
    now: (chunks, 1); before: (chunks, 6); normal: masks (chunks, states)."""
    if normal.shape[1] > NORMALS:  # by mask, not by state
        return np.take_along_axis(early(now, before, np.tile(np.arange(NORMALS), (len(before), 1))), normal, axis=1)
    mean = np.einsum("cp,csp->cs", before, _FOUR[normal].astype(np.int64)) >> 2
    off = np.abs(mean[:, :, None] - before[:, None, :]) > (mean >> 4)[:, :, None]
    return _HAS_FOUR[normal] & ~(off & _BITS[normal]).any(axis=2) & (now < mean - (mean >> 3))


def advance(state: np.ndarray, w: np.ndarray, learning: np.ndarray, brady: int):
    """(type, class, bigeminy, next state), each (chunks, states), of one interval in each
    chunk. w: (chunks, 8), the interval and the seven before it, 0 where there is none;
    learning: (chunks, 1); brady: intervals this long and longer are too slow to call what
    follows premature."""
    last, normal, place = state // (NORMALS * PLACES), state // PLACES % NORMALS, state % PLACES
    v = [w[:, k : k + 1] for k in range(BACK)]
    same, short, slow = alike(v[0], v[1]), brief(v[0], v[1]), v[1] >= brady
    regular = same & alike(v[1], v[2]) & alike(v[2], v[3])
    pairs = np.logical_and.reduce([alike(v[k], v[k + 2]) & ~alike(v[k], v[k + 1]) for k in range(6)])
    third = short & alike(v[1], v[2]) & alike(2 * v[2], v[3] + v[4]) & alike(v[4], v[0]) & alike(v[5], v[2])
    longer = v[0] > v[1]
    # After two premature ones, a normal interval is the last one known or the mean of the latest two kinds.
    rows = np.arange(len(w))[:, None]
    first_normal = _FIRST[normal]
    usual = np.where(normal > 0, w[rows, 2 + first_normal], 0)
    is_usual = (normal > 0) & alike(v[0], usual)
    quick = np.where(place < PLACES - 1, w[rows, np.minimum(2 + place, BACK - 1)], 0)
    usual = np.where((usual == 0) & (quick != 0), (v[1] + quick) >> 1, usual)
    nearer = np.sign(np.abs(usual - v[0]) - np.abs(quick - v[0]))
    to_usual, to_quick = (quick != 0) & (nearer < 0) & alike(usual, v[0]), (quick != 0) & (nearer > 0) & alike(quick, v[0])
    early_after_normal = early(v[0], w[:, 1:7], (NN == last) | (normal << 1) & 63)
    early_before = early(v[1], w[:, 2:8], normal)
    known = normal & 1 == 1

    keep = np.full(state.shape, -1)
    by_last = {  # (when, type, class, type before put right), the first that holds
        QQ: [(regular, NN, NORMAL, -1), (pairs & ~longer & (v[0] != v[1]), NV, PREMATURE, VN), (pairs, VN, NORMAL, NV), (third, NV, PREMATURE, NN), (True, QQ, UNKNOWN, -1)],
        NN: [
            (early_after_normal & ~slow, NV, PREMATURE, -1), (early_after_normal, QQ, UNKNOWN, -1), (same, NN, NORMAL, -1), (short & alike(v[0], v[2]) & known, NN, NORMAL, -1),
            (short & ~slow, NV, PREMATURE, -1), (short, QQ, UNKNOWN, -1), (True, QQ, NORMAL, -1),
        ],
        NV: [(early_before & same, NN, NORMAL, NN), (~early_before & same, VV, PREMATURE, -1), (longer, VN, NORMAL, -1), (True, QQ, UNKNOWN, -1)],
        VN: [(is_usual, NN, NORMAL, -1), (to_usual, NN, NORMAL, -1), (to_quick, NV, PREMATURE, -1), (True, QQ, UNKNOWN, -1)],
        VV: [(same, VV, PREMATURE, -1), (short, QQ, UNKNOWN, -1), (True, VN, NORMAL, -1)],
    }
    kind, group, before = keep.copy(), keep.copy(), keep
    for name, rules in by_last.items():
        open_ = (last == name) & ~learning
        for when, k, c, b in rules:
            hit = open_ & when
            kind[hit], group[hit], before[hit] = k, c, b
            open_ = open_ & ~hit
    kind, group = np.where(learning, QQ, kind), np.where(learning, UNKNOWN, group)
    before = np.where((before < 0) | learning, last, before)
    flag = (last == QQ) & pairs & ~regular & ~learning
    normal = (normal << 1 | (before == NN)) & 63
    place = np.where(before == NV, 0, np.minimum(place + 1, PLACES - 1))
    return kind, group, flag, (kind * NORMALS + normal) * PLACES + place


def windows(rr: np.ndarray, t: int) -> np.ndarray:
    """The interval t of each chunk and the seven before. rr: (chunks, 7 + size)."""
    return rr[:, t : t + BACK][:, ::-1]


def maps(rr: np.ndarray, sizes: np.ndarray, starts: np.ndarray, brady: int) -> np.ndarray:
    """(chunks, STATES): the exit state of every entry state. starts: place in its record of
    each chunk's first interval."""
    chunks = len(rr)
    images = np.tile(np.arange(STATES), (chunks, 1))
    slots, due = images.copy(), 1
    for t in range(int(sizes.max(initial=0))):
        _, _, _, after = advance(images, windows(rr, t), starts[:, None] + t < LEARNING, brady)
        images = np.where((t < sizes)[:, None], after, images)
        if t + 1 == due:  # follow what has met as one
            found = [np.unique(row, return_inverse=True) for row in images]
            most = max(len(u) for u, _ in found)
            images = np.stack([np.pad(u, (0, most - len(u)), mode="edge") for u, _ in found])
            slots = np.stack([inverse[slot] for (_, inverse), slot in zip(found, slots)])
            due *= 2
    return np.take_along_axis(images, slots, axis=1)


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intervals with seven before, sizes, starts) of the chunks of a batch."""
    lists = batch.column("rr").to_pylist()
    starts = batch.column("start").to_numpy()
    halo = np.minimum(starts, BACK - 1)
    sizes = np.array([len(x) for x in lists], np.int64) - halo
    rr = np.zeros((len(lists), BACK - 1 + int(sizes.max(initial=0))), np.int64)
    for row, x, h, n in zip(rr, lists, halo, sizes):
        row[BACK - 1 - h : BACK - 1 + n] = x
    return rr, sizes, starts


def _chunks(intervals: DataFrame, size: int) -> DataFrame:
    """(record, chunk, start, rr): each chunk's intervals, up to seven of the one before ahead. A
    record's first chunk, whose entry state is known, has SIZE intervals or more."""
    head = -(-SIZE // size) * size
    of = lambda i: F.when(i < head, F.lit(0).cast("long")).otherwise(F.floor((i - head) / size) + 1)
    start = F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(head + (F.col("chunk") - 1) * size)
    home, later = of(F.col("i")), of(F.col("i") + BACK - 1)
    both = F.array_distinct(F.array(home, later))
    parts = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # steps take time, not bytes: not coalesced
    dealt = intervals.where("record is not null").select("record", "i", "rr", F.explode(both).alias("chunk"))
    rows = dealt.groupBy("record", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "rr"))).alias("rows"), F.max("i").alias("last"))
    rows = rows.where(of(F.col("last")) == F.col("chunk")).repartition(parts, F.xxhash64("record", "chunk"))  # not a halo alone
    return rows.select("record", "chunk", start.alias("start"), F.transform("rows", lambda r: r["rr"]).alias("rr"))


def rhythm_states(intervals: DataFrame, brady: int, size: int = SIZE) -> DataFrame:
    """(record, i, rr, kind, class, bigeminy) of intervals (record, i, rr): i is the place in
    its record, from 0 without gaps (scan.placed gives it), rr a whole number.

    kind is the type an interval gets as it comes; class is N, V (ends with a premature beat) or
    Q (unknown). The first three of a record are QQ. Null records are left out; an empty table
    gives an empty one. Work is dealt by chunks of `size` intervals, never by records.
    """
    if size < BACK:
        raise ValueError(f"a chunk has {BACK} intervals or more")
    ship(intervals.sparkSession)
    kind = intervals.schema["record"].dataType.simpleString()
    chunks = written(_chunks(intervals, size), "interval_chunks")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = maps(*_batch(part), brady)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * STATES, pa.int32()), pa.array(found.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("record"), part.column("chunk"), lists], names=["record", "chunk", "map"])

    # A record of one chunk is entered in the state of a fresh start; maps are for those of more.
    longer = chunks.where("chunk > 0").select("record").distinct()
    maps_of = chunks.join(longer, "record", "left_semi").select(*chunks.columns)
    entered = entries(written(maps_of.mapInArrow(summed, f"record {kind}, chunk long, map array<int>"), "interval_maps"), FRESH)
    first = chunks.where("chunk = 0").withColumn("entry", F.lit(FRESH))
    ready = first.unionByName(chunks.where("chunk > 0").join(entered, ["record", "chunk"]).select(*first.columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rr, sizes, starts = _batch(part)
                longest = np.argsort(-sizes, kind="stable")  # of which fewer and fewer go on
                part, rr, sizes, starts = part.take(pa.array(longest)), rr[longest], sizes[longest], starts[longest]
                state = part.column("entry").to_numpy().astype(np.int64)[:, None]
                steps = int(sizes.max(initial=0))
                out = np.empty((3, len(rr), steps), np.int64)
                for t in range(steps):
                    n = int((sizes > t).sum())
                    *found, state = advance(state[:n], windows(rr[:n], t), starts[:n, None] + t < LEARNING, brady)
                    for k, x in enumerate(found):
                        out[k, :n, t] = x[:, 0]
                live = np.arange(steps) < sizes[:, None]
                of, t = np.nonzero(live)
                kinds, groups, flags = (x[live] for x in out)
                arrays = [
                    part.column("record").take(pa.array(of)), pa.array(starts[of] + t), pa.array(rr[:, BACK - 1 :][live]), pa.array(np.array(KINDS)[kinds], pa.string()),
                    pa.array(np.array(CLASSES)[groups], pa.string()), pa.array(flags == 1),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["record", "i", "rr", "kind", "class", "bigeminy"])

    return ready.mapInArrow(read, f"record {kind}, i long, rr long, kind string, class string, bigeminy boolean")
