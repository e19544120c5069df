"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal) that holds its
period at least `EXPONENT` times and that no neighbouring word extends. At each dyadic scale
t a position is selected if, of the hashes of the t + 1 blocks of t words that start from it on,
the least is the first's or the last's: a choice that depends on the next 2t words alone, so
equal contexts make equal choices, and of t positions in a row one at least is selected. Two
selected positions with the same 2t words, one next to the other among their equals, propose
their distance. Of a run with t <= q < 2t two such positions lie q apart: one is among its
first t, its context and the same context q later lie inside the run, and no equal context
lies between, as the run would then have a smaller period.

Periods below SMALL are found apart, by comparing the words with themselves moved by q: they
are what the sets would propose at nearly every position. Positions inside a known run of a
period up to t/3 (3t words from them on) are left out of the set of scale t, which then has some
n/t positions however periodic the words are. Every proposal is extended word by word, so a
run is a fact and not a matter of hashes.

A slice of the batch is worked on as one sequence of word numbers with a number of its own
behind each document, so no run crosses documents; a document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import ship, slices

EXPONENT, SHORTEST = 4, 6
#: Periods below this are compared at every position; scales of the sets begin with it.
SMALL = 8
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
RUN = pa.struct([pa.field(n, pa.int64(), nullable=False) for n in ("start", "length", "period")])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and where each text's begin (and the end). Words
    are cut by spaces and the characters 9 to 13 alone; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), before[offsets - offsets[0]]


def stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last of each row of neighbours among sorted positions."""
    if not len(hits):
        return hits, hits
    cut = np.flatnonzero(np.diff(hits) > 1)
    return hits[np.concatenate([[0], cut + 1])], hits[np.concatenate([cut, [len(hits) - 1]])] + 1


def least_length(period: int) -> int:
    return max(SHORTEST, EXPONENT * period)


def extended(seq: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch [a, b) around `at` of positions that equal the one a period later."""
    end, step = at, 2 * period
    while True:
        same = seq[end : end + step][: max(0, len(seq) - period - end)] == seq[end + period : end + period + step]
        if not same.all() or len(same) < step:
            end += len(same) if same.all() else int(same.argmin())
            break
        end, step = end + step, 2 * step
    start, step = at, 2 * period
    while start:
        low = max(0, start - step)
        same = (seq[low:start] == seq[low + period : start + period])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = low, 2 * step
    return start, end


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def proposals(seq: np.ndarray, hashes: np.ndarray, scale: int, known: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs of one scale. hashes: of the blocks of `scale` words from each
    position on; known: runs (first, behind last, period) of smaller periods."""
    n = len(seq) - 2 * scale + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, width = hashes, 1
    while width < scale:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    first, last = hashes[:n], hashes[scale : scale + n]
    ends = np.minimum(first, last)
    chosen = np.minimum(low[:n], last) == ends
    for start, end, period in known:
        if 3 * period <= scale and end - start >= 3 * scale:
            chosen[start : end - 3 * scale + 1] = False
    at = np.flatnonzero(chosen)
    context = mixed(first[at]) + last[at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    apart = np.diff(at)
    hit = np.flatnonzero((context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale))
    return at[hit], apart[hit]


def find_runs(seq: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, behind last, period) of every run of a sequence made of documents of these
    lengths, each followed by a number that occurs once."""
    known: dict[tuple[int, int], int] = {}
    for q in range(1, SMALL):
        starts, ends = stretches(np.flatnonzero(seq[:-q] == seq[q:]))
        long = ends - starts + q >= least_length(q)
        for a, b in zip(starts[long].tolist(), (ends[long] + q).tolist()):
            known.setdefault((a, b), q)
    scale, place = 1, np.arange(len(seq))
    while True:
        keep = np.repeat(lengths >= EXPONENT * max(scale, SMALL), lengths + 1)
        if not keep.any():
            break
        if not keep.all():  # longer periods are sought in longer documents alone
            seq, place, lengths = seq[keep], place[keep], lengths[lengths >= EXPONENT * max(scale, SMALL)]
            hashes = None
        if scale < SMALL or hashes is None:
            hashes, width = mixed(seq.astype(np.uint64)), 1
            scale = max(scale, SMALL)
            while width < scale:
                hashes, width = mixed(hashes[:-width] * np.uint64(3) + hashes[width:]), 2 * width
        inside = []
        if known:  # known runs as places of the sequence that is left
            names = [(a, b, q) for (a, b), q in known.items() if 3 * q <= scale and b - a >= 3 * scale]
            at = np.searchsorted(place, [a for a, _, _ in names]) if names else []
            inside = [(int(p), int(p) + b - a, q) for p, (a, b, q) in zip(at, names)]
        ats, periods = proposals(seq, hashes, scale, inside)
        order = np.lexsort((ats, periods))
        done = (0, -1)
        for at, q in zip(ats[order].tolist(), periods[order].tolist()):
            if q == done[0] and at < done[1]:
                continue
            a, b = extended(seq, at, q)
            done = (q, b)
            if b - a + q >= least_length(q):
                known.setdefault((int(place[a]), int(place[a]) + b - a + q), q)
        if len(hashes) > scale:
            hashes = mixed(hashes[:-scale] * np.uint64(3) + hashes[scale:])
        scale *= 2
    return sorted((a, b, q) for (a, b), q in known.items())


def runs_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For each text its runs, by start and period, and its words but those that repeat a run's
    first period, joined by a space."""
    flat, offsets = words_of(texts)
    lengths = np.diff(offsets)
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    seq = np.insert(numbers, offsets[1:], -1 - np.arange(len(lengths)))
    begins = offsets[:-1] + np.arange(len(lengths))  # of the documents in seq
    found = find_runs(seq, lengths)
    dropped = np.zeros(len(seq) + 1, np.int64)
    owner = np.searchsorted(begins, [a for a, _, _ in found], "right") - 1 if found else np.empty(0, np.int64)
    for a, b, q in found:
        dropped[a + q] += 1
        dropped[b] -= 1
    kept = np.delete(np.cumsum(dropped)[:-1] == 0, offsets[1:] + np.arange(len(lengths)))
    before = np.concatenate([[0], np.cumsum(kept)])
    left = pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), flat.filter(pa.array(kept)))
    table = np.array(found, np.int64).reshape(-1, 3)
    parts = [table[:, 0] - begins[owner], table[:, 1] - table[:, 0], table[:, 2]]
    counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))])
    runs = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=list(RUN)))
    return runs, pc.binary_join(left, " ")


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append runs (array of start, length, period, in words from 0, by start and period) and
    collapsed (the words outside repetitions, joined by single spaces) to df.

    A null, empty or wordless text has no runs and collapses to "". Texts of any length are
    taken whole, each inside one task. Equal rows give equal results; an empty table gives an
    empty one; columns of df named like a new one are replaced. Two runs may overlap; a word is
    dropped if any run repeats it.
    """
    ship(df.sparkSession)
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("runs", "collapsed")]
    df = df.select(*dict.fromkeys([*carried, text]))
    schema = T.StructType([*(df.schema[c] for c in carried), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                runs, collapsed = runs_of(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), runs, collapsed], names=[*carried, "runs", "collapsed"])

    return df.mapInArrow(work, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length, of equals the first and then that of smallest period; null if
    there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["minus"]).alias("length"), best["period"].alias("period")))


def listed(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run, in their order."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


#: Planted repetition: one document in so many repeats a stretch of its words to its end.
PLANTED = 10


def planted(id_col: Column, text: Column) -> Column:
    """The text, in one document of ten with all words from some word on replaced by copies of
    the first few of them, which makes runs of long periods certain to occur. A null id plants
    nothing."""
    def let(value: Column, then) -> Column:
        """then(value), with the value worked out once for all the places that name it."""
        return F.element_at(F.transform(F.array(value), then), 1)

    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / PLANTED).cast("long")

    def drawn(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        return F.struct(words.alias("words"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8)).cast("long")).alias("p"))

    def copied(d: Column) -> Column:
        source = lambda i: F.when(i < d["a"], i).otherwise(d["a"] + (i - d["a"]) % d["p"])
        return F.array_join(F.transform(d["words"], lambda _, i: F.element_at(d["words"], (source(i.cast("long")) + 1).cast("int"))), " ")

    def repeated(words: Column) -> Column:
        return F.when(F.size(words) > 0, let(drawn(words), copied)).otherwise("")

    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.when((h % PLANTED == 0) & text.isNotNull(), let(words, repeated)).otherwise(text)
