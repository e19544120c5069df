"""Spelling variants: words of a vocabulary that differ by one letter, grouped under a form.

Two words are near if one inserted, deleted or replaced letter makes them equal. A block of
the vocabulary is held as bitsets over its words, one per position and letter. A query word
walks its letters once and carries, for all words of the block at a time, the set of those
equal so far, of those with one replaced letter, and of those with one letter more (whose
letters are looked up one position further); all queries of a block walk together. A word
with one letter less is met when it is the query itself.

Blocks are made so that near words meet. Let L be the length of the shorter of two near
words, P and S their common first and last letters: P + S >= L - 1. Of a window of free
letters, cut in thirds, one of three keys is common to both, chosen by P alone: the first two
thirds, the first and the last, or the last two. A word is dealt by these keys for L its own
length and one less; keys that too many words share are cut again inside their window. A
pair counts in the one group that its P leads to, so nothing is counted twice, and a block
sends on a count and a best neighbour for each word, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import hinted, ship, slices, written

LETTERS = re.compile("[a-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form occurs so many times as often as the variant, or more.
FORM_RATIO = 2
#: One run of letters in so many (by a hash with the document's id) loses a letter.
DAMAGE = 97
#: Words that may share a key before it is cut again, letters of a block, and queries of it
#: that walk together.
GROUP_WORDS, BLOCK_LETTERS, QUERIES = 4096, 1 << 16, 2048
#: Entries of a task's table of words before it is sent on.
TABLE_ENTRIES = 200_000


def damaged(run: str, start: int, every: int | None) -> str:
    """The run, less one letter where the checksum that goes on from `start` is a multiple of
    `every`."""
    if every is None:
        return run
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(df: DataFrame, damage: int | None = None, least_chars: int = LEAST_CHARS, least_n: int = LEAST_COUNT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the runs of Latin letters in whole texts, A-Z lower-cased, that have at
    least that many letters and occurrences. With `damage`, runs lose a letter by damaged()
    under the checksum of `id:run`. A null text has no words; a null id stands as "None".
    An empty table has none."""
    ship(df.sparkSession)
    df = df.select(id_col, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch, text):
                for name, value in zip(part.column(id_col).to_pylist(), part.column(text).to_pylist()):
                    start = zlib.crc32(f"{name}:".encode())
                    for run, n in Counter(LETTERS.findall((value or "").encode().lower().decode())).items():
                        word = damaged(run, start, damage)
                        if len(word) >= least_chars:
                            held[word] += n
                    if len(held) > TABLE_ENTRIES:
                        yield sent()
        yield sent()

    return df.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def cut(x, y, free):
    """The three windows inside one, as (letters before, letters behind), and where the first
    and second third end."""
    one, two = free // 3, 2 * free // 3
    return [(x + two, y), (x + one, y + free - two), (x, y + free - one)], one, two


def is_led_to(prefix: np.ndarray, size: int, x: np.ndarray, y: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether a pair with these common first letters (the shorter of `size`) is led to the
    window (x, y) at this depth."""
    a, b = np.zeros_like(prefix), np.zeros_like(prefix)
    for level in range(int(depth.max(initial=0))):
        free = size - a - b
        (first, second, third), one, two = cut(a, b, free)
        at = prefix - a
        moved = [np.where(at >= two, f, np.where(at >= one, s, t)) for f, s, t in zip(first, second, third)]
        a, b = np.where(level < depth, moved[0], a), np.where(level < depth, moved[1], b)
    return (a == x) & (b == y)


def near_pairs(codes: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of words of `size` letters and of near words of `size` or `size` + 1.
    codes: letters as numbers, a row for each word, filled up with zeros."""
    letters, coded = np.unique(codes[:, : size + 1], return_inverse=True)
    coded = coded.reshape(len(codes), -1)
    words = -(-len(codes) // 64)

    def bits(flags: np.ndarray) -> np.ndarray:
        """Flags over the words as bitsets, in the last dimension."""
        padded = np.zeros((*flags.shape[:-1], words * 64), bool)
        padded[..., : len(codes)] = flags
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    every = np.arange(len(letters))[:, None]
    index = [bits(coded[:, j] == every) for j in range(coded.shape[1])]
    if len(index) == size:  # no word is longer
        index.append(np.zeros_like(index[0]))
    same, longer = bits(lengths == size), bits(lengths == size + 1)
    queries = np.flatnonzero(lengths == size)
    for begin in range(0, len(queries), QUERIES):
        asked = queries[begin : begin + QUERIES]
        equal = np.full((len(asked), words), ~np.uint64(0))
        replaced, added = np.zeros_like(equal), equal.copy()
        for j in range(size):
            letter = coded[asked, j]
            here, next_ = index[j][letter], index[j + 1][letter]
            replaced &= here
            replaced |= equal & ~here
            equal &= here
            added &= next_
            added |= equal
        found = (replaced & same) | (added & longer)
        row, word = np.nonzero(found)
        hit, bit = np.nonzero(np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield asked[row[hit]], word[hit] * 64 + bit


def block_neighbours(words: list[str], n: np.ndarray, x: np.ndarray, y: np.ndarray, depth: np.ndarray, group: np.ndarray, size: int):
    """(place, near words, n of the best, place of the best) for the words of a block that
    have near words in their groups."""
    text = np.array(words)
    codes = text.view(np.uint32).reshape(len(words), -1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    firsts, seconds = [], []
    for a, b in near_pairs(codes, lengths, size):
        together = group[a] == group[b]
        a, b = a[together], b[together]
        unlike = codes[a, :size] != codes[b, :size]
        prefix = np.where(unlike.any(axis=1), unlike.argmax(axis=1), size)
        led = is_led_to(prefix, size, x[a], y[a], depth[a])
        a, b = a[led], b[led]
        back = lengths[b] > size  # of the others the mirrored pair is found too
        firsts += [a, b[back]]
        seconds += [b, a[back]]
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (firsts, seconds))
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(text, kind="stable")] = np.arange(len(words))  # by code points
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    place, first, count = np.unique(a, return_index=True, return_counts=True)
    return place, count, n[b[first]], b[first]


BLOCK_RESULT = "word string, n_near long, best_n long, best string"


def _blocks(words: DataFrame) -> DataFrame:
    """words (word, n) dealt into blocks: (word, n, size, x, y, depth, group, block)."""
    chars = F.char_length("word")
    sizes = F.explode(F.filter(F.array(chars, chars - 1), lambda c: c > 0))
    rows = words.select("word", "n", sizes.alias("size"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("depth"))
    parts = []
    while True:  # a window that is cut again gets shorter
        free = F.col("size") - F.col("x") - F.col("y")
        one, two = F.floor(free / 3).cast("int"), F.floor(2 * free / 3).cast("int")
        windows = [(F.col("x") + two, F.col("y")), (F.col("x") + one, F.col("y") + free - two), (F.col("x"), F.col("y") + free - one)]
        window = F.explode(F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in windows)))
        rows = rows.select("word", "n", "size", "depth", window.alias("w"))
        x, y = F.col("w.x"), F.col("w.y")
        name = F.xxhash64("size", x, y, F.substring("word", F.lit(1), x), F.substring("word", F.char_length("word") - y + 1, y))
        rows = rows.select("word", "n", "size", x.alias("x"), y.alias("y"), (F.col("depth") + 1).alias("depth"), name.alias("group"))
        # Windows of one letter cannot be cut; two of the three windows of a short one may be the same.
        rows = written(rows.dropDuplicates(["word", "group"]), "keys")
        crowded = rows.groupBy("group").agg(F.count("*").alias("held"), F.first(F.col("size") - F.col("x") - F.col("y")).alias("free"))
        crowded = written(crowded.where((F.col("held") > GROUP_WORDS) & (F.col("free") > 1)).select("group"), "crowded")
        if not crowded.head(1):
            parts.append(rows)
            break
        crowded = hinted(crowded, 100_000)
        parts.append(rows.join(crowded, "group", "left_anti").select(rows.columns))
        rows = rows.join(crowded, "group", "left_semi").select(rows.columns)
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)
    many = dealt.groupBy("size").agg(F.ceil(F.count("*") * F.greatest(F.col("size"), F.lit(16)) / BLOCK_LETTERS).alias("blocks"))
    return dealt.join(hinted(written(many, "sizes"), 100_000), "size").withColumn("block", F.pmod(F.xxhash64("group"), "blocks")).drop("blocks")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for each word that has near words, how many, and the one
    of largest n (of equals the first in code-point order). words: distinct (word, n)."""
    ship(words.sparkSession)

    def work(part: pa.Table) -> pa.Table:
        column = {c: part.column(c).to_numpy() for c in ("n", "x", "y", "depth", "group")}
        names = part.column("word").to_pylist()
        place, count, best_n, best = block_neighbours(names, *column.values(), size=part.column("size")[0].as_py())
        named = lambda places: pa.array([names[i] for i in places.tolist()], pa.string())
        return pa.table({"word": named(place), "n_near": count, "best_n": best_n, "best": named(best)})

    found = _blocks(words).groupBy("size", "block").applyInArrow(work, BLOCK_RESULT)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first"))
    return found.select("word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, by joining ever longer paths
    with themselves. A path only climbs, so it ends."""
    far = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = far.join(onward, "root", "left")
        moved = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        far = moved.drop("moved")
        if not moved.where("moved").head(1):
            return far


def variant_groups(words: DataFrame, ratio: float = FORM_RATIO, word: str = "word", n: str = "n") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of a table of words and counts.

    form is the near word of largest n (of equals the first in code-point order) if it has at
    least `ratio` times the word's n, else null; root is where forms lead to, the word itself
    if it has none. Words that come twice count together; null words and counts are left out;
    an empty table gives an empty one; other columns are not read. Words of any length and
    alphabet are compared whole.
    """
    tidy = words.where(F.col(word).isNotNull() & F.col(n).isNotNull() & (F.col(word) != "")).groupBy(F.col(word).alias("word")).agg(F.sum(n).cast("long").alias("n"))
    tidy = written(tidy, "words")
    found = written(tidy.join(neighbours(tidy), "word", "left"), "near")
    climbs: Column = F.col("best_n") >= ratio * F.col("n")
    found = found.select(
        "word", F.when(climbs, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(climbs, F.col("best_n")).alias("form_n")
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
