"""Quality classifier from supervised subword embeddings.

Every word and its character n-grams hash to buckets, and so does the one word bigram that
needs no words to be known: a word and itself again. A document is the mean of its buckets'
vectors, and a softmax over two outputs says how likely label 1 is. The vectors and outputs
are learned by stochastic gradient descent in numpy on a bounded sample of labelled rows.
The mean is linear, so for scoring each bucket's vector is first multiplied out to one
number; a worker sums them once per distinct word of a bounded table, and the whole text of
every document is scored from its words' sums.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import map_texts, written

BUCKETS = 1 << 18
DIM = 16
GRAMS = (3, 4, 5)
EPOCHS = 4
RATE = 0.8
#: Most labelled rows that the fit reads, in the order of a hash of their id, and the most
#: bytes of their texts: the sample ends with the last row that is wholly within both. Texts
#: that alone have more bytes are passed over.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
THRESHOLD = 0.3
TABLE_ENTRIES = 150_000
KEPT_CHARS = 48


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, boundaries marked."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in (f" {word}", *grams)]


def repeats(words: list[str]) -> int:
    """Words that equal the word before them."""
    return sum(map(str.__eq__, words, words[1:]))


#: Bucket of the bigram of a word and itself.
REPEAT = zlib.crc32(b"\0again") % BUCKETS


def document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares; the shares sum to one."""
    counts: Counter[int] = Counter()
    words = text.split()
    for word, n in Counter(words).items():
        for bucket in features(word):
            counts[bucket] += n
    if again := repeats(words):
        counts[REPEAT] += again
    share = np.fromiter(counts.values(), np.float64, len(counts))
    return np.fromiter(counts.keys(), np.int64, len(counts)), share / max(share.sum(), 1)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn (number per bucket, offset): the log odds of label 1 are the offset plus the
    mean of the numbers of a text's buckets. The offset is the log odds of the sample, so that
    a text of unknown words is no likelier than the sample to be either."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    ones = sum(labels)
    outputs, offset = np.zeros((DIM, 2)), np.log([len(labels) - ones + 1.0, ones + 1.0])
    docs = [(*document(t), y) for t, y in zip(texts, labels, strict=True)]
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            buckets, share, y = docs[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[buckets]
            logits = mean @ outputs + offset
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[y] -= 1
            back = outputs @ wrong
            outputs -= rate * np.outer(mean, wrong)
            vectors[buckets] -= rate * share[:, None] * back * len(share) ** 0.5
    return vectors @ (outputs[:, 1] - outputs[:, 0]), float(offset[1] - offset[0])


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "quality"):
    """Fit on at most `rows` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids are left out; of an id labelled twice the smaller
    label counts. At most `rows` whole texts of SAMPLE_BYTES together reach the driver.
    ValueError if there are labelled documents and all of them are longer than that; without
    any, the model finds label 1 as likely as not.
    """
    named = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    named = named.groupBy(id_col).agg(F.min(label).alias("_label"))
    order = F.xxhash64(F.lit("fit"), id_col)
    named = named.join(documents.select(id_col), id_col, "left_semi")
    sample = written(named.orderBy(order, id_col).limit(rows), "label_sample")
    texts = documents.select(id_col, F.col(text).alias("_text")).join(F.broadcast(sample), id_col)  # `rows` ids
    by = [order, F.col(id_col), F.xxhash64("_text")]
    sizes = texts.select(id_col, F.octet_length("_text").alias("size"), "_text", "_label").where(F.coalesce("size", F.lit(0)) <= SAMPLE_BYTES).orderBy(*by).limit(rows)
    # One task, but over the sample's rows alone.
    sizes = sizes.withColumn("sum", F.sum(F.coalesce("size", F.lit(0))).over(W.partitionBy(F.lit(0)).orderBy(*by)))
    found = sizes.where(F.col("sum") <= SAMPLE_BYTES).orderBy(*by).select("_text", "_label").toPandas()
    if found.empty and sample.head(1):
        raise ValueError(f"every labelled text is longer than {SAMPLE_BYTES} bytes")
    return fit([t or "" for t in found["_text"]], [int(y) for y in found["_label"]])


def score(df: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (double, 0 to 1, higher: label 1 likelier) and predicted (int) to df.

    Null, empty and wordless texts get the score of the offset alone. Texts of any length
    count whole; repeated rows give repeated results; an empty table gives an empty one;
    columns of df named like a new one are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        numbers, offset = shared.value
        known: dict[str, complex] = {}
        repeat = complex(numbers[REPEAT], 1)

        def sums(words: list[str]) -> list[complex]:
            """Sum of each word's numbers, and how many there are as the imaginary part."""
            lists = [features(w) for w in words]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            values = numbers[np.fromiter((b for x in lists for b in x), np.int64, int(sizes.sum()))]
            totals = np.add.reduceat(values, np.cumsum(sizes) - sizes)
            return (totals + 1j * sizes).tolist()

        def work(texts: list[str]) -> list[list]:
            nonlocal known
            lists = [t.split() for t in texts]
            wanted = set().union(*lists)
            missing = list(wanted - known.keys())
            if len(known) + len(missing) > TABLE_ENTRIES:  # start anew with what is wanted now
                known = {word: known[word] for word in wanted & known.keys()}
            if missing:
                known.update(zip(missing, sums(missing), strict=True))
            totals = [sum(map(known.__getitem__, words), repeats(words) * repeat) for words in lists]
            for word in missing:  # long words are not kept, so the table is bounded in bytes too
                if len(word) > KEPT_CHARS:
                    del known[word]
            odds = [offset + (z.real / z.imag if z.imag else 0.0) for z in totals]
            return [(1 / (1 + np.exp(-np.clip(odds, -500, 500)))).tolist()]

        return work

    df = map_texts(df.drop("predicted"), make, [("score", pa.float64(), T.DoubleType())], text, keep)
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
