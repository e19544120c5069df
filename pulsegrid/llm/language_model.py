"""Log-likelihood of whole documents under a recurrent language model learned from the corpus.

Every word of the training documents is counted, and every training document is read by the
network once, in ROUNDS: in each, the tasks read their documents of that round from the same
parameters, and the parameters that they come to are averaged by tokens, block by block, on the
executors. The driver holds the parameters (some 150 KB) and the commonest words (HOT_WORDS
and HOT_BYTES at most), which go to the tasks; the counts of all other words stay a table,
joined to the documents that use them.

To score, a task reads its texts side by side with the state carried from first to last word,
and keeps of each text the words whose count it does not hold; those are counted by text,
joined with the table, and their part is added. The unsmoothed shares of rare words need no
network, so nothing else crosses the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import recurrent
from pulsegrid.llm.common import ship, slices, written
from pulsegrid.llm.periods import words_of

#: Stands for the end of a text: no word is a line feed.
END = "\n"
FOLDS, HELD_FOLD = 7, 2
ROUNDS = 3
#: Words whose counts every task holds: the commonest, by powers of 2 ** (1 / STEPS).
HOT_WORDS, HOT_WORD_BYTES, STEPS = 150_000, 64, 8
#: Bytes of text read together, whose words are counted before they are sent on.
READ_BYTES = 6 << 20
#: Texts over so many bytes are scored together: one that runs on alone costs a step for each word.
LONG_BYTES = 12 << 10
#: Parameters of a block that is averaged by itself.
BLOCK = 1 << 13
#: Groups of tasks whose parameters are averaged first.
SOME_TASKS = 128


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_FOLD by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts with A-Z lower-cased, and where each text's begin."""
    return words_of(pc.ascii_lower(texts))


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of all words of whole texts; each text has one END."""
    ship(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, READ_BYTES):
                counts = lower_words(part.column(text))[0].value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "c"])
                yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([part.num_rows], pa.int64())], names=["word", "c"])

    return df.select(text).mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What tasks know of the words: the hot ones, the commonest first, with their counts, and
    the sums over all others."""

    words: pa.Array
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int

    def __post_init__(self):
        self.head = min(recurrent.HEAD - 1, len(self.words))  # the last head word is END

    @cached_property
    def bands(self) -> np.ndarray:
        return np.minimum(np.log2(np.maximum(self.counts, 1)).astype(np.int64), recurrent.BANDS - 1)

    @cached_property
    def inputs(self) -> np.ndarray:
        """Input of each hot word."""
        places = np.arange(len(self.counts))
        return np.where(places < self.head, places, recurrent.HEAD + self.bands)

    @cached_property
    def rare_total(self) -> float:
        """Of the rare words: their tokens, their number, and one for the unseen."""
        return float(self.tokens - self.ends - self.counts.sum() + self.distinct - (self.ends > 0) - len(self.words) + 1)

    @cached_property
    def shares(self) -> np.ndarray:
        """Natural log of each hot word's share of its class, 0 for head words."""
        logs = np.log(self.counts + 1.0)
        totals = np.bincount(self.bands[self.head :], weights=self.counts[self.head :] + 1.0, minlength=recurrent.BANDS)
        logs[: self.head] = 0
        logs[self.head :] -= np.log(totals[self.bands[self.head :]])
        return logs

    def fresh(self) -> np.ndarray:
        head = np.zeros(recurrent.HEAD)
        head[: self.head], head[-1] = self.counts[: self.head], self.ends
        tail = np.bincount(self.bands[self.head :], weights=self.counts[self.head :], minlength=recurrent.BANDS)
        rare = self.tokens - head.sum() - tail.sum()
        return recurrent.initial(head, np.concatenate([head.reshape(recurrent.CLASSES, -1).sum(axis=1), tail, [rare]]))

    def read(self, texts: pa.Array):
        """(inputs of all tokens, ends included; tokens of each text; place of each word among the
        hot ones; words; which words are rare; where each text's begin)."""
        words, offsets = lower_words(texts)
        places = pc.index_in(words, value_set=self.words)
        rare = places.is_null().to_numpy(zero_copy_only=False)
        places = places.fill_null(0).to_numpy()
        inputs = np.where(rare, recurrent.RARE, self.inputs[places] if len(self.inputs) else 0)
        return np.insert(inputs, offsets[1:], recurrent.HEAD - 1), np.diff(offsets) + 1, places, words, rare, offsets


def lexicon(counts: DataFrame) -> Lexicon:
    """counts: a written table (word, c). The hot words are those above a count that no more
    than HOT_WORDS reach; very long words are never among them."""
    tokens, distinct, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    named = counts.where((F.col("word") != END) & (F.octet_length("word") <= HOT_WORD_BYTES)).withColumn("step", F.floor(F.log2("c") * STEPS))
    steps = named.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # some 8 for each power of two
    least, held = None, 0
    for row in steps:
        held += row["n"]
        if held > HOT_WORDS:
            break
        least = row["step"]
    found = named.where(F.col("step") >= least).select("word", "c").toPandas() if least is not None else None
    if found is None:
        return Lexicon(pa.array([], pa.string()), np.empty(0, np.int64), ends or 0, tokens or 0, distinct)
    found = found.sort_values(["c", "word"], ascending=[False, True])
    return Lexicon(pa.array(found["word"].tolist(), pa.string()), found["c"].to_numpy(np.int64), ends or 0, tokens, distinct)


@dataclass
class Model:
    lexicon: Lexicon
    counts: DataFrame
    parameters: np.ndarray


def _round(docs: DataFrame, text: str, words: Lexicon, parameters: np.ndarray) -> np.ndarray:
    """The parameters after all of these documents, averaged over tasks by tokens."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((words, parameters))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flat = shared.value
        learner = recurrent.Learner(flat)
        for batch in batches:
            for part in slices(batch, text, READ_BYTES):
                if part.num_rows:
                    learner.read(lexicon.read(part.column(text))[0], recurrent.HEAD - 1)
        if learner.tokens:
            blocks = [learner.flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([learner.tokens] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "tokens", "part"])

    def mean(parts: pa.Table) -> pa.Table:
        total, tokens = 0.0, 0
        for n, data in zip(parts.column("tokens").to_pylist(), parts.column("part").to_pylist()):
            total = total + np.frombuffer(data, np.float32).astype(np.float64) * n
            tokens += n
        data = pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())
        return pa.table({"block": parts.column("block")[:1], "tokens": pa.array([tokens], pa.int64()), "part": data})

    schema = "block int, tokens long, part binary"
    learned = docs.select(text).mapInArrow(learn, schema).withColumn("some", F.pmod(F.spark_partition_id(), F.lit(SOME_TASKS)))
    some = learned.groupBy("block", "some").applyInArrow(lambda parts: mean(parts.drop_columns(["some"])), schema)
    rows = some.groupBy("block").applyInArrow(mean, schema).collect()  # the parameters, once
    return np.frombuffer(b"".join(r["part"] for r in sorted(rows, key=lambda r: r["block"])), np.float32) if rows else parameters


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Model:
    """Count and learn from every document that is not held out, each read whole and once.
    Null texts count as empty; of no documents a model comes that finds every word unseen."""
    ship(df.sparkSession)
    docs = df.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    counts = written(count_words(docs, "text"), "word_counts")
    words = lexicon(counts)
    parameters = words.fresh()
    for k in range(rounds):
        turn = F.pmod(F.xxhash64(F.lit("round"), "_id", F.octet_length("text")), F.lit(rounds)) == k
        parameters = _round(docs.where(turn), "text", words, parameters)
    return Model(words, counts, parameters)


def by_length(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows in slices of READ_BYTES; those of long texts are held back, READ_BYTES and one
    batch's at most, and come in slices of their own."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        long = pc.greater(sizes, LONG_BYTES)
        yield from slices(batch.filter(pc.invert(long)), text, READ_BYTES)
        if more := pc.sum(sizes.filter(long)).as_py():
            held.append(batch.filter(long))
            size += more
        if size > READ_BYTES:
            yield from slices(pa.concat_batches(held), text, READ_BYTES)
            held, size = [], 0
    if held:
        yield from slices(pa.concat_batches(held), text, READ_BYTES)


SCORES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append to df, for each whole text: n_tokens (words and one end), n_known (tokens that
    training has), train_tokens (long), base_score (log10 by counts alone, one added to each
    and one for the unseen) and score (log10 by the model).

    A null text counts as empty: its end alone. Texts of any length are read from first to
    last word with the state carried. Equal rows get equal scores up to rounding; an empty
    table gives an empty one; columns of df named like a new one are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.lexicon, model.parameters))
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in SCORES]
    df = df.select(*carried, F.col(text).alias("_text"))
    rare_type = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("_rare", rare_type)]
    schema = T.StructType([*(df.schema[c] for c in carried), *(T.StructField(n, t) for n, t in new)])
    rare_arrow = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        hot_logs = np.log10(known.counts + 1.0)
        end_log = np.log10(known.ends + 1.0)
        for part in by_length(batches, "_text"):
            inputs, lengths, places, words, rare, offsets = known.read(part.column("_text"))
            texts = np.repeat(np.arange(len(lengths)), lengths - 1)
            by_text = lambda values: np.bincount(texts, weights=values, minlength=len(lengths))
            hot = ~rare
            n_known = by_text(hot).astype(np.int64) + (known.ends > 0)
            if len(known.counts):
                base, shares = by_text(np.where(rare, 0, hot_logs[places])), by_text(np.where(rare, 0, known.shares[places]))
            else:
                base = shares = np.zeros(len(lengths))
            shares -= np.log(known.rare_total) * by_text(rare)
            logs = recurrent.text_logs(flat, inputs, lengths) + shares
            # Rare words by text, each once with its number there.
            coded = words.filter(pa.array(rare)).dictionary_encode()
            pairs, n = np.unique(texts[rare] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
            text_of, word_of = np.divmod(pairs, max(1, len(coded.dictionary)))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(lengths)))])
            items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word_of)), pa.array(n, pa.int64())], fields=list(rare_arrow))
            arrays = [pa.array(lengths), pa.array(n_known), pa.array(base + end_log), pa.array(logs / np.log(10)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *arrays], names=[*carried, *(n for n, _ in new)])

    # The number of a row is fixed by writing it.
    first = written(df.mapInArrow(work, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    asked = first.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.n")
    found = asked.join(model.counts, "word")
    added = found.groupBy("_row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more"))
    both = first.drop("_rare").join(added, "_row", "left")
    more, words = F.coalesce("more", F.lit(0.0)), model.lexicon
    return both.select(
        *carried, "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more - F.col("n_tokens") * float(np.log10(words.tokens + words.distinct + 1.0))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
