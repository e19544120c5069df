"""The language model against counts by hand, its own steps one by one, and finite differences."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language_model, queries, recurrent

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def corpus(many, seed=4):
    rng = random.Random(seed)
    tongues = [["the", "of", "And", "cat"], ["le", "de", "ET", "chat"]]
    rare = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(many):
        tongue = tongues[rng.random() < 0.5]
        words = [rng.choice(tongue) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.choice([3, 30, 80]))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), "x"))
    return [*rows, (many, None, "x"), (many + 1, "", "x"), (None, "the only one", "x"), (3, rows[3][1], "x")]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    flat = recurrent.initial(rng.uniform(1, 99, recurrent.HEAD), rng.uniform(1, 99, recurrent.CLASSES + recurrent.BANDS + 1), dtype=np.float64)
    flat += rng.normal(0, 0.1, flat.shape)
    ids, alive = rng.integers(0, recurrent.INPUTS, (6, 3)), np.ones((6, 3))
    alive[2, 1] = 0
    h = rng.normal(0, 1, (3, recurrent.HIDDEN))
    p = recurrent.parts(flat)
    loss = lambda: recurrent.window_gradient(p, ids, alive, h)[0]
    _, grads, _ = recurrent.window_gradient(p, ids, alive, h)
    for name in recurrent.SHAPES:
        for k in np.argsort(-np.abs(grads[name]).ravel())[[0, 5, 40]]:
            at = np.unravel_index(k, p[name].shape)
            kept, step = p[name][at], 1e-5
            p[name][at] = kept + step
            up = loss()
            p[name][at] = kept - step
            down = loss()
            p[name][at] = kept
            assert (up - down) / (2 * step) == pytest.approx(grads[name][at], abs=1e-4)


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    language_model.HOT_WORDS, kept = 60, language_model.HOT_WORDS  # so that some words are rare
    try:
        model = language_model.train(docs)
    finally:
        language_model.HOT_WORDS = kept
    found = language_model.score(docs, model).withColumn("held", language_model.held_out(F.col("doc_id"))).collect()
    return rows, model, found


def test_counts_and_base_score(learned):
    rows, model, found = learned
    counts = Counter(t for i, text, _ in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == len(rows) and 0 < len(model.lexicon.words) <= 60 < distinct
    for r in found:
        mine = tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(t in counts for t in mine), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in mine))
        assert r["held"] == held(r["doc_id"])


def share(model, counts, word, state):
    """Probability of a word in a state, by the definition."""
    known, p = model.lexicon, recurrent.parts(model.parameters.astype(np.float64))
    names = known.words.to_pylist()
    head = names[: known.head]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    classes = soft(state @ p["classes"][:-1] + p["classes"][-1])
    if word == "\n" or word in head:
        place = recurrent.HEAD - 1 if word == "\n" else head.index(word)
        k = place // recurrent.CLASS_WORDS
        return classes[k] * soft(state @ p["words"][k, :-1] + p["words"][k, -1])[place % recurrent.CLASS_WORDS], place
    band = lambda w: min(int(math.log2(counts[w])), recurrent.BANDS - 1)
    if word in names:
        mates = [w for w in names[known.head :] if band(w) == band(word)]
        return classes[recurrent.CLASSES + band(word)] * (counts[word] + 1) / sum(counts[w] + 1 for w in mates), recurrent.HEAD + band(word)
    rare = [w for w in counts if w not in names and w != "\n"]
    return classes[-1] * (counts[word] + 1) / (sum(counts[w] + 1 for w in rare) + 1), recurrent.RARE


def test_scores_equal_a_walk_word_by_word(learned):
    rows, model, found = learned
    counts = Counter(t for i, text, _ in rows if not held(i) for t in tokens(text))
    p = recurrent.parts(model.parameters.astype(np.float64))
    for r in [x for x in found if x["n_tokens"] in (1, 4, 31, 81)][:40]:
        state, total = np.zeros(recurrent.HIDDEN), 0.0
        for word in tokens(r["text"]):
            chance, place = share(model, counts, word, state)
            total += math.log10(chance)
            state = recurrent.step(p, np.array([place]), state[None])[0][0]
        assert r["score"] == pytest.approx(total, rel=1e-4)
    words = [*counts, "never seen"]
    assert sum(share(model, counts, w, np.full(recurrent.HIDDEN, 0.3))[0] for w in words) == pytest.approx(1, abs=1e-5)


def test_it_learns_what_counts_cannot_tell(learned):
    rows, _, found = learned
    apart = [r for r in found if r["held"] and r["n_tokens"] > 20]
    assert len(apart) > 20
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart) + 0.02 * sum(r["n_tokens"] for r in apart)


def test_columns_and_empty_tables(spark, learned):
    _, model, found = learned
    assert set(language_model.SCORES) < set(found[0].asDict()) and isinstance(found[0]["score"], float)  # the text column `score` gave way
    none = spark.createDataFrame([], SCHEMA)
    assert language_model.score(none, model).count() == 0
    untrained = language_model.train(none)
    row = language_model.score(spark.createDataFrame([(1, "a b", "")], SCHEMA), untrained).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(row["score"])


def test_query(spark, tmp_path):
    rows = corpus(60, seed=9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op12_language_model"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [t for _, t in found.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    counts = Counter(t for i, text, _ in rows if not held(i) for t in tokens(text))
    got = found.collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"]) for r in got) == sorted((i or -1, len(tokens(t)), sum(x in counts for x in tokens(t))) for i, t, _ in rows)


def test_words_are_counted_by_batches_of_text(spark, monkeypatch):
    """A task sends on the counts of each batch as they are, by Arrow alone; they add up."""
    monkeypatch.setattr(language_model, "READ_BYTES", 200)
    rows = corpus(40, seed=2)
    found = language_model.count_words(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert {r["word"]: r["c"] for r in found} == Counter(t for _, text, _ in rows for t in tokens(text))


def test_gates_and_states_at_their_ends():
    flat = recurrent.initial(np.ones(recurrent.HEAD), np.ones(recurrent.CLASSES + recurrent.BANDS + 1))
    p = recurrent.parts(flat)
    p["inputs"][:] = np.random.default_rng(5).choice([-500.0, 500.0], p["inputs"].shape)
    h = np.full((4, recurrent.HIDDEN), 0.5, np.float32)
    with np.errstate(all="raise", under="ignore"):
        found, _ = recurrent.step(p, np.arange(4), h)
    given = p["inputs"][:4] + h @ p["states"]
    keep, new = (np.sign(given[:, k * recurrent.HIDDEN : (k + 1) * recurrent.HIDDEN]) for k in (0, 2))
    np.testing.assert_allclose(found, np.where(keep > 0, h, new), atol=1e-6)


def test_text_logs_equal_steps_of_every_text(monkeypatch):
    """Steps are taken in spans of OUTPUT_ROWS, and no text is carried on behind its end."""
    rng = np.random.default_rng(7)
    flat = recurrent.initial(rng.uniform(1, 99, recurrent.HEAD), rng.uniform(1, 99, recurrent.CLASSES + recurrent.BANDS + 1))
    flat += rng.normal(0, 0.1, flat.shape).astype(np.float32)
    p = recurrent.parts(flat)
    lengths = np.array([1, 7, 300, 1, 40, 299, 2])
    ids = rng.integers(0, recurrent.INPUTS, lengths.sum())
    expected = []
    for begin, n in zip(np.cumsum(lengths) - lengths, lengths):
        h, total = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0
        for token in ids[begin : begin + n]:
            total += float(recurrent.log_shares(h, np.array([token]), p)[0])
            h = recurrent.step(p, np.array([token]), h)[0]
        expected.append(total)
    stepped, advance = [], recurrent.advance
    monkeypatch.setattr(recurrent, "advance", lambda given, *rest: stepped.append(given.shape[1]) or advance(given, *rest))
    for rows in (1, 64, 1 << 14):
        monkeypatch.setattr(recurrent, "OUTPUT_ROWS", rows)
        stepped.clear()
        assert recurrent.text_logs(flat, ids, lengths) == pytest.approx(expected, rel=1e-4)
        assert sum(stepped) == lengths.sum() - len(lengths)


def test_long_texts_are_scored_together(spark, learned, monkeypatch):
    """A long text in every batch costs its steps once, not once a batch; scores stay the same."""
    monkeypatch.setattr(language_model, "LONG_BYTES", 100)
    monkeypatch.setattr(language_model, "READ_BYTES", 2000)
    rng = random.Random(3)
    texts = [None if i % 9 == 0 else "the cat " * rng.choice([0, 1, 3, 30, 400]) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(language_model.by_length(iter([batch.slice(i, 10) for i in range(0, 60, 10)]), "text"))
    assert sorted((r["doc_id"], r["text"]) for p in parts for r in p.to_pylist()) == list(enumerate(texts))
    sizes = [[len(t or "") for t in p.column("text").to_pylist()] for p in parts]
    assert all(max(s) <= 100 or min(s) > 100 for s in sizes) and all(sum(s) <= 2000 or len(s) == 1 for s in sizes)
    assert len([s for s in sizes if max(s) <= 100]) == 6
    assert list(language_model.by_length(iter([batch.slice(0, 0)]), "text")) == []
    _, model, found = learned
    docs = spark.createDataFrame(learned[0], SCHEMA).repartition(3)
    again = language_model.score(docs, model, keep=["doc_id"]).collect()
    assert sorted(r["score"] for r in again) == pytest.approx(sorted(r["score"] for r in found), rel=1e-5)
