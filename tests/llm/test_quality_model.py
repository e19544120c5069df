import random
import zlib

import numpy as np
import pytest

from pulsegrid.llm import quality_model as q


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "river", "stone", "walks", "evening", "is", "and", "market", "ébène", "straße"]
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        body = rng.choices(words, k=rng.randint(20, 120))
        if not good:
            body = rng.choice([[w.upper() + "!!" for w in body], [w + "***" for w in body], ["spam"] * len(body)])
        rows.append((i, " ".join(body), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, score double, _label string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 0), (900, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    truth = {i: y for i, _, y in rows}
    out = q.score(docs.withColumn("held_out", q.held_out(docs.doc_id)), model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # Without labels of the held-out fold the fit is the same, and scores are repeatable.
    fewer = labels.where(~q.held_out(labels.doc_id))
    assert np.allclose(q.train(docs, fewer)[0], model[0])


def test_scores_equal_the_mean_of_vectors(spark):
    rows = corpus(60)
    model = q.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = [None, "", " \n ", "one", "x" * 20000, "spam " * 5000] + [t for _, t, _ in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None)], "doc_id long, text string")
    out = q.score(df, model).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        buckets, share = q.document(texts[r.doc_id] or "")
        assert abs(r.score - 1 / (1 + np.exp(-(model[1] + share @ model[0][buckets])))) < 1e-9
    assert q.score(df.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.score(docs, q.train(docs, labels)).first().score == 0.5


def test_bound_on_rows(spark):
    rows = corpus(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    a, b = (q.train(docs.repartition(n), labels, rows=20) for n in (1, 5))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_sample_by_hand(spark, monkeypatch):
    """The fit reads what sorting, the fold and the bounds leave, and no text over the bound."""
    rows = [(i, t * (40 if i % 9 == 0 else 1), y) for i, t, y in corpus(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(500, 0), (7, 0), (600, 1)], "doc_id long, quality int")
    bound = 9000
    monkeypatch.setattr(q, "SAMPLE_BYTES", bound)
    seen = {}
    monkeypatch.setattr(q, "fit", lambda texts, ys: seen.update(texts=texts, ys=ys))
    q.train(docs, labels, rows=50)
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64('fit', doc_id) AS h").collect()}
    truth = {i: y for i, _, y in rows} | {500: 0}
    truth[7] = min(truth[7], 0)
    texts = {i: t for i, t, _ in rows} | {500: ""}
    named = sorted((i for i in truth if zlib.crc32(str(i).encode()) % 5), key=lambda i: (order[i], i))[:50]
    total, kept = 0, []
    for i in named:
        size = len(texts[i].encode())
        if size <= bound:
            total += size
            if total > bound:
                break
            kept.append(i)
    assert [t for t in seen["texts"]] == [texts[i] for i in kept] and seen["ys"] == [truth[i] for i in kept] and 5 < len(kept) < 50
    assert any(len(texts[i]) > bound for i in named)
    monkeypatch.setattr(q, "SAMPLE_BYTES", 3)
    with pytest.raises(ValueError):
        q.train(docs.where("doc_id <> 500"), labels)
