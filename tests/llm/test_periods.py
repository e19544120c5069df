"""Runs of words against a search over all periods at all places."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.llm import periods, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def all_runs(words):
    """(start, length, period) by comparing every place with every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_up(rng, most):
    words, letters = [], rng.choice([1, 2, 3, 5, 50])
    while len(words) < rng.randint(0, most):
        root = [str(rng.randrange(letters)) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 63, 64, 65]))]
        if rng.random() < 0.3:  # a period that is nearly periodic itself
            root = (root[:5] * 20)[: len(root)]
        words += (root * 8)[: rng.randint(1, 6) * len(root) + rng.randint(0, len(root))] if rng.random() < 0.5 else root[:20]
    return words


def test_runs_equal_those_of_all_periods():
    rng = random.Random(5)
    for _ in range(150):
        docs = [made_up(rng, 600) for _ in range(rng.randint(1, 10))]
        runs, left = periods.runs_of(pa.array([" ".join(w) for w in docs]))
        for words, found, text in zip(docs, runs.to_pylist(), left.to_pylist(), strict=True):
            wanted = all_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in found] == wanted
            assert text == collapsed(words, wanted)


def test_a_period_one_short_of_twice_the_scale_with_periodic_context():
    root = ("aabcd" * 6 + "a")  # 31 words, of which 30 have period 5
    words = list("xy" + root * 4 + "z")
    runs, _ = periods.runs_of(pa.array([" ".join(words)]))
    assert [(r["start"], r["length"], r["period"]) for r in runs.to_pylist()[0]] == all_runs(words)
    assert (2, 124, 31) in all_runs(words)


def test_long_run_of_a_long_document():
    words = [str(i * i % 9973) for i in range(3000)] * 5
    runs, left = periods.runs_of(pa.array([" ".join(words), None, ""]))
    assert [[tuple(r.values()) for r in x] for x in runs.to_pylist()] == [[(0, 15000, 3000)], [], []]
    assert left.to_pylist() == [" ".join(words[:3000]), "", ""]


def test_edge_cases_of_the_operator(spark):
    schema = "doc_id long, text string, runs string, extra int"
    rows = [(1, None, "x", 1), (2, "", "x", 2), (None, "a " * 6, "x", 3), (3, " \t\n ", None, None), (4, "a b a b", "x", 4), (4, "a b a b", "x", 4)]
    found = periods.periodic_runs(spark.createDataFrame(rows, schema))
    assert found.columns == ["doc_id", "text", "extra", "runs", "collapsed"]
    got = sorted((r["extra"] or 0, len(r["runs"]), r["collapsed"]) for r in found.collect())
    assert got == [(0, 0, ""), (1, 0, ""), (2, 0, ""), (3, 1, "a"), (4, 0, "a b a b"), (4, 0, "a b a b")]
    assert periods.periodic_runs(spark.createDataFrame([], schema)).count() == 0


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(collapsed(words, runs)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(made_up(rng, 90)) if i % 7 else f"one  two\n{i} " * 9, "en", "web", 1) for i in range(120)] + [(500, None, None, None, None), (501, "", "", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op11_periodic_runs"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {expected(r[0], r[1]) for r in rows}
    assert dict(found.dtypes) | {"n_runs": "bigint", "start": "bigint", "exponent_milli": "bigint"} == dict(found.dtypes)
    assert found.where(F.col("n_runs") == 0).where("start is null and runs_sha256 is not null").count() == found.where("n_runs = 0").count()
