"""Near words, forms and roots against a comparison of every word with every other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import queries, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Whether exactly one inserted, deleted or replaced letter makes the words equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    """Rows of variant_groups by comparing all pairs."""
    close = {w: sorted((-m, v) for v, m in counts.items() if near(w, v)) for w in counts}
    form = {w: c[0][1] for w, c in close.items() if c and -c[0][0] >= 2 * counts[w]}
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(close[w]), counts[form[w]] if w in form else None))
    return rows


def vocabulary(rng, many, letters, lengths):
    words = set()
    while len(words) < many:
        words.add("".join(rng.choice(letters) for _ in range(rng.choice(lengths))))
    return {w: rng.choice([3, 3, 4, 6, 12, 25, 50, 100]) for w in words}


def test_block_search_equals_all_pairs():
    words = sorted(vocabulary(random.Random(3), 700, "abé", [5, 6]))
    codes, lengths = np.array(words).view(np.uint32).reshape(len(words), -1), np.array([len(w) for w in words])
    found = {(int(a), int(b)) for pairs in variants.near_pairs(codes, lengths, 5) for a, b in zip(*pairs)}
    assert found == {(i, j) for i, a in enumerate(words) if len(a) == 5 for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("group,letters,lengths", [(4096, "abé", [5, 6, 7, 8]), (3, "ab", [1, 2, 3, 4, 5, 6, 7, 9]), (8, "abcÿ", [11, 12, 13, 24])])
def test_groups_equal_all_pairs(spark, monkeypatch, group, letters, lengths):
    """With small bounds, keys are cut again and again."""
    monkeypatch.setattr(variants, "GROUP_WORDS", group)
    monkeypatch.setattr(variants, "BLOCK_LETTERS", 1 << 9)
    counts = vocabulary(random.Random(group), 260, letters, lengths)
    base = next(iter(sorted(counts, key=len, reverse=True)))
    counts |= {base[:i] + base[i + 1 :]: 200 for i in range(len(base))} | {base[:i] + "x" + base[i:]: 400 for i in range(len(base))}
    counts = {w: n for w, n in counts.items() if w}
    found = variants.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in found.collect()} == grouped(counts)


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbc": 192, "caaaa": 6, "zzzzz": 5, "zzzzy": 9}
    found = {r["word"]: r for r in variants.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert found["aaaaa"]["root"] == "bbbbc" and found["aaaaa"]["form"] == "aaaab"  # of two with six, the first
    assert found["zzzzz"]["form"] is None and found["zzzzz"]["n_near"] == 1
    assert {tuple(r) for r in found.values()} == grouped(counts)


def test_edge_cases(spark):
    rows = [("word", 2, 1), ("word", 1, 1), (None, 9, 1), ("wor", None, 1), ("", 3, 1), ("works", 6, 1), ("a" * 3000, 3, 1), ("a" * 2999 + "b", 6, 1)]
    found = variants.variant_groups(spark.createDataFrame(rows, "word string, n long, size int"))
    assert {tuple(r) for r in found.collect()} == grouped({"word": 3, "works": 6, "a" * 3000: 3, "a" * 2999 + "b": 6})
    assert variants.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def damaged_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(variants, "TABLE_ENTRIES", 50)
    rng = random.Random(8)
    pool = list(vocabulary(rng, 90, "abÀéÉ", [4, 5, 6]))
    rows = [(i, " ".join(rng.choice(pool).title() if rng.random() < 0.3 else rng.choice(pool) + rng.choice(["", ".", "9", "\n"]) for _ in range(90))) for i in range(90)]
    rows += [(900, None), (901, ""), (902, "42 !!"), (3, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op13_spelling_variants"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == grouped(damaged_counts(rows))
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
