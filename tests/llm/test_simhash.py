import random

import numpy as np
import pytest
import xxhash

from pulsegrid.llm import simhash
from pulsegrid.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(rows[i][0])
    return [(rows[i][0], fps[i], min((x for x in groups[k] if x is not None), default=None)) for i, k in enumerate(label)]


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)] + ["The", "OF"]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 300))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        out.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return out


def test_against_brute_force(spark):
    special = [None, "", " \n\t ", "One two", "one TWO", "a b c", "a b c d", "x y z", "İ Ä", "word " * 3000]
    rows = [(1000 - i, t) for i, t in enumerate(special + texts(110, 3))]
    rows += [rows[3], rows[20], (None, rows[20][1])]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def clusters(seed, n=900):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, size=6, dtype=np.uint64)
    fps = {0, 2**64 - 1}
    for c in centres:
        for _ in range(n // 6):
            x = int(c)
            for b in rng.integers(0, 64, size=rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    return np.array(sorted(fps), dtype=np.uint64)


@pytest.mark.parametrize("block,short", [(4096, 8), (16, 8), (5, 2)])
def test_links_find_every_component(spark, monkeypatch, block, short):
    """Random clusters, with blocks small enough that cells split."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    fps = clusters(block)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for _ in range(len(fps)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long").repartition(3)
    # The workers import the module afresh, so the sizes are also tried in this process.
    cell, at = simhash.cells(fps)
    order = np.argsort(cell, kind="stable")
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(cell[o]), pa.array(signed[at[o]])], names=["cell", "fp"]) for o in np.array_split(order, 37)]
    out = pa.Table.from_batches(list(simhash._runs(iter(batches)))).to_pylist()
    edges = [(r["a"], r["b"]) for r in out if r["b"] is not None]
    large = [r for r in out if r["block"] is not None]
    rows = []
    for c in sorted({r["cell"] for r in large}):
        blocks = {}
        for r in large:
            if r["cell"] == c:
                blocks.setdefault(r["block"], []).append(r["a"])
        assert sorted(blocks) == list(range(len(blocks)))
        rows += [(f"{c}:{i}:{j}", x) for i in blocks for j in blocks if i < j for x in blocks[i] + blocks[j]]
    if block < 100:
        assert rows
    if rows:
        pairs = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["pair", "fp"])
        for b in simhash._block_pairs(iter([pairs.slice(0, 7), pairs.slice(7)])):
            edges += list(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    for found in (edges, [tuple(r) for r in simhash.links(df).collect()] if block == 4096 else edges):
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)
        parent = {int(x): int(x) for x in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            parent[root(a)] = root(b)
        mine = {int(x): root(int(x)) for x in signed}
        assert len({(int(k), mine[int(x)]) for k, x in zip(label, signed)}) == len(set(label.tolist())) == len(set(mine.values()))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    assert components(df.limit(0)).count() == 0
