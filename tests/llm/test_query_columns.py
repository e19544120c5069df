"""The thin queries on a small folder: their digests and columns from plain counterparts."""

import hashlib

import numpy as np
import pytest
from test_ann import brute as brute_nearest
from test_pii import brute as brute_pii
from test_pieces import made_up
from test_secret_scan import brute_spans, plain
from test_simhash import brute_components

from pulsegrid.llm import pieces, pii, queries

TEXTS = [None, "", "one", "A b c d e", "a B c d e", "mail a@b.co from 10.0.0.1 or +1 (386) 555-3733, card 4111 1111 1111 1111.", "user=alice aB3dE5fG7hJ9kL1mN3pQ5rS password=hunter22 " + "deadbeef" * 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    texts = TEXTS + made_up(60, 3) + ["word " * 5000, "spam " * 300]
    rows = [(i, t, "en", "src0", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "src0", 1), (None, texts[5], None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(5)
    vectors = [(i, rng.standard_normal(8).astype(np.float32).tolist(), 0) for i in range(120)] + [(150, None, 0), (200, [0.0] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, [r[:2] for r in rows], vectors


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def got(spark, folder, name):
    out = queries.queries()[name](spark, folder[0])
    return out.columns, sorted(map(tuple, out.collect()), key=str)


def test_op2(spark, folder):
    columns, mine = got(spark, folder, "op2_pii")
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    wanted = []
    for i, t in folder[1]:
        base = brute_pii(t)
        wanted.append((i, *(sum(k == kind for _, k, _ in base) for kind in range(4)), sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base))))
    assert [r[:6] for r in mine] == sorted(wanted, key=str)
    assert all(f"card:{TEXTS[5].index('4111')}:" in r[6] for r in mine if r[0] == 5)


def test_op3(spark, folder):
    columns, mine = got(spark, folder, "op3_quality")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(mine) == len(folder[1])
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for _, _, s, p in mine)


def test_op4(spark, folder):
    columns, mine = got(spark, folder, "op4_token_counts")
    assert columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    sp = pieces.load(pieces.model_bytes())
    wanted = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in folder[1]]
    assert mine == sorted(wanted, key=str) and any(w[3] for w in wanted)


def test_op7(spark, folder):
    columns, mine = got(spark, folder, "op7_simhash")
    assert columns == ["doc_id", "fingerprint", "component_id"]
    assert mine == sorted(((i, f"{fp:016x}", c) for i, fp, c in brute_components(folder[1])), key=str)


def test_op8(spark, folder):
    columns, mine = got(spark, folder, "op8_secret_scan")
    assert columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    wanted = []
    for i, t in folder[1]:
        base = plain(t or "")
        wanted.append((i, *(base.count(f"{k}:") for k in ("assign", "access", "hex")), sha(base), brute_spans(t or "")))
    assert mine == sorted(wanted, key=str)


def test_op10(spark, folder):
    columns, mine = got(spark, folder, "op10_nearest")
    assert columns == ["query_id", "rank", "vec_id", "score"]
    wanted = brute_nearest([v[:2] for v in folder[2]])
    assert sorted(r[:3] for r in mine) == sorted((q, n, i) for q, found in wanted.items() for n, (i, _) in enumerate(found, 1))
    scores = {(q, i): s for q, found in wanted.items() for i, s in found}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, _, i, s in mine)
