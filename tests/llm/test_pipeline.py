"""Every stage of the pipeline against a brute-force version of its own input."""

import zlib

import corpus_pipeline as cp
import pytest
from test_mixing import brute as brute_mix
from test_near_copies import brute_kept
from test_quality_model import corpus
from test_secret_scan import KEY, MIXED

from pulsegrid.llm import mixing, pieces, quality_model, secret_scan

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t, _ in corpus(240)]
    good = [r for r, (_, _, y) in zip(rows, corpus(240)) if y]
    rows += [(1000 + k, good[k][1], "en", "src0", 5) for k in range(20)]  # exact copies
    rows += [(1100 + k, " ".join(reversed(good[k][1].split())) + f" password=secret{k}99 {KEY} {MIXED} the", None, None, None) for k in range(8)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (None, good[30][1] + " the river", "en", "src1", 3)]
    rows += [(2002, good[40][1] + " evening stone market evening", "en", "src2", 1)] * 2
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in corpus(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{folder}/{name}").collect())
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS

    given, kept = seen["quality classifier"]
    truth = {i: y for i, _, y in corpus(240)}
    labelled = sorted((r for r in given if r.doc_id in truth), key=lambda r: r.doc_id)
    right = [(r.doc_id in {k.doc_id for k in kept}) == bool(truth[r.doc_id]) for r in labelled if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.95 and set(kept) <= set(given)

    given, kept = seen["simhash near-dedup"]
    wanted, unnamed = brute_kept([(r.doc_id, r.text) for r in given])
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == wanted
    assert sum(r.doc_id is None for r in kept) == unnamed and set(kept) <= set(given)

    given, kept = seen["secret scans"]
    assert sorted(map(str, (r.doc_id for r in given))) == sorted(map(str, (r.doc_id for r in kept)))
    texts = {r.doc_id: r.text for r in given}
    masked = 0
    for r in kept:
        spans = sorted(secret_scan.base_spans(texts[r.doc_id] or ""))
        masked += bool(spans)
        if not spans:
            assert r.text == texts[r.doc_id]
        else:
            assert KEY not in r.text and MIXED not in r.text and "password=" not in r.text and cp.SECRET in r.text
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert masked

    given, kept = seen["mixing to target weights"]
    wanted = brute_mix([(r.doc_id, r.text, r.source) for r in given], mixing.WEIGHTS, mixing.SEED)
    assert sorted(((r.doc_id, r.text, r.source) for r in kept), key=str) == sorted((w[:3] for w in wanted), key=str)

    given, kept = seen["sentencepiece encoding"]
    sp = pieces.load(pieces.model_bytes())
    assert len(given) == len(kept)
    for r in kept:
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_le, r.decoded) == (len(ids), pieces.id_bytes(ids), sp.decode(ids))


def test_run_is_the_stages_in_turn(spark, folder):
    got = cp.run(spark, folder)
    assert got.columns == [*cp.COLUMNS, "n_tokens", "ids_le", "decoded"] and got.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "secret scans", "mixing to target weights", "sentencepiece encoding"]
    assert quality_model.THRESHOLD == 0.3
