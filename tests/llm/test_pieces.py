import hashlib
import random

import pyarrow as pa
import pytest

from pulsegrid.llm import pieces, token_counts

EDGE = ["", None, " ", "  a", "a  b\nc \n d", "a\tb", "\n", "\n\nx", " \n ", "▁a ▁▁b", "<s> </s> <0x41>", "a ", "😀 x y", "x" * 5000, "\x00a", " " * 50 + "z", "tail\n"]


@pytest.fixture(scope="module")
def sp():
    return pieces.load(pieces.model_bytes())


def made_up(n, seed=5):
    rng = random.Random(seed)
    letters = ["the", "ing", " ", " ", "  ", "\n", "é", "ß", "A", "1", ".", "|", "😀", "▁", "\t", "er", "x9", "!!", "&&&"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


def test_chunks_cover_text_and_match_library(sp):
    table = pieces.ChunkTable(sp, list)
    for text in [t or "" for t in EDGE] + made_up(800):
        chunks = pieces.chunks_of(text)
        assert "".join(chunks) == (pieces.MARK + text.replace(" ", pieces.MARK) if text else "")
        known = table.of([chunks])
        assert [i for c in chunks for i in known[c]] == sp.encode(text)


def test_table_is_bounded_and_stays_right(sp, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 40)
    table = pieces.ChunkTable(sp, list)
    for text in made_up(200, seed=9):
        chunks = pieces.chunks_of(text)
        known = table.of([chunks])
        assert [i for c in chunks for i in known[c]] == sp.encode(text)
        assert len(table.known) <= 40 + len(chunks)


def test_long_chunks_are_not_kept(sp):
    table = pieces.ChunkTable(sp, list)
    for text in ["x" * 20_000, "short " + "y" * 900, "z" * 100_000 + " short"]:
        chunks = pieces.chunks_of(text)
        known = table.of([chunks])
        assert [i for c in chunks for i in known[c]] == sp.encode(text)
    table.of([["▁a"]])
    assert max(map(len, table.known)) <= pieces.KEPT_CHARS and "▁short" in table.known


def test_encode_decode_frame(spark, sp):
    rows = [(i, t, "clash", 7) for i, t in enumerate(EDGE + made_up(60))]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens long")
    out = pieces.encode_decode(df).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    for r in out:
        text = rows[r.doc_id][1] or ""
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_le == pieces.id_bytes(ids) and r.decoded == sp.decode(ids)
    assert pieces.encode_decode(df.limit(0)).count() == 0


def test_counts_frame(spark, sp):
    rows = [(i, t, True) for i, t in enumerate(EDGE + made_up(60) + ["word " * 5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, over_limit boolean")
    for r in token_counts.count_tokens(df).collect():
        text = rows[r.doc_id][1] or ""
        n = len(sp.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_whole_tokens_are_proven(sp):
    whole = token_counts.whole_tokens(sp)
    assert len(whole) > 10000 and len(set(whole)) == len(whole)
    assert all(len(sp.encode(p[1:])) == 1 for p in whole[::97])


def test_model_with_crossing_pieces_is_refused(sp):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

        def piece_to_id(self, p):
            return 0

        def encode(self, t):
            return [0, 1]

    with pytest.raises(ValueError):
        pieces.check_model(Crossing())


def test_op_digests(spark, sp, tmp_path):
    from pulsegrid.llm import queries

    rows = [(i, t) for i, t in enumerate(EDGE)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op1_sentencepiece(spark, str(tmp_path)).collect():
        ids = sp.encode(rows[r.doc_id][1] or "", add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(pa.array(ids, pa.uint32()).to_numpy().astype("<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
