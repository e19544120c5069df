import pyarrow as pa

from pulsegrid.llm import common


def is_broadcast(df):
    return "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    df = common.written(spark.createDataFrame([(i, "x" * 100, [i]) for i in range(50)], "a long, b string, c array<long>"), "t")
    assert is_broadcast(common.hinted(df, 50)) and not is_broadcast(common.hinted(df, 49))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 50 * 100)
    assert not is_broadcast(common.hinted(df, 50))
    assert is_broadcast(common.hinted(df.limit(0), 0))


def test_slices_keep_every_row_in_order():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 50)] + [None, "z" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "i"])
    parts = list(common.slices(batch, "text", 60))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(len(texts))) and len(parts) >= 3
    assert list(common.slices(batch.slice(0, 0), "text")) == []
