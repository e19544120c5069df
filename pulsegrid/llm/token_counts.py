"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string is encoded alone; those that come back as
one token are proven whole tokens. A pre-token (a marked chunk, see pieces.py) that equals
one of them counts as one; only the others are merged by the library, once per distinct
chunk of a worker's bounded table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import map_texts
from pulsegrid.llm.pieces import MARK, ChunkTable, check_model, chunks_of, load, model_bytes


def whole_tokens(sp) -> list[str]:
    """Vocabulary strings that start with one marker and encode alone as that one token."""
    strings = [(i, p) for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size()))) if p[0] == MARK and len(p) > 1]
    coded = sp.encode([p[1:] for _, p in strings], num_threads=1)
    return [p for (i, p), ids in zip(strings, coded, strict=True) if ids == [i]]


def count_tokens(df: DataFrame, model: bytes | None = None, limit: int = 4096, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes, n_tokens (long) and over_limit (n_tokens > limit) to df.

    No begin, end or other special tokens count. A null text counts as empty: 0 bytes and 0
    tokens. Texts of any length count whole; repeated rows give repeated results; an empty
    table gives an empty one; columns of df named like a new one are replaced.
    """
    model = model or model_bytes()
    sp = load(model)
    check_model(sp)
    shared = df.sparkSession.sparkContext.broadcast((model, whole_tokens(sp)))

    def make():
        model, whole = shared.value
        table = ChunkTable(load(model), len, dict.fromkeys(whole, 1))

        def work(texts: list[str]) -> list[list]:
            lists = [chunks_of(t) for t in texts]
            counts = table.of(lists)
            return [[len(t.encode()) for t in texts], [sum(map(counts.__getitem__, c)) for c in lists]]

        return work

    fields = [("n_bytes", pa.int64(), T.LongType()), ("n_tokens", pa.int64(), T.LongType())]
    df = map_texts(df.drop("over_limit"), make, fields, text, keep)
    return df.withColumn("over_limit", F.col("n_tokens") > limit)
