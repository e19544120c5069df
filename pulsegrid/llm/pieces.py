"""SentencePiece encoding and decoding through a table of distinct chunks.

The text is marked as the library marks it (a leading marker, every space a marker) and cut
before each run of markers and before each newline. Where no piece of the vocabulary holds a
marker after another character, or a newline, no merge can cross such a cut, so the ids of
the text are the ids of its chunks in order. Each worker keeps a table from distinct chunk to
its ids: a chunk is segmented by the library once and its ids are joined back by position.
The table is bounded (it is emptied when full), so memory does not grow with the corpus; a
table over all executors would have to shuffle every word of the corpus twice.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import map_texts

MARK = "▁"
CHUNK = re.compile(f"(?:{MARK}+|\n)[^{MARK}\n]*")
#: Entries of a worker's table, and the longest chunk that it keeps.
TABLE_ENTRIES = 150_000
KEPT_CHARS = 48


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the public 32k BPE model with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def check_model(sp) -> None:
    """Raise ValueError unless cutting at markers and newlines is exact for this model."""
    crossing = re.compile(f"[^{MARK}]{MARK}|\n| ")
    bad = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if crossing.search(p)]
    newline = sp.encode("\n")
    if bad or len(newline) < 2 or newline[0] != sp.piece_to_id(MARK) or sp.encode("a  b") != sp.encode("a") + sp.encode(" b"):
        raise ValueError(f"pieces of this model may cross white space: {bad[:5]}")


def chunks_of(text: str) -> list[str]:
    """The marked chunks of a text; an empty text has none."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_chunks(sp, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk as it stands inside a text.

    The library adds a marker of its own in front: it takes the place of a chunk's first
    marker, and is dropped again before a newline.
    """
    bare = [c[1:] if c[0] == MARK else c for c in chunks]
    mark = [sp.piece_to_id(MARK)]
    return [
        mark if not b else ids[1:] if c[0] != MARK else ids
        for c, b, ids in zip(chunks, bare, sp.encode(bare, num_threads=1), strict=True)
    ]


class ChunkTable:
    """Distinct chunk -> value, filled by the library in batches. It holds the seed, at most
    TABLE_ENTRIES chunks of at most KEPT_CHARS characters, and the chunks of the last call."""

    def __init__(self, sp, value, seed: dict | None = None):
        self.sp, self.value, self.seed = sp, value, seed or {}
        self.known, self.passing = dict(self.seed), []

    def of(self, lists: list[list[str]]) -> dict:
        """A mapping that has every chunk of these lists, until the next call."""
        for chunk in self.passing:
            del self.known[chunk]
        wanted = set().union(*lists)
        missing = list(wanted - self.known.keys())
        if len(self.known) + len(missing) > TABLE_ENTRIES + len(self.seed):
            # Start anew with what is wanted now.
            self.known = self.seed | {chunk: self.known[chunk] for chunk in wanted & self.known.keys()}
        self.known.update(zip(missing, map(self.value, encode_chunks(self.sp, missing)), strict=True))
        self.passing = [chunk for chunk in missing if len(chunk) > KEPT_CHARS]
        return self.known


def id_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode_decode(df: DataFrame, model: bytes | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens (long), ids_le (binary, unsigned 32-bit little endian, with begin and
    end ids) and decoded (string, the library's decode of those ids) to df.

    A null text counts as empty: begin and end id only, decoded "". Texts of any length are
    encoded whole. Repeated rows give repeated results; an empty table gives an empty one;
    columns of df named like a new one are replaced.
    """
    model = model or model_bytes()
    check_model(load(model))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        sp = load(shared.value)
        table = ChunkTable(sp, id_bytes)
        first, last = id_bytes([sp.bos_id()]), id_bytes([sp.eos_id()])

        def work(texts: list[str]) -> list[list]:
            lists = [chunks_of(t) for t in texts]
            ids = table.of(lists)
            coded = [first + b"".join(map(ids.__getitem__, c)) + last for c in lists]
            decoded = [sp.decode(np.frombuffer(b, "<u4").tolist()) for b in coded]
            return [[len(b) // 4 for b in coded], coded, decoded]

        return work

    fields = [
        ("n_tokens", pa.int64(), T.LongType()),
        ("ids_le", pa.binary(), T.BinaryType()),
        ("decoded", pa.string(), T.StringType()),
    ]
    return map_texts(df, make, fields, text, keep)
