"""Numpy kernels over a column of segments, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.functions import kernels as K

#: Segments that a task works on at a time.
ROWS = 256


def prepared(x: np.ndarray, fs: float, cutoff: float = 30.0) -> np.ndarray:
    """Rows scaled to 0..1, smoothed, freed of drift and low-passed (where the rate allows)."""
    x = x - x.mean(1, keepdims=True)
    x = (x - x.min(1, keepdims=True)) / np.maximum(np.ptp(x, axis=1, keepdims=True), 1e-300)
    x = np.stack([np.convolve(r, np.full(5, 0.2), "same") for r in x])
    x = K.without_drift(x, fs)
    return K.zero_phase(*K.butterworth(5, cutoff, fs), x) if cutoff < fs / 2 else x


Kernel = Callable[[np.ndarray], np.ndarray]


def with_features(
    df: DataFrame, samples: str, features: dict[str | tuple[str, ...], Kernel], prepare: Kernel | None = None, arrays: dict[str, Kernel] | None = None
) -> DataFrame:
    """Append a double per feature, and an array of doubles per name of arrays, in place of
    samples. Each kernel takes rows of equal length and gives one number a row, a row of
    numbers for a tuple of names, or a row for an array. prepare runs once, before all of
    them. Segments of null, of no samples or with a null sample have null features."""
    arrays = arrays or {}
    kept = [c for c in df.columns if c != samples and c not in arrays]
    names = [n for key in features for n in ((key,) if isinstance(key, str) else key)]
    fields = [*(T.StructField(n, T.DoubleType()) for n in names), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in arrays)]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows = [None if r is None or not len(r) or None in r else np.asarray(r, float) for r in batch.column(samples).to_pylist()]
                values = {n: np.full(len(rows), np.nan) for n in names}
                lists: dict[str, list] = {n: [None] * len(rows) for n in arrays}
                for size in {len(r) for r in rows if r is not None}:
                    at = [i for i, r in enumerate(rows) if r is not None and len(r) == size]
                    x = np.stack([rows[i] for i in at])
                    x = x if prepare is None else prepare(x)
                    for key, f in features.items():
                        found = f(x)
                        for k, n in enumerate((key,) if isinstance(key, str) else key):
                            values[n][at] = found if isinstance(key, str) else found[:, k]
                    for n, f in arrays.items():
                        for i, row in zip(at, f(x)):
                            lists[n][i] = row
                columns = [batch.column(c) for c in kept] + [pa.array(v, pa.float64(), from_pandas=True) for v in values.values()]
                columns += [pa.array(v, pa.list_(pa.float64())) for v in lists.values()]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def amplitudes(x: np.ndarray) -> np.ndarray:
    """Of the lower half of each row's Fourier transform."""
    return np.abs(np.fft.rfft(x, axis=1))[:, : (x.shape[1] + 1) // 2]


def with_spectrum(df: DataFrame, samples: str, name: str) -> DataFrame:
    """Append the amplitudes as an array column; the samples stay."""
    return with_features(df, samples, {}, arrays={samples: lambda x: x, name: amplitudes})


def each(kernel: Callable[..., float], *args) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.array([kernel(r, *args) for r in x])
