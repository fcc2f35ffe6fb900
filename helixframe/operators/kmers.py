"""K-mer features: 64 + 16 frequencies, in-frame and out-of-frame entropy of 3-mers, GC share.

Counting is vectorised over Arrow batches: letters become codes in one lookup and
k-mers are sums of shifted codes, so a base costs a few operations and nothing is
exploded into rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
TRIMERS = ["".join(x) for x in product(BASES, repeat=3)]
DIMERS = ["".join(x) for x in product(BASES, repeat=2)]
NAMES = [*TRIMERS, *DIMERS, "gc", "in_frame", "out_frame", "frame_ratio"]
_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _i


def _entropy_of_codes(text: str, offset: int) -> float:
    """Bits of the whole 3-mers from an offset in steps of 3, whatever their letters."""
    usable = (len(text) - offset) // 3
    if usable <= 0:
        return 0.0
    wide = np.frombuffer(text[offset : offset + 3 * usable].encode("utf-32-le"), np.uint32).reshape(-1, 3).astype(np.uint64)
    _, n = np.unique(wide[:, 0] << np.uint64(42) | wide[:, 1] << np.uint64(21) | wide[:, 2], return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def features(text: str) -> np.ndarray:
    """The 84 features of one sequence; frequencies divide by all k-mers, those with other letters included."""
    code = _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    out = np.zeros(84)
    for k, at, size in ((3, 0, 64), (2, 64, 16)):
        n = max(1, len(code) - k + 1)
        if len(code) >= k:
            value = sum(code[i : len(code) - k + 1 + i] * 4 ** (k - 1 - i) for i in range(k))
            clean = np.logical_and.reduce([code[i : len(code) - k + 1 + i] < 4 for i in range(k)])
            out[at : at + size] = np.bincount(value[clean], minlength=size) / n
    out[80] = np.isin(code, (1, 2)).sum() / max(1, len(code))
    out[81], out[82] = _entropy_of_codes(text, 0), _entropy_of_codes(text, 1)
    out[83] = out[81] / max(out[82], 0.001)
    return out


def kmer_features(df: DataFrame, key: str, sequence: str, double: bool = False) -> DataFrame:
    """(key, features array<float>) of every sequence, or in double precision; null counts as empty."""
    kind = dict(df.dtypes)[key]
    np_type, pa_type, name = (np.float64, pa.float64(), "double") if double else (np.float32, pa.float32(), "float")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(s.as_py() or "").astype(np_type) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa_type))], names=[key, "features"])

    return df.select(key, F.col(sequence)).mapInArrow(each, f"{key} {kind}, features array<{name}>")
