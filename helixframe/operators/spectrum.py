"""The spectrum of a sequence of any length: a Fourier transform in columns, twiddle factors and rows.

A sequence of up to `SHORT` values is transformed in one piece. A longer one becomes a
convolution with a chirp, whose length M is a power of two, M1 x M2, so that the number of
values needs no factors. Task by task, columns of M1 values are transformed, multiplied
by the twiddle factors and cut into tiles; rows of M2 are put together from the tiles,
transformed, multiplied by the chirp's own transform, which goes through the same steps
beside it, and transformed back; the tiles then go back to columns for the last step. What
moves is two shuffles of tiles, each an array of `TILE` columns or rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tracks import WIDTH, numbered

#: Values that are transformed in one piece; columns or rows of a task.
SHORT, TILE = 1 << 16, 64


def shape(n: int) -> tuple[int, int]:
    """M1, M2: powers of two whose product is at least 2n - 1."""
    bits = max(2, int(2 * n - 2).bit_length())
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi j^2 / n); the squares are reduced as whole numbers."""
    return np.exp(1j * np.pi * ((j.astype(object) ** 2) % (2 * n)).astype(float) / n) if n > 1 << 31 else np.exp(1j * np.pi * ((j * j) % (2 * n)) / n)


def _twiddle(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    return np.exp(-2j * np.pi * ((a[:, None] * b[None, :]) % m) / m)


def to_tiles(values: np.ndarray, places: np.ndarray, n: int, column: int, tile: int = TILE) -> Iterator[tuple[int, np.ndarray]]:
    """Of a group of columns (the values at places with place % M2 // tile == column): (group of rows, tile of both transforms)."""
    m1, m2 = shape(n)
    tile1, tile2 = min(tile, m1), min(tile, m2)
    cols = column * tile2 + np.arange(tile2)
    x = np.zeros((m1, tile2), complex)
    x[places // m2, places % m2 - column * tile2] = values * np.conj(chirp(places, n))
    j = np.arange(m1)[:, None] * m2 + cols[None, :]
    back = np.minimum(j, m1 * m2 - j)
    b = np.where(back < n, chirp(np.where(back < n, back, 0), n), 0)
    both = np.stack([np.fft.fft(x, axis=0), np.fft.fft(b, axis=0)]) * _twiddle(np.arange(m1), cols, m1 * m2)
    for r in range(m1 // tile1):
        yield r, both[:, r * tile1 : (r + 1) * tile1]


def through_rows(tiles: dict[int, np.ndarray], n: int, row: int, tile: int = TILE) -> Iterator[tuple[int, np.ndarray]]:
    """Of a group of rows, all its tiles by group of columns: (group of columns, tile of the product, transformed back along the rows)."""
    m1, m2 = shape(n)
    tile1, tile2 = min(tile, m1), min(tile, m2)
    both = np.fft.fft(np.concatenate([tiles[c] for c in range(m2 // tile2)], axis=2), axis=2)
    back = np.fft.ifft(both[0] * both[1], axis=1) * np.conj(_twiddle(row * tile1 + np.arange(tile1), np.arange(m2), m1 * m2))
    for c in range(m2 // tile2):
        yield c, back[:, c * tile2 : (c + 1) * tile2]


def powers(tiles: dict[int, np.ndarray], n: int, column: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Of a group of columns, all its tiles by group of rows: (frequencies up to n // 2, their powers)."""
    m1, m2 = shape(n)
    tile1, tile2 = min(tile, m1), min(tile, m2)
    out = np.fft.ifft(np.concatenate([tiles[r] for r in range(m1 // tile1)], axis=0), axis=0)
    f = np.arange(m1)[:, None] * m2 + column * tile2 + np.arange(tile2)[None, :]
    wanted = f <= n // 2
    return f[wanted], np.abs(out[wanted]) ** 2


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, complex).tobytes()


def power_spectrum(df: DataFrame, seq: str, pos: str, value: str, short: int = SHORT, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """(sequence, n, k, power): the power of the centred values at each frequency k / n, k from 0 to n // 2."""
    rows = numbered(df.select(seq, pos, F.col(value).cast("double").alias("_x")), seq, pos, "_x", width)
    rows = rows.select(F.col(seq).alias("s"), F.col("_i").alias("i"), F.col("_n").alias("n"), (F.col("_x") - F.col("_mean")).alias("c"))
    kind = rows.schema["s"].dataType
    out = T.StructType([T.StructField("s", kind), *T._parse_datatype_string("n long, k long, power double")])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["c"].to_numpy()
        power = np.abs(np.fft.rfft(x)) ** 2
        return pd.DataFrame({"s": [pdf["s"].iloc[0]] * len(power), "n": len(x), "k": np.arange(len(power)), "power": power}).astype({"s": object})

    brief = rows.filter(F.col("n") <= short).groupBy("s").applyInPandas(whole, out)
    # columns of the second side of shape(n); its bits are those of 2n - 2
    bits = F.length(F.conv((2 * F.col("n") - 2).cast("string"), 10, 2))
    m2 = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")
    column = F.floor((F.col("i") % m2) / F.least(F.lit(tile).cast("long"), m2)).cast("int")
    tiles = T.StructType([T.StructField("s", kind), *T._parse_datatype_string("n long, r int, c int, t binary")])

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = int(pdf["n"].iloc[0]), int(pdf["g"].iloc[0])
        parts = [(r, _packed(t)) for r, t in to_tiles(pdf["c"].to_numpy(), pdf["i"].to_numpy(), n, c, tile)]
        return pd.DataFrame({"s": [pdf["s"].iloc[0]] * len(parts), "n": n, "r": [p[0] for p in parts], "c": c, "t": [p[1] for p in parts]}).astype({"s": object})

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        n, r = int(pdf["n"].iloc[0]), int(pdf["r"].iloc[0])
        m1, m2 = shape(n)
        found = {int(c): np.frombuffer(t, complex).reshape(2, min(tile, m1), min(tile, m2)) for c, t in zip(pdf["c"], pdf["t"], strict=True)}
        parts = [(c, _packed(t)) for c, t in through_rows(found, n, r, tile)]
        return pd.DataFrame({"s": [pdf["s"].iloc[0]] * len(parts), "n": n, "r": r, "c": [p[0] for p in parts], "t": [p[1] for p in parts]}).astype({"s": object})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = int(pdf["n"].iloc[0]), int(pdf["c"].iloc[0])
        m1, m2 = shape(n)
        found = {int(r): np.frombuffer(t, complex).reshape(min(tile, m1), min(tile, m2)) for r, t in zip(pdf["r"], pdf["t"], strict=True)}
        k, power = powers(found, n, c, tile)
        return pd.DataFrame({"s": [pdf["s"].iloc[0]] * len(k), "n": n, "k": k, "power": power}).astype({"s": object})

    long_ = rows.filter(F.col("n") > short).withColumn("g", column).groupBy("s", "g").applyInPandas(columns, tiles)
    long_ = long_.groupBy("s", "r").applyInPandas(rows_of, tiles).groupBy("s", "c").applyInPandas(last, out)
    return brief.unionByName(long_).withColumnRenamed("s", seq)


def dominant_period(df: DataFrame, seq: str, pos: str, value: str, short: int = SHORT, tile: int = TILE, width: int = WIDTH) -> DataFrame:
    """(sequence, period, third_rank): the period of the strongest frequency and the rank of that nearest to one third; null for a single value."""
    spectrum = power_spectrum(df, seq, pos, value, short, tile, width)
    third = F.abs(F.col("k") / F.col("n") - 1.0 / 3)
    best = spectrum.groupBy(seq).agg(
        F.max("n").alias("_n"), F.max(F.when(F.col("k") > 0, F.struct("power", (-F.col("k")).alias("k")))).alias("_best"),
        F.min(F.when(F.col("k") > 0, F.struct(third.alias("off"), "k", "power"))).alias("_third"),
    ).select(F.col(seq).alias("_seq"), "_n", -F.col("_best.k").cast("long"), F.col("_third.power").alias("_tp")).toDF("_seq", "_n", "_k", "_tp")
    above = spectrum.join(best, F.col(seq).eqNullSafe(F.col("_seq"))).groupBy(seq).agg(
        F.first("_k").alias("_k"), F.first("_n").alias("_n"), F.count_if((F.col("k") > 0) & (F.col("power") > F.col("_tp"))).alias("_above"))
    rank = F.when(F.col("_k").isNotNull(), F.col("_above") + 1).cast("int")
    return above.select(seq, F.try_divide(F.col("_n").cast("double"), F.col("_k")).alias("period"), rank.alias("third_rank"))
