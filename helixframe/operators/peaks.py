"""Greedy merging of peaks along a sequence, as a fold whose blocks are computed side by side.

In order, a peak closer than `within` to the last kept one replaces it if it is higher and
goes otherwise; any other peak is kept. What a block of positions does depends on what came
before only through the last kept peak, and only if that lies less than `within` before the
block's first peak. So a block is summed up by a short table: for each peak just before it,
and for none, the last kept peak at its end. The tables of a sequence are chained in order,
and then every block, knowing where it starts from, gives its kept peaks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .persist import cut

#: Positions of a block.
WIDTH = 1 << 20

State = tuple[int, float] | None


def fold(pos: np.ndarray, value: np.ndarray, within: int, start: State) -> tuple[State, list[int]]:
    """The last kept peak, and the peaks that are kept for good: each is told when the next one is kept beside it."""
    last, done = start, []
    for p, v in zip(pos.tolist(), value.tolist(), strict=True):
        if last is not None and p - last[0] < within:
            if v > last[1]:
                last = p, v
        else:
            if last is not None:
                done.append(last[0])
            last = p, v
    return last, done


def kept_peaks(peaks: DataFrame, seq: str, pos: str, value: str, within: int = 30, width: int = WIDTH) -> DataFrame:
    """(sequence, position): a row for each kept peak. Positions are whole numbers; of equal ones the lower value comes first."""
    width = max(width, within)
    rows = peaks.select(F.col(seq).alias("s"), F.col(pos).cast("long").alias("p"), F.col(value).cast("double").alias("v")).withColumn("b", F.floor(F.col("p") / width))
    # a peak near the end of its block also stands before the next one
    ahead = F.when(F.floor((F.col("p") + within - 1) / width) > F.col("b"), F.array(F.col("b"), F.col("b") + 1)).otherwise(F.array("b"))
    rows = cut(rows.withColumn("k", F.explode(ahead)).withColumn("own", F.col("k") == F.col("b")).drop("b"))
    kind = rows.schema["s"].dataType
    s = T.StructField("s", kind)
    summary = T.StructType([s, *T._parse_datatype_string("k long, at long, sv double, last long, v double")])

    def parts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        pdf = pdf.sort_values(["p", "v"])
        return pdf[~pdf["own"]], pdf[pdf["own"]]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """From the last kept peak (at, sv), null if none is near, to the last kept peak (last, v), null if that stays."""
        before, own = parts(pdf)
        out = []
        if len(own):
            p, v = own["p"].to_numpy(), own["v"].to_numpy()
            starts: list[State] = [None, *zip(before["p"].tolist(), before["v"].tolist(), strict=True)]
            for start in starts:
                last, _ = fold(p, v, within, start)
                stays = start is not None and last == start
                out.append((pdf["s"].iloc[0], pdf["k"].iloc[0], *(start or (None, None)), *((None, None) if stays else last)))
        return pd.DataFrame(out, columns=["s", "k", "at", "sv", "last", "v"]).astype({"s": object, "at": "Int64", "last": "Int64", "sv": float, "v": float})

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a sequence's tables the last kept peak before each block, and whether the block is the last."""
        out, last = [], None
        order = sorted(set(pdf["k"]))
        table = {(k, None if pd.isna(at) else (int(at), sv)): None if pd.isna(to) else (int(to), x) for k, at, sv, to, x in zip(pdf["k"], pdf["at"], pdf["sv"], pdf["last"], pdf["v"], strict=True)}
        for k in order:
            out.append((pdf["s"].iloc[0], k, *(last or (None, None)), k == order[-1]))
            last = table[k, last if (k, last) in table else None] or last
        return pd.DataFrame(out, columns=["s", "k", "at", "v", "end"]).astype({"s": object, "at": "Int64", "v": float})

    starts = rows.groupBy("s", "k").applyInPandas(sums, summary).groupBy("s").applyInPandas(chained, T.StructType([s, *T._parse_datatype_string("k long, at long, v double, end boolean")]))

    def told(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        _, own = parts(pdf)
        found: list[int] = []
        if len(own) and len(start):
            at, v = start["at"].iloc[0], start["v"].iloc[0]
            last, found = fold(own["p"].to_numpy(), own["v"].to_numpy(), within, None if pd.isna(at) else (int(at), float(v)))
            if start["end"].iloc[0] and last is not None:
                found = [*found, last[0]]
        value = pdf["s"].iloc[0] if len(pdf) else None
        return pd.DataFrame({"s": [value] * len(found), "p": found}).astype({"s": object})

    kept = rows.groupBy("s", "k").cogroup(starts.groupBy("s", "k")).applyInPandas(told, T.StructType([s, T.StructField("p", T.LongType())]))
    return kept.select(F.col("s").alias(seq), F.col("p").alias(pos))
