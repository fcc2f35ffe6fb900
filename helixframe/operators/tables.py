"""Tables that analyses put together: panels with their metrics, chains of metadata, boundaries, rates by renamed category, length bins, inversion tracks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tracks import WIDTH, framed, numbered, over, own


def gc_percent(sequence: str | Column) -> Column:
    """Share of G and C of either case in per cent, one digit; 0 of an empty or missing sequence."""
    s = F.coalesce(F.col(sequence) if isinstance(sequence, str) else sequence, F.lit(""))
    n = F.char_length(s)
    return F.round(100.0 * (n - F.char_length(F.regexp_replace(s, "[GCgc]", ""))) / F.greatest(n, F.lit(1)), 1)


def panel_with_metrics(panel: DataFrame, metrics: DataFrame, sequences: DataFrame, name: str, sequence: str) -> DataFrame:
    """Entries of a panel that have metrics, which win over columns of the same name, with gc_content and seq_len of their sequence, 0 without one.

    name: a column of all three; it is distinct in metrics and sequences.
    """
    own_columns = [c for c in panel.columns if c == name or c not in metrics.columns]
    measured = sequences.select(name, gc_percent(sequence).alias("gc_content"), F.char_length(sequence).cast("long").alias("seq_len"))
    joined = panel.select(*own_columns).join(metrics, name).join(measured, name, "left")
    return joined.withColumns({"gc_content": F.coalesce("gc_content", F.lit(0.0)), "seq_len": F.coalesce("seq_len", F.lit(0).cast("long"))})


@dataclass
class Metadata:
    """A table of metadata: its key, the columns to take by their new names, which rows count, and the order in which the last row of a key wins."""

    df: DataFrame
    key: str
    columns: dict[str, str | Column]
    where: Column | None = None
    order: str | None = None


def with_metadata(ids: DataFrame, key: str, tables: Sequence[Metadata]) -> DataFrame:
    """Every row of ids with what each table has on it, null where it has nothing; a table adds no rows, as the last row of a key wins."""
    out = ids
    for t in tables:
        rows = t.df.filter(t.where) if t.where is not None else t.df
        values = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in t.columns.items()))
        last = F.max_by(values, F.col(t.order)) if t.order else F.any_value(values)
        one = rows.groupBy(F.col(t.key).alias("_key")).agg(last.alias("_v"))
        out = out.join(one, F.col(key) == F.col("_key"), "left").select(*out.columns, *(F.col("_v")[n].alias(n) for n in t.columns))
    return out


def boundaries(genes: DataFrame, seq: str, start: str, end: str) -> DataFrame:
    """(sequence, boundary): the distinct ends of genes, from 0; start and end count from 1, in either order."""
    ends = F.array(F.least(start, end) - 1, F.greatest(start, end) - 1)
    return genes.select(seq, F.explode(ends).alias("boundary")).distinct()


def boundary_lists(genes: DataFrame, seq: str, start: str, end: str) -> DataFrame:
    """(sequence, boundaries): the same as one sorted array a sequence."""
    return boundaries(genes, seq, start, end).groupBy(seq).agg(F.sort_array(F.collect_list("boundary")).alias("boundaries"))


def rates_by_category(df: DataFrame, category: str, hit: Column, prefix: str = "noncoding_", order: Sequence[str] | None = None, gap: str | None = None) -> DataFrame:
    """(category, n, n_hit, rate, and of a gap its mean): per cent of rows that hit, by category without a prefix; a missing category is `unknown`.

    order: only these categories, numbered in `place` as they are listed.
    """
    name = F.replace(F.coalesce(F.col(category), F.lit("unknown")), F.lit(prefix), F.lit(""))
    by = df.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"), *([F.avg(gap).alias("gap")] if gap else []))
    out = by.withColumn("rate", 100.0 * F.col("n_hit") / F.col("n"))
    if order is None:
        return out
    place = F.array_position(F.array(*(F.lit(c) for c in order)), F.col("category")).cast("int")
    return out.withColumn("place", place).filter("place > 0")


def by_category_and_gap(df: DataFrame, category: str, gap: str) -> DataFrame:
    """The rows in the order of a report: by category, the largest gap last."""
    return df.orderBy(category, gap)


def bin_name(low: int, high: int) -> str:
    return f"{low // 1000}-{high // 1000}kb" if low >= 1000 else f"{low}-{high // 1000}kb"


def bin_partition(df: DataFrame, length: str, bins: Sequence[tuple[int, int]], out: str = "bin") -> DataFrame:
    """df with the bin of each row, from low to below high; rows outside all bins are dropped, rows in several come once in each."""
    inside = F.filter(F.array(*(F.when((F.col(length) >= lo) & (F.col(length) < hi), F.lit(bin_name(lo, hi))) for lo, hi in bins)), lambda x: x.isNotNull())
    return df.withColumn(out, F.explode(inside))


def inversion_track(df: DataFrame, seq: str, pos: str, near: str, far: str, window: int = 100, block: int = WIDTH) -> DataFrame:
    """(sequence, position, near, far, inversion): both similarities smoothed with zeros beyond the ends, and the far one less the near one."""
    left, right = window // 2, (window - 1) // 2
    rows = framed(numbered(df.select(seq, pos, near, far), seq, pos, width=block), left, right, width=block)
    frame = over(seq).rowsBetween(-left, right)
    smooth = rows.withColumns({f"_{c}": F.sum(c).over(frame) / float(window) for c in (near, far)})
    return own(smooth).select(seq, pos, F.col(f"_{near}").alias(near), F.col(f"_{far}").alias(far), (F.col(f"_{far}") - F.col(f"_{near}")).alias("inversion"))
