"""Writers: FASTA, TSV, BED, JSON, HTML reports and tables for papers."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq


def fasta_lines(df: DataFrame, sequence_id: str = "sequence_id", sequence: str = "sequence", width: int = 80) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(sequence_id), F.lit("\n"), seq.wrap(sequence, width)).alias("value"))


def write_fasta(df: DataFrame, path: str, sequence_id: str = "sequence_id", sequence: str = "sequence", width: int = 80, order: str | None = None) -> None:
    rows = df.orderBy(order) if order else df
    fasta_lines(rows, sequence_id, sequence, width).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep="\t", header=True)


def bed_score(mean: str | Column) -> Column:
    m = F.col(mean) if isinstance(mean, str) else mean
    return F.least(F.lit(1000), F.when(m >= 0, F.floor(m * 1000)).otherwise(F.ceil(m * 1000))).cast("int")


def write_bed(df: DataFrame, path: str, chrom: str = "chromosome_id", name: str = "region_id", score: str = "mean_score") -> None:
    df.select(chrom, "start", "end", name, bed_score(score), F.lit(".")).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def summary_json(df: DataFrame) -> str:
    """A one-row summary as a JSON object."""
    return json.dumps(df.first().asDict(recursive=True), default=str, indent=2)


def small_rows(df: DataFrame, most: int) -> list:
    """All rows of a table for reading; more than `most` are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows; aggregate it or raise the bound")
    return rows


def markdown_table(df: DataFrame, digits: int = 4, most: int = 10_000) -> str:
    """A small result as a Markdown table."""
    rows = small_rows(df, most)
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def latex_table(df: DataFrame, digits: int = 4, most: int = 10_000) -> str:
    rows = small_rows(df, most)
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "--" if v is None else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = " \\\\\n".join(" & ".join(show(v) for v in r) for r in rows)
    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    return f"\\begin{{tabular}}{{l{'r' * (len(df.columns) - 1)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body} \\\\\n\\bottomrule\n\\end{{tabular}}"


def _bars(rows: list[tuple[str, float]]) -> str:
    top = max((v for _, v in rows), default=0) or 1
    return "".join(f'<div class="row"><span>{escape(k)}</span><i style="width:{100 * v / top:.1f}%"></i><b>{v:g}</b></div>' for k, v in rows)


def _points(rows: list, size: int = 300) -> str:
    """Dots of pairs of numbers, drawn to the range that they have."""
    xs, ys = [float(r[0]) for r in rows], [float(r[1]) for r in rows]
    at = lambda v, all_: size * (v - min(all_)) / ((max(all_) - min(all_)) or 1)
    return f'<svg width="{size}" height="{size}">' + "".join(f'<circle cx="{at(x, xs):.1f}" cy="{size - at(y, ys):.1f}" r="2"/>' for x, y in zip(xs, ys, strict=True)) + "</svg>"


def html_report(title: str, summary: dict, sections: dict[str, DataFrame], most: int = 10_000) -> str:
    """A page of the summary and, of each small table, dots (two columns of fractions), bars (two columns, the second a number) or a table."""
    parts = [f"<h1>{escape(title)}</h1><dl>" + "".join(f"<dt>{escape(str(k))}</dt><dd>{escape(str(v))}</dd>" for k, v in summary.items()) + "</dl>"]
    for name, df in sections.items():
        rows = small_rows(df, most)
        if len(df.columns) == 2 and rows and all(isinstance(r[0], float) and isinstance(r[1], float) for r in rows):
            body = _points(rows)
        elif len(df.columns) == 2 and all(isinstance(r[1], int | float) for r in rows):
            body = _bars([(str(r[0]), float(r[1])) for r in rows])
        else:
            body = "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
        parts.append(f"<h2>{escape(name)}</h2>{body}")
    style = ".row{display:flex;gap:8px}.row i{background:#4477aa;height:12px;display:block}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body>{''.join(parts)}</body></html>"


def detection_report(result: DataFrame, bins: int = 50, top: int = 200) -> str:
    """Histogram, classes, cumulative share, mean score by length, and the `top` contigs by score of a detection."""
    from ..operators import metrics as M

    n = result.agg(F.count(F.lit(1)).alias("contigs"), F.avg("viral_score").alias("mean score"), F.median("viral_score").alias("median score")).first()
    steps = M.histogram(result, "viral_score", 0.0, 1.0, bins).orderBy("bin")
    total = float(n["contigs"] or 1)
    from pyspark.sql import Window

    cdf = steps.select("bin", F.round(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin")) / total, 4).alias("share"))
    by_length = result.groupBy(F.floor(F.least("contig_length", F.lit(1_000_000)) / 1000).cast("double").alias("k")).agg(F.avg("viral_score").alias("score")).orderBy("k")
    sections = {"Scores": steps, "Classes": result.groupBy("classification").count().orderBy("classification"), "Cumulative share": cdf, "Mean score by length (thousands)": by_length, f"Contigs: the {top} of the highest scores": result.select("contig_id", "contig_length", "viral_score", "classification").orderBy(F.desc("viral_score"), "contig_id").limit(top)}
    return html_report("Detection", n.asDict(), sections)


def training_report(predictions: DataFrame, classes: list[str], label: str = "label") -> str:
    """Confusion table, metrics by class, ROC points and calibration of held-out predictions (label, probabilities)."""
    from ..functions import vec
    from ..operators import metrics as M

    rows = predictions.withColumn("pred", vec.first_argmax("probabilities")).withColumn("p", F.col("probabilities")[1])
    positive = F.col(label) == 1
    sections = {"Confusion": M.confusion(rows, label, "pred").orderBy("truth", "pred"), "By class": M.per_class(rows, label, "pred").orderBy("label")}
    if len(classes) == 2:
        sweep = M.threshold_sweep(rows, positive, "p", [i / 100 for i in range(101)]).orderBy("cutoff")  # a point for each hundredth
        sections |= {"ROC": sweep.select(M.or_zero(F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))).alias("fpr"), F.col("recall").alias("tpr")), "Calibration": M.calibration_bins(rows, positive, "p").orderBy("bin")}
    return html_report("Training", M.weighted_metrics(rows, label, "pred").first().asDict() | {"classes": ", ".join(classes)}, sections)
