"""Sinks for manifests, splits, tables and reports."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from lumenframe.functions import expr as E
from lumenframe.sources import named


def counted(df: DataFrame, write: Callable[[DataFrame], None], **more: Column) -> Row:
    """Write ``df`` once and return ``n``, its number of rows, and ``more`` aggregates, which are taken while it is written."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]))
    return Row(**seen.get)


def write_jsonl(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """JSON lines with the keys in order; returns the number of rows.  A dry run only counts."""
    if dry_run:
        return df.count()
    return counted(df.select(*sorted(df.columns)), lambda d: d.write.option("ignoreNullFields", False).json(path)).n


def write_csv_rows(df: DataFrame, path: str, columns: list[str], dry_run: bool = False) -> int:
    """CSV with a header and these columns in this order; returns the number of rows."""
    if dry_run:
        return df.count()
    return counted(df.select(*columns), lambda d: d.write.option("header", True).csv(path)).n


#: The splits of a manifest.
SPLITS = ["train", "val", "test", "reobserve", "camera_only", "static_camera_physics", "moving_camera_physics", "stress"]


def write_splits(df: DataFrame, path: str, dry_run: bool = False) -> dict[str, int]:
    """A folder of JSON lines for each value of ``split``; returns the counts of those that have rows."""
    by_split = lambda d: {r.split: r.n for r in d.groupBy("split").agg(F.count("*").alias("n")).orderBy("split").collect()}  # noqa: E731  a row for each split
    if dry_run:
        return by_split(df)
    own = {f"s{i}": F.count_if(F.col("split") == s) for i, s in enumerate(SPLITS)}
    seen = counted(df, lambda d: d.write.partitionBy("split").json(path), **own)
    counts = {s: seen[f"s{i}"] for i, s in enumerate(SPLITS) if seen[f"s{i}"]}
    return counts if sum(counts.values()) == seen.n else by_split(df)


def write_split_files(df: DataFrame, folder: str, order: list[str], dry_run: bool = False) -> dict[str, int]:
    """``<split>.jsonl`` in ``folder`` for each value of ``split``, lines in the order of ``order`` and keys in theirs; returns the counts.

    The files appear together when all are whole.  Each is written by one task, so ``write_splits`` suits large splits better.
    """
    counts = {r.split: r.n for r in df.groupBy("split").agg(F.count("*").alias("n")).orderBy("split").collect()}  # a row for each split
    if not dry_run:
        line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        named.write_named(df.select(F.concat("split", F.lit(".jsonl")).alias("file"), line.alias("line"), *order), folder, order)
    return counts


def write_json_document(value: object, path: str, dry_run: bool = False) -> None:
    """A small document, written by the driver with its keys in order; ``path`` may be a URI."""
    if not dry_run:
        named.write_text(named.document(value), path)


def write_config(value: dict, path: str, dry_run: bool = False) -> None:
    """A small YAML document, written by the driver; JSON, which YAML readers take, without a YAML library.  ``path`` may be a URI."""
    if dry_run:
        return
    try:
        import yaml

        text = yaml.safe_dump(value, sort_keys=False, allow_unicode=True)
    except ImportError:
        text = named.document(value)
    named.write_text(text, path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """A ``line`` of a Markdown table for each row; floats have four digits, null is empty."""
    cells = [F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", c) if t in ("double", "float") else F.col(c).cast("string")) for c, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_table(df: DataFrame) -> str:
    """A Markdown table of a small summary."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*head, *(r.line for r in markdown_rows(df).collect())])


def calibration_report(overall: dict, by_corruption: DataFrame, least: float = 0.7) -> str:
    """Markdown of a calibration, with a warning below the least win rate."""
    lines = ["# Reward calibration", "", f"- comparisons: {overall['n']}", f"- clean win rate: {overall['win_rate']}"]
    if (overall["win_rate"] or 0.0) < least:
        lines.append(f"- WARNING: the win rate is below {least}")
    return "\n".join([*lines, "", markdown_table(by_corruption), ""])


# Columns of the summary over all models, and which way each metric is better.
SUMMARY_COLUMNS = {"pmf": "PMF \u2191", "psnr": "PSNR \u2191", "ssim": "SSIM \u2191", "lpips": "LPIPS \u2193", "fvd": "FVD \u2193"}
DIRECTIONS = {"pmf": "higher", "psnr": "higher", "ssim": "higher", "lpips": "lower", "fvd": "lower"}


def summary_columns() -> list[Column]:
    return [F.col("model").alias("Method"), *[E.round_or_blank(F.col(m)).alias(label) for m, label in SUMMARY_COLUMNS.items()]]


def summary_table(models: DataFrame) -> DataFrame:
    """Method and the metrics of each model (model, pmf, psnr, ssim, lpips, fvd), rounded to four digits, blank where there is no number."""
    return models.select(*summary_columns())


def write_final_summary(models: DataFrame, folder: str, dry_run: bool = False, **about: str) -> dict:
    """metrics_summary.csv, .md and .json of a few models in ``folder`` (a path or URI), by the driver; returns the JSON document."""
    both = models.select(F.struct(*models.columns).alias("row"), F.struct(*summary_columns()).alias("cells")).collect()  # a row for each model
    head, table = ["Method", *SUMMARY_COLUMNS.values()], [list(r.cells) for r in both]
    summary = {"metrics_mode": "physinone", "directions": DIRECTIONS, **about, "rows": [r.row.asDict() for r in both]}
    if not dry_run:
        text = io.StringIO()
        csv.writer(text).writerows([head, *table])
        lines = ["| " + " | ".join(cells) + " |" for cells in (head, ["---"] * len(head), *table)]
        for ending, whole in (("csv", text.getvalue()), ("md", "\n".join(lines) + "\n"), ("json", named.document(summary))):
            named.write_text(whole, f"{folder}/metrics_summary.{ending}")
    return summary
