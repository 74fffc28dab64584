"""Answers and measurements as text: every report is a table of lines, so that it can be written from the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a status is called in a report.
BADGES = {"VERIFIED": "VERIFIED", "INVALID_LINE_RANGE": "BAD LINES", "FILE_NOT_FOUND": "NOT ON DISK", "AMBIGUOUS_COMPLETION": "AMBIGUOUS", "PARSE_ERROR": "ERROR", "SYMBOL_NOT_FOUND": "SYMBOL MISSING", "UNVERIFIED_RAW_TEXT": "RAW TEXT"}


def badge(status: Column, below: Column) -> Column:
    out = status
    for name, text in BADGES.items():
        out = F.when(status == name, text).otherwise(out)
    return F.when(below, "FLOOR (SUB-THR)").otherwise(out)


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(F.round(share * 100, 6), 1)), F.lit("%"))


def result_lines(results: DataFrame) -> DataFrame:
    """(rank, line) of ranked results (rank, calibrated_score, file_path, start_line, end_line, ground_truth_status, below_threshold)."""
    place = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    line = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" | "), percent(F.col("calibrated_score")), F.lit(" | "), place, F.lit(" | "), badge(F.col("ground_truth_status"), F.col("below_threshold")))
    return results.select("rank", line.alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value) one JSON object per row, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value"))


def markdown_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(place, line): a Markdown table; place orders the lines: 0 the head, 1 the rule, then the rows in the given order."""
    from pyspark.sql import Window

    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    body = rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "place long, line string")
    # reports are short; their order is one window
    numbered = body.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("place"), "line")
    return head.unionByName(numbered)


def evaluation_report(stages: DataFrame, summary: DataFrame, intervals: DataFrame) -> DataFrame:
    """(section, place, line): the stage table, the ranking summary and the bootstrap intervals of one evaluation."""
    parts = (("stages", stages, ["stage"]), ("ranking", summary, [summary.columns[0]]), ("intervals", intervals, ["metric"]))
    out = None
    for name, rows, order in parts:
        lines = markdown_lines(rows, order).select(F.lit(name).alias("section"), "place", "line")
        out = lines if out is None else out.unionByName(lines)
    return out


def write_text(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Lines as text files under a path, in order."""
    lines.orderBy(*order).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
