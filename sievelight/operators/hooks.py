"""Answers for a caller that waits: a bounded head is scored, the best few are cited, the decision is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import fuse_lexical

FILES, CHUNKS, BATCH, TOP = 30, 8, 4, 3
THRESHOLD = 0.65


def _numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def within_budget(rows: DataFrame, by: list[str], threshold: float = THRESHOLD, chunks: int = CHUNKS, batch: int = BATCH, top: int = TOP) -> DataFrame:
    """The citations of each query (by): at most `top` rows whose fused score passes, with rank.

    rows: lexical_score, raw_score, error, chunk_idx of all kept candidates.  The head of the lexical order is scored batch by
    batch until `top` raw scores pass; a batch that a deadline cuts off counts as an error.  Fusion judges a row against
    all candidates."""
    order = [F.desc("lexical_score"), F.col("chunk_idx")]
    head = _numbered(fuse_lexical(rows, by), by, order, "place").where(F.col("place") <= chunks)
    own = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum((~F.col("error") & (F.col("raw_score") >= threshold)).cast("int")).over(own)
    # how many had passed when the row's batch began
    begun = F.coalesce(F.max(F.when(F.col("place") % batch == 0, F.col("passed"))).over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = head.withColumn("passed", passed).withColumn("begun", begun).where(F.col("begun") < top)
    good = scored.where(~F.col("error") & (F.col("score") >= threshold))
    return _numbered(good, by, [F.desc("score"), F.col("place")], "rank").where(F.col("rank") <= top).drop("passed", "begun")


def head_or_best(rows: DataFrame, by: list[str], threshold: float, head: int = 16, least: int = 3) -> DataFrame:
    """The answer that fuses scores over a lexical head: rows that pass, or the best `least` if none does, with rank."""
    fused = fuse_lexical(rows, by, head)
    ranked = _numbered(fused, by, [F.desc("score"), F.desc("lexical_score"), F.col("chunk_idx")], "rank")
    passing = ranked.groupBy(*by).agg(F.count_if(F.col("score") >= threshold).alias("passing"))
    return ranked.join(passing, by).where(F.when(F.col("passing") > 0, F.col("score") >= threshold).otherwise(F.col("rank") <= least)).drop("passing")


def _lines(head: str, rows: DataFrame, by: list[str], line: Column, tail: str | None = None) -> DataFrame:
    listed = rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return listed.select(*by, F.concat_ws("\n", F.lit(head), "lines", *([F.lit(tail)] if tail else [])).alias("message"))


def _share(score: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(F.round(score * 100, 6), 1)), F.lit("%"))


def _place() -> Column:
    return F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))


def citation_message(cited: DataFrame, by: list[str]) -> DataFrame:
    """(by, message): one text per query from within_budget rows with file_path, start_line, end_line and symbol."""
    symbol = F.when(F.coalesce("symbol", F.lit("")) == "", "module scope").otherwise(F.col("symbol"))
    line = F.concat(F.lit("- "), _place(), F.lit(" ("), symbol, F.lit("), confidence "), _share(F.col("score")), F.lit(" (model "), _share(F.col("raw_score")), F.lit(")"))
    return _lines("Code citations for this prompt, ranked by a local model:", cited, by, line)


def injected_message(ranked: DataFrame, by: list[str], threshold: float = THRESHOLD, top: int = TOP) -> DataFrame:
    """(by, message) from ranked results (rank, score): the first `top` of those that pass; no row where none does."""
    passing = _numbered(ranked.where(F.col("score") >= threshold), by, [F.desc("score"), F.col("rank")], "place").where(F.col("place") <= top).drop("rank").withColumnRenamed("place", "rank")
    line = F.concat(F.lit("* "), _place(), F.lit(" ("), F.coalesce("symbol", F.lit("")), F.lit(") - confidence: "), _share(F.col("score")))
    return _lines("Pre-computed code citations for your task:", passing, by, line, "Tip: read the cited line ranges only.")


def decisions(prompts: DataFrame, cited: DataFrame, machine: Column, code: Column, candidates: Column | None = None, server: Column | None = None) -> DataFrame:
    """One usage row per prompt (prompt_id, prompt): caller, query, is_code_question, queried, outcome and the cited places.

    cited: (prompt_id, rank, file_path, start_line, end_line); server and candidates tell whether they were there."""
    places = cited.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", _place().alias("p")))), lambda x: x["p"]).alias("top"))
    rows = prompts.select("prompt_id", F.coalesce("prompt", F.lit("")).alias("query"), code.alias("is_code_question"), machine.alias("machine"), (F.lit(True) if candidates is None else candidates).alias("found"), (F.lit(True) if server is None else server).alias("server"))
    rows = rows.join(places, "prompt_id", "left")
    outcome = F.when(~F.col("is_code_question"), F.when(F.col("machine"), "machine-text").otherwise("not-code")).when(~F.col("server"), "no-server").when(~F.col("found"), "no-candidates").when(F.col("top").isNull(), "no-hits").otherwise("cited")
    shown = F.when(outcome == "cited", F.col("top")).otherwise(F.array().cast("array<string>"))
    return rows.select("prompt_id", F.lit("hook").alias("caller"), "query", "is_code_question", F.col("is_code_question").alias("queried"), outcome.alias("outcome"), shown.alias("top"))
