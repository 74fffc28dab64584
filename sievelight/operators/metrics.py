"""Probability and ranking metrics over (y, p) rows, grouped by any columns.

AUROC and average precision first count rows per distinct score, so their windows see scores, not
rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import cut

BINS = 10


def _keys(by) -> list[str]:
    return list(by or [])


def brier(df: DataFrame, by=None) -> DataFrame:
    return df.groupBy(*_keys(by)).agg(F.round(F.coalesce(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), F.lit(0.0)), 4).alias("brier"))


def bin_of(p: Column, n: int = BINS) -> Column:
    """Equal-width bin by comparison with i/n, the last one closed; null outside [0, 1]."""
    edges = F.array(*[F.lit(i / n) for i in range(1, n)])
    return F.when((p >= 0) & (p <= 1), F.size(F.filter(edges, lambda e: p >= e)))


def _exact(x: Column) -> Column:
    """A probability as a decimal, whose sums do not depend on their order."""
    return x.cast("decimal(18,12)")


def _binned(df: DataFrame, by, n: int) -> DataFrame:
    return df.withColumn("bin", bin_of(F.col("p"), n)).where("bin is not null").groupBy(*_keys(by), "bin").agg(F.count(F.lit(1)).alias("n"), (F.sum(_exact(F.col("y"))).cast("double") / F.count(F.lit(1))).alias("rate"), (F.sum(_exact(F.col("p"))).cast("double") / F.count(F.lit(1))).alias("mean_p"), F.abs(F.sum(_exact(F.col("y")) - _exact(F.col("p")))).alias("gap"))


def ece(df: DataFrame, by=None, n: int = BINS) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = _binned(df, by, n)
    return b.groupBy(*_keys(by)).agg(F.round(F.coalesce(F.sum("gap").cast("double") / F.sum("n"), F.lit(0.0)), 4).alias("ece"))


def reliability(df: DataFrame, n: int = BINS) -> DataFrame:
    """One row per bin, empty ones with nulls."""
    edges = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    joined = edges.join(_binned(df, None, n), "bin", "left")
    return joined.select(
        "bin",
        F.concat(F.format_string("%.1f", F.col("bin") / n), F.lit("-"), F.format_string("%.1f", (F.col("bin") + 1) / n)).alias("bin_range"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        F.round("mean_p", 4).alias("mean_predicted"),
        F.round("rate", 4).alias("observed_rate"),
        F.round(F.abs(F.col("rate") - F.col("mean_p")), 4).alias("error"),
    )


def _per_score(df: DataFrame, by) -> DataFrame:
    return df.groupBy(*_keys(by), "p").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))


def auroc(df: DataFrame, by=None) -> DataFrame:
    """Mann-Whitney with ties at a half; 0.5 for one class, 0.0 for no rows."""
    s = _per_score(df, by)
    w = Window.partitionBy(*_keys(by)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0))
    s = s.withColumn("wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return s.groupBy(*_keys(by)).agg(F.when(F.coalesce(pos + neg, F.lit(0)) == 0, 0.0).when((pos == 0) | (neg == 0), 0.5).otherwise(F.round(F.sum("wins") / (pos.cast("double") * neg), 4)).alias("auroc"))


def auprc(df: DataFrame, by=None) -> DataFrame:
    """Average precision by blocks of equal scores."""
    s = _per_score(df, by)
    w = Window.partitionBy(*_keys(by)).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("part", F.sum("pos").over(w) / F.sum("n").over(w) * F.col("pos"))
    pos = F.sum("pos")
    return s.groupBy(*_keys(by)).agg(F.when(F.coalesce(pos, F.lit(0)) == 0, 0.0).otherwise(F.round(F.sum("part") / pos, 4)).alias("auprc"))


def brier_skill(df: DataFrame, by=None) -> DataFrame:
    """1 - Brier / (base rate * (1 - base rate)), with the rounded Brier score."""
    base = F.avg("y") * (1 - F.avg("y"))
    b = F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 4)
    return df.groupBy(*_keys(by)).agg(F.when(F.coalesce(base, F.lit(0.0)) <= 1e-12, 0.0).otherwise(F.round(1 - b / base, 4)).alias("brier_skill"))


def sharpness(df: DataFrame) -> DataFrame:
    above = lambda t: F.round(F.avg((F.col("p") > t).cast("double")) * 100, 2)
    out = df.agg(F.round(F.min("p"), 4).alias("min"), F.round(F.percentile("p", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("p", F.lit(0.75)), 4).alias("p75"), F.round(F.max("p"), 4).alias("max"), above(0.30).alias("pct_above_30"), above(0.50).alias("pct_above_50"), above(0.70).alias("pct_above_70"))
    return out.na.fill(0.0)


def histogram(df: DataFrame) -> DataFrame:
    """Counts by min(9, floor(10 p)), empty bins included."""
    b = F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int")
    counted = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def percentile(df: DataFrame, column: str, p: float, by=None) -> DataFrame:
    """Linear-interpolated percentile, to three decimals; 0 for no rows."""
    return df.groupBy(*_keys(by)).agg(F.round(F.coalesce(F.percentile(column, F.lit(p / 100.0)), F.lit(0.0)), 3).alias("value"))


def first_target(results: DataFrame) -> DataFrame:
    """(task_id, rank, reciprocal_rank) from labelled results (task_id, rank, is_target)."""
    best = F.min(F.when(F.col("is_target"), F.col("rank")))
    return results.groupBy("task_id").agg(best.alias("rank"), F.round(F.coalesce(1.0 / best, F.lit(0.0)), 4).alias("reciprocal_rank"))


def label_targets(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """results of tasks with is_target: the path holds the task's part, and the symbols agree if both are there."""
    j = results.join(tasks.select("task_id", "target_file_substr", "target_symbol"), "task_id")
    symbol = F.col("target_symbol").isNull() | F.col("symbol").isNull() | F.contains(F.lower("symbol"), F.lower("target_symbol"))
    return j.withColumn("is_target", F.coalesce(F.contains("file_path", F.col("target_file_substr")), F.lit(False)) & symbol)


def ranking_summary(ranks: DataFrame, by=None) -> DataFrame:
    """Recall at 1, 3 and 5, MRR, and the mean rank of found targets."""
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_{k}")
    return ranks.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("tasks"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg("rank"), 2).alias("mean_rank"))


def failures(labelled: DataFrame) -> DataFrame:
    """Tasks whose first target is missing or below rank three, with their top three competitors and a cause."""
    labelled = cut(labelled)
    ranks = first_target(labelled)
    bad = ranks.where("rank is null or rank > 3")
    others = labelled.where("rank <= 3 and not is_target").groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("competitors"))
    cause = F.when(F.col("rank").isNull(), "target not retrieved").when(F.col("rank") <= 5, "narrowly outranked").otherwise("outranked")
    return bad.join(others, "task_id", "left").select("task_id", "rank", F.coalesce("competitors", F.lit("")).alias("competitors"), cause.alias("cause"))


def stage_table(rows: DataFrame, stages=("p_raw", "p_len", "p_intent", "p_cal")) -> DataFrame:
    """Brier, ECE, AUROC and average precision of each probability stage."""
    long = rows.select(F.col("y_true").alias("y"), F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("p")) for s in stages])).alias("x")).select("y", "x.stage", "x.p")
    out = brier(long, ["stage"])
    for part in (ece, auroc, auprc):
        out = out.join(part(long, ["stage"]), "stage")
    return out


def telemetry_summary(rows: DataFrame) -> DataFrame:
    """One row over the telemetry rows of many queries: sums, means of positive values, the greatest 95th percentile.

    rows: chunks_evaluated, cache_hits, cache_misses, ambiguous, prompt_tokens, completion_tokens, prefill_rate, decode_rate, latency_p95,
    floor_triggered, abstained, reduction_ratio, yes_rate, no_rate, redundancy_penalties, symbol_boosts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"total_{c}")
    mean = lambda c, places: F.round(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), places).alias(f"avg_{c}")
    count = lambda c: F.count_if(F.col(c)).alias(f"{c}_count")
    share = lambda n, d: F.round(F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0)), 4)
    chunks, tasks = F.sum("chunks_evaluated"), F.count(F.lit(1))
    return rows.agg(
        tasks.alias("total_tasks"),
        *[total(c) for c in ("chunks_evaluated", "cache_hits", "cache_misses", "ambiguous", "prompt_tokens", "completion_tokens", "redundancy_penalties", "symbol_boosts")],
        share(F.sum("cache_hits"), chunks).alias("cache_hit_rate"),
        share(F.sum("ambiguous"), chunks).alias("ambiguous_rate"),
        *[mean(c, n) for c, n in (("prefill_rate", 1), ("decode_rate", 1), ("reduction_ratio", 2), ("yes_rate", 4), ("no_rate", 4))],
        F.round(F.coalesce(F.max(F.when(F.col("latency_p95") > 0, F.col("latency_p95"))), F.lit(0.0)), 2).alias("latency_p95"),
        *[x for c in ("floor_triggered", "abstained") for x in (count(c), share(F.count_if(F.col(c)), tasks).alias(f"{c}_rate"))],
    )


def top_metadata(results: DataFrame, most: int = 3) -> DataFrame:
    """(task_id, top): the first `most` results of a task as structs, in order of rank."""
    item = F.struct("rank", "file_path", "symbol", "score", "raw_score", "is_test", "start_line", "end_line")
    return results.where(F.col("rank") <= most).groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("top"))


def drawn(sample, position, n) -> Column:
    """The place, from 0, that a position of a resample draws among n tasks: 32 bits of a hash, so that executors draw alike."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", sample.cast("string"), position.cast("string"))), 1, 8), 16, 10).cast("bigint"), n)


#: What a resample measures, in order of the report.
BOOTSTRAPPED = ("recall_1", "recall_3", "recall_5", "mrr", "brier", "ece", "cal_brier", "cal_ece")


def bootstrap_ci(task_rows: DataFrame, resamples: int = 1000) -> DataFrame:
    """(metric, low, mean, high): 95 % percentile intervals over tasks drawn with replacement.

    task_rows: (task_id, rank, y, p, p_cal) per scored chunk, rank being the task's first target's.  Chunks are first summed by
    task and bin, so what is resampled are a few sums per task; draws are hashes of (resample, position), made where
    they are joined; nothing goes to the driver."""
    from .chunking import number_rows

    squares = lambda p: F.sum((F.col(p) - F.col("y")) * (F.col(p) - F.col("y")))
    tasks = task_rows.groupBy("task_id").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), squares("p").alias("sq"), squares("p_cal").alias("sq_cal"))
    placed = number_rows(tasks, "task_id", "place")
    sizes = placed.agg(F.max("place").alias("last"))
    grid = placed.select("place").join(F.broadcast(sizes), how="inner", on=F.lit(True)).select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("sample"), F.col("place").alias("position"), (F.col("last") + 1).alias("size"))
    draws = grid.select("sample", drawn(F.col("sample"), F.col("position"), F.col("size")).alias("place")).groupBy("sample", "place").agg(F.count(F.lit(1)).alias("times"))
    held = draws.join(placed, "place")
    t = F.col("times")
    mean = lambda x: F.sum(t * x) / F.sum("times")
    ranks = held.groupBy("sample").agg(
        *[mean(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"recall_{k}") for k in (1, 3, 5)],
        mean(F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 4)).alias("mrr"),
        *[F.round(F.sum(t * F.col(c)) / F.sum(t * F.col("n")), 4).alias(name) for c, name in (("sq", "brier"), ("sq_cal", "cal_brier"))],
    )
    both = task_rows.select("task_id", "y", F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(p).alias("p")) for name, p in (("ece", "p"), ("cal_ece", "p_cal"))])).alias("x")).select("task_id", "y", "x.*")
    binned = both.withColumn("bin", bin_of(F.col("p"))).where("bin is not null").groupBy("task_id", "metric", "bin").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("sy"), F.sum("p").alias("sp"))
    cells = held.select("sample", "task_id", "times").join(binned, "task_id").groupBy("sample", "metric", "bin").agg(F.sum(t * F.col("k")).alias("k"), F.abs(F.sum(t * F.col("sy")) - F.sum(t * F.col("sp"))).alias("gap"))
    errors = cells.groupBy("sample", "metric").agg(F.round(F.sum("gap") / F.sum("k"), 4).alias("v"))
    long = ranks.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in BOOTSTRAPPED if "ece" not in m])).alias("x")).select("x.metric", "x.v").union(errors.select("metric", "v"))
    # shares of small counts often lie halfway between two results: the noise of summation goes first
    places = lambda x: F.round(F.round(x, 9), 4)
    return long.groupBy("metric").agg(places(F.percentile("v", F.lit(0.025))).alias("low"), places(F.avg("v")).alias("mean"), places(F.percentile("v", F.lit(0.975))).alias("high"))
