"""Usage-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_by_caller(usage: DataFrame) -> DataFrame:
    """Queries and median latency per caller, of rows that queried."""
    asked = usage.where("coalesce(queried, true)")
    finite = F.when(~F.isnan("latencyMs"), F.col("latencyMs"))
    return asked.groupBy(F.coalesce("caller", F.lit("unknown")).alias("caller")).agg(F.count(F.lit(1)).alias("count"), F.percentile(finite, F.lit(0.5)).alias("median_ms"))


def hook_share(usage: DataFrame) -> DataFrame:
    """How many prompts the hook saw, and the share that it queried for; null without prompts."""
    hook = usage.where("caller = 'hook' and not (outcome <=> 'machine-text')")
    queried = F.sum(F.coalesce("queried", F.lit(True)).cast("int"))
    return hook.agg(F.count(F.lit(1)).alias("prompts"), F.coalesce(queried, F.lit(0)).alias("queried"), F.try_divide(queried.cast("double"), F.count(F.lit(1))).alias("share"))


def report_lines(by_caller: DataFrame, share: DataFrame) -> DataFrame:
    """(part, caller, line): the lines of a usage report, part 0 the total, 1 a line per caller, 2 the hook's share."""
    seconds = F.when(F.col("median_ms").isNull(), "n/a").otherwise(F.concat(F.format_string("%.1f", F.col("median_ms") / 1000), F.lit(" s")))
    width = lambda c, n, left: (F.rpad if left else F.lpad)(c, F.greatest(F.lit(n), F.length(c)), F.lit(" "))
    callers = by_caller.select(F.lit(1).alias("part"), "caller", F.concat(F.lit("  "), width(F.col("caller"), 6, True), F.lit(" "), width(F.col("count").cast("string"), 5, False), F.lit(" queries  median "), seconds).alias("line"))
    total = by_caller.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit(0).alias("part"), F.lit("").alias("caller"), F.concat(F.lit("Queries: "), F.col("n").cast("string")).alias("line"))
    part = F.when(F.col("share").isNull(), "n/a").otherwise(F.concat(F.format_string("%.1f", F.col("share") * 100), F.lit("%")))
    hook = share.select(F.lit(2).alias("part"), F.lit("").alias("caller"), F.concat(F.lit("Hook prompts that queried: "), F.col("queried").cast("string"), F.lit(" of "), F.col("prompts").cast("string"), F.lit(" ("), part, F.lit(")")).alias("line"))
    return total.unionByName(callers).unionByName(hook)
