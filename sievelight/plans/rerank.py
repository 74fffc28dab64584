"""The whole answer to a query: chunk, pre-filter, score, adjust, rank, cite, account."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import vocab as V
from ..operators import chunking, lexical, ranking, scoring
from ..sources.session import cut


@dataclass(frozen=True)
class Answer:
    """results: ranked, cited chunks; manifest: every candidate file; telemetry: one row."""

    results: DataFrame
    manifest: DataFrame
    telemetry: DataFrame


def decided(chunks: DataFrame, q: Q.Query, scorer: scoring.Scorer | None = None) -> DataFrame:
    """Tier-one survivors with all their scores, alignment counters flattened."""
    kept = cut(lexical.survivors(chunks, q))
    rows = ranking.decide(scoring.raw_scores((scorer or scoring.HashScorer()).score(kept, q.text)), q)
    for name in ("domain_hits", "structural_domain_hits", "symptom_hits", "symbol_role", "named"):
        rows = rows.withColumn(name, F.col(f"alignment.{name}"))
    return rows.drop("alignment")


def rerank(files: DataFrame, query: str, scorer: scoring.Scorer | None = None, size: int = 120, overlap: int = 30, intent: str | None = None, threshold: float | None = None, top_k: int | None = None, allow_empty: bool = False, strict: bool = False) -> Answer:
    """files: file_idx, file_path, body.  At most 80 chunks reach the scorer, so everything after tier one is
    small; what sees all chunks are a projection, a bounded top-k and the grouped manifest."""
    q = Q.Query.of(query, intent)
    limit = q.threshold if threshold is None else threshold
    chunks = chunking.with_index(chunking.windows(files, size, overlap))
    # the scorer runs once: its few rows are kept before the policy reads them several times
    rows = ranking.diversify(ranking.clamp_domain(cut(decided(chunks, q, scorer))))
    # only files that some survivor cites are counted for verification
    cited = files.join(F.broadcast(rows.select("file_path").distinct()), "file_path", "left_semi")
    counts = cited.select("file_path", (F.size(F.split("body", chunking.NEWLINE)) - F.col("body").rlike("(\r|\n)\\z").cast("int")).alias("line_count")).dropDuplicates(["file_path"])
    rows = cut(ranking.verify(rows, counts))
    shown = ranking.policy(rows, limit, top_k=top_k, allow_empty=allow_empty, strict=strict, bug_tests=q.intent == "BUG_DIAGNOSIS")
    results = shown.select(
        F.col("rank").cast("int").alias("rank"), F.col("id").alias("candidate_id"), "file_path", "start_line", "end_line", "raw_score", "decision_score", "calibrated_score",
        F.round(F.col("decision_score") - F.col("raw_score"), 4).alias("delta"), "ground_truth_status", "below_threshold", "included_by", "is_test", "redundancy_penalized", "utility_trap_demoted",
        "domain_hits", "structural_domain_hits", "symptom_hits", "symbol_role", ranking.snippet(F.col("content")).alias("snippet"),
    )
    files_out = ranking.manifest(chunks, rows, shown)
    return Answer(results, files_out, telemetry(chunks, rows, shown))


def telemetry(chunks: DataFrame, rows: DataFrame, shown: DataFrame) -> DataFrame:
    """One row of counters for a query."""
    all_ = chunks.agg(F.count(F.lit(1)).alias("chunks_total"), F.sum("token_est").alias("tokens_total"))
    seen = rows.agg(
        F.count(F.lit(1)).alias("chunks_evaluated"), F.sum("token_est").alias("tokens_evaluated"), F.sum(F.col("ambiguous").cast("int")).alias("ambiguous"), F.sum(F.col("failed").cast("int")).alias("failed"),
        F.sum(F.col("redundancy_penalized").cast("int")).alias("redundancy_penalties"), F.sum(F.col("utility_trap_demoted").cast("int")).alias("demotions"), F.round(F.percentile("raw_score", F.lit(0.95)), 3).alias("p95_raw"),
    )
    out = shown.agg(F.count(F.lit(1)).alias("results"), F.sum("token_est").alias("tokens_shown"), F.sum(F.col("below_threshold").cast("int")).alias("below_threshold"))
    one = F.lit(True)
    row = all_.join(F.broadcast(seen), on=one, how="inner").join(F.broadcast(out), on=one, how="inner")
    return row.withColumn("context_reduction", F.round(F.coalesce(1 - F.try_divide(F.col("tokens_shown"), F.col("tokens_evaluated")), F.lit(0.0)), 4))


def fast(files: DataFrame, query: str, size: int = 100, overlap: int = 20, top: int = 10) -> DataFrame:
    """The lexical answer alone."""
    return lexical.rank_fast(chunking.with_index(chunking.slices(files, size, overlap)), query, top)


def task_chunks(chunks: DataFrame, tasks: DataFrame, top: int = 5, exponent: float = V.LENGTH_EXPONENTS["lfm"]) -> DataFrame:
    """Evaluation rows of many tasks at once: each task's top chunks with four probability stages."""
    from ..functions import scores as S

    ranked = lexical.rank_many(chunks, tasks.select(F.col("task_id").alias("query_id"), "terms"), top, ("id", "file_path", "token_est", "content_hash"))
    # a few rows per task, kept as each metric reads them anew
    j = cut(ranked).join(tasks.select(F.col("task_id").alias("query_id"), "target_file_substr"), "query_id")
    yes, no = S.hash_log_probabilities(F.concat_ws(":", F.col("query_id").cast("string"), "content_hash"))
    raw = F.round(S.sigmoid(yes - no), 4)
    j = j.withColumns({"p_raw": raw, "p_len": S.length_score(yes, no, F.col("token_est"), exponent)})
    j = j.withColumn("p_intent", F.round(S.with_prior(F.col("p_len"), F.lit(V.PRIORS["SPECIFICATION"]["doc"]), 0.5), 4))
    return j.withColumn("p_cal", S.platt(F.col("p_intent"))).select(F.col("query_id").alias("task_id"), "rank", "id", "file_path", F.contains("file_path", F.col("target_file_substr")).cast("double").alias("y_true"), "p_raw", "p_len", "p_intent", "p_cal")
