"""Grounded review: claims are kept only if their evidence is in the cited lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def parse_claims(replies: DataFrame, most: int = 4) -> DataFrame:
    """(candidate_id, claim_no, text, evidence) from `FINDING: ... | EVIDENCE: ...` lines of replies, `most` per chunk."""
    lines = replies.select("candidate_id", F.posexplode(F.split("reply", "\r\n|\r|\n")).alias("line_no", "line"))
    pattern = r"(?i)^\s*(?:[-*]\s*)?FINDING:\s*(.*?)\s*\|\s*EVIDENCE:\s*(.*?)\s*$"
    found = lines.where(F.col("line").rlike(pattern)).select("candidate_id", "line_no", F.regexp_extract("line", pattern, 1).alias("text"), F.regexp_extract("line", pattern, 2).alias("evidence"))
    w = Window.partitionBy("candidate_id").orderBy("line_no")
    return found.withColumn("claim_no", F.row_number().over(w)).where(F.col("claim_no") <= most).drop("line_no")


def citation_lines(cited: DataFrame, files: DataFrame) -> DataFrame:
    """cited (file_path, start_line, end_line) with `lines`, the physical lines that it names; null if the file is not there or the range
    does not lie in it."""
    body = F.split("body", "\n")
    body = F.when(F.get(body, F.size(body) - 1) == "", F.slice(body, 1, F.size(body) - 1)).otherwise(body)
    # only files that are cited are split
    known = files.join(cited.select("file_path").distinct(), "file_path", "left_semi").select("file_path", body.alias("all_lines"))
    fits = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.size("all_lines"))
    part = F.when(fits, F.slice("all_lines", F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))))
    return cited.join(known, "file_path", "left").withColumn("lines", part).drop("all_lines")


def review(cited: DataFrame, files: DataFrame, replies: DataFrame, judged: DataFrame | None = None, most: int = 4) -> DataFrame:
    """Findings and dropped claims: candidate_id, claim_no, text, evidence, evidence_line, reason (null: a finding).

    cited: verified results (candidate_id, file_path, start_line, end_line); replies: (candidate_id, reply), null where the model
    failed; judged: (candidate_id, claim_no) with the four columns of judge().  A citation that cannot be read is one row without a
    text, with reason CHUNK_UNREADABLE."""
    lined = citation_lines(cited, files)
    unread = lined.where("lines is null").select("candidate_id", F.lit(0).alias("claim_no"), F.lit("").alias("text"), F.lit("").alias("evidence"), F.lit(None).cast("int").alias("evidence_line"), F.lit("CHUNK_UNREADABLE").alias("reason"))
    claims = parse_claims(replies, most).join(lined.where("lines is not null").select("candidate_id", "lines", "start_line"), "candidate_id")
    gated = gate(claims)
    if judged is not None:
        gated = judge(gated.join(judged, ["candidate_id", "claim_no"], "left"))
    return gated.select("candidate_id", "claim_no", "text", "evidence", "evidence_line", "reason").unionByName(unread)


def review_counts(cited: DataFrame, replies: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: chunks_reviewed, claims_generated, claims_verified, claims_dropped, model_failures.

    A chunk that cannot be read is neither asked nor failed."""
    unread = reviewed.where("reason = 'CHUNK_UNREADABLE'").select("candidate_id")
    failed = replies.where("reply is null").join(cited.select("candidate_id"), "candidate_id", "left_semi").join(unread, "candidate_id", "left_anti")
    claims = reviewed.agg(F.count_if(F.coalesce("reason", F.lit("")) != "CHUNK_UNREADABLE").alias("claims_generated"), F.count_if(F.col("reason").isNull()).alias("claims_verified"), F.count_if(F.col("reason").isNotNull()).alias("claims_dropped"))
    one = F.lit(True)
    return cited.agg(F.count(F.lit(1)).alias("chunks_reviewed")).join(claims, on=one, how="inner").join(failed.agg(F.count(F.lit(1)).alias("model_failures")), on=one, how="inner")


def report_lines(cited: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(candidate_id, claim_no, line): one line of a text report per finding or dropped claim."""
    j = reviewed.join(cited.select("candidate_id", "file_path", "start_line"), "candidate_id")
    found = F.concat(F.lit("  [verified] "), "file_path", F.lit(":"), F.coalesce("evidence_line", "start_line").cast("string"), F.lit(" - "), "text")
    lost = F.concat(F.lit("  [dropped:"), "reason", F.lit("] "), F.when(F.col("text") != "", F.col("text")).otherwise(F.col("file_path")))
    return j.select("candidate_id", "claim_no", F.when(F.col("reason").isNull(), found).otherwise(lost).alias("line"))


def bare_evidence(evidence: Column) -> Column:
    """Evidence without quotes around it, white space normalised."""
    return T.normal_space(F.regexp_replace(F.trim(evidence), "^[`\"']+|[`\"']+$", ""))


def claim_identifiers(text: Column) -> Column:
    """Code names in a claim: back-quoted ones, camel or snake case, calls."""
    quoted = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_$][A-Za-z0-9_$]*)`"), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_$])([a-z]+(?:[A-Z][A-Za-z0-9]*)+)"), F.lit(1))
    snake = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_$])([A-Za-z0-9]+(?:_[A-Za-z0-9]+)+)"), F.lit(1))
    calls = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\(\)"), F.lit(1))
    return F.array_distinct(F.concat(quoted, camel, snake, calls))


def locate(evidence: Column, lines: Column, start_line: Column) -> Column:
    """Line on which the evidence begins: within one line, else across lines of the joined text."""
    clean = F.transform(lines, T.normal_space)
    single = F.array_position(F.transform(clean, lambda x: F.contains(x, evidence)), True)
    joined = F.array_join(F.filter(clean, lambda x: x != ""), " ")
    at = F.call_function("locate", evidence, joined)
    ends = F.aggregate(
        clean,
        F.struct(F.lit(0).alias("pos"), F.lit(0).alias("no"), F.lit(None).cast("int").alias("hit")),
        lambda a, x: F.struct((a["pos"] + F.when(x == "", 0).otherwise(F.length(x) + 1)).alias("pos"), (a["no"] + 1).alias("no"), F.coalesce(a["hit"], F.when((x != "") & (at <= a["pos"] + F.length(x) + 1), a["no"])).alias("hit")),
    )
    return F.when(single > 0, (start_line + single - 1).cast("int")).when(F.coalesce(at, F.lit(0)) > 0, (start_line + ends["hit"]).cast("int"))


def gate(claims: DataFrame) -> DataFrame:
    """claims (text, evidence, lines array, start_line) with evidence_line and reason; a null reason passes.

    Order: EMPTY_EVIDENCE, EVIDENCE_TOO_SHORT, EVIDENCE_NOT_FOUND, CLAIM_SYMBOL_NOT_IN_CHUNK."""
    e = bare_evidence(F.coalesce("evidence", F.lit("")))
    out = claims.withColumn("bare", e).withColumn("evidence_line", F.when(F.length("bare") >= V.EVIDENCE_LEAST, locate(F.col("bare"), F.col("lines"), F.col("start_line"))))
    body = F.array_join("lines", "\n")
    invented = F.exists(claim_identifiers(F.coalesce("text", F.lit(""))), lambda i: ~F.contains(body, i))
    reason = F.when(F.col("bare") == "", "EMPTY_EVIDENCE").when(F.length("bare") < V.EVIDENCE_LEAST, "EVIDENCE_TOO_SHORT").when(F.col("evidence_line").isNull(), "EVIDENCE_NOT_FOUND").when(invented, "CLAIM_SYMBOL_NOT_IN_CHUNK")
    return out.withColumn("reason", reason).drop("bare")


def judge(gated: DataFrame, support: float = 0.5, contradiction: float = 0.5) -> DataFrame:
    """reason after judges (support_status, support_score, contradiction_status, contradiction_score, statuses
    scored, failed or skipped): unsupported or contradicted claims go; failed support is SUPPORT_UNVERIFIED."""
    failed = F.when(F.col("support_status") == "failed", "SUPPORT_UNVERIFIED").when((F.col("support_status") == "scored") & (F.col("support_score") < support), "CLAIM_NOT_SUPPORTED")
    against = F.when((F.col("contradiction_status") == "scored") & (F.col("contradiction_score") >= contradiction), "CLAIM_CONTRADICTED")
    return gated.withColumn("reason", F.coalesce("reason", failed, against))


def trust(labelled: DataFrame) -> DataFrame:
    """Precision of reported claims with and without gates, from (supported boolean, reason)."""
    shown = F.col("reason").isNull()
    good = F.col("supported")
    return labelled.agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum(shown.cast("int")).alias("reported"),
        F.round(F.try_divide(F.sum((shown & good).cast("double")), F.sum(shown.cast("int"))), 4).alias("precision_with_gates"),
        F.round(F.avg(good.cast("double")), 4).alias("precision_without_gates"),
        F.round(F.try_divide(F.sum((shown & good).cast("double")), F.sum(good.cast("int"))), 4).alias("recall"),
    )
