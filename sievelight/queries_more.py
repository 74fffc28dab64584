"""Registered queries of the hook's answers, the review pipeline, usage reports, evaluation summaries and sources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import schemas
from .functions import vocab as V
from .operators import chunking, hooks, lexical, metrics, review, usage
from .queries import _EVAL_CTES, _FAST, _FILES, _UNIT, _USAGE, OVERLAP, QUERY, SIZE, _chunks, _eval_rows, _files, _logit, _register, _slices_of, _table, _unit, _usage
from .service import reports
from .sources import files as source

# --- tiers and answers over a lexical head ------------------------------------------------------------

_DIRTY = "(file_idx % 7 = 3)"


def _dirty(spark, sf_dir):
    return _files(spark, sf_dir).where("file_idx % 7 = 3").select(F.col("file_path").alias("path"))


@_register("fast_rank_dirty", f"WITH {_FAST}, d AS (SELECT fast.*, file_idx FROM fast JOIN placed USING (chunk_idx)), s AS (SELECT chunk_idx, fast.id, score + CASE WHEN {_DIRTY} THEN 6.0 ELSE 0 END AS score FROM d fast) SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, chunk_idx) AS INT) AS rank FROM s ORDER BY score DESC, chunk_idx LIMIT 10")
def fast_rank_dirty(spark, sf_dir):
    return lexical.rank_fast(_slices_of(spark, sf_dir), QUERY, dirty_files=_dirty(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "rank")


_TWO = f"WITH {_FAST}, c AS (SELECT fast.chunk_idx, fast.id, score + CASE WHEN {_DIRTY} THEN 6.0 ELSE 0 END AS score FROM fast JOIN placed USING (chunk_idx) WHERE {_DIRTY}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_idx) AS r, count(*) OVER () AS n FROM c)"


@_register("two_tier", f"{_TWO} SELECT id, round(score, 6) AS score, CASE WHEN n <= {V.TIER1_BYPASS} THEN 'small_candidate_set' ELSE 'filtered_' || n || '_to_' || least(n, {V.TIER1_KEEP}) END AS reason, n > {V.TIER1_BYPASS} AS tier1_applied FROM r WHERE n <= {V.TIER1_BYPASS} OR r <= {V.TIER1_KEEP}")
def two_tier(spark, sf_dir):
    out = lexical.two_tier(_slices_of(spark, sf_dir), QUERY, _dirty(spark, sf_dir), dirty_only=True)
    return out.select("id", F.round("score", 6).alias("score"), "reason", "tier1_applied")


def _candidates(spark, sf_dir):
    """Documents as scored candidates of one query per language and remainder of the id."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(
        F.col("doc_id").alias("chunk_idx"), F.concat(F.coalesce("lang", F.lit("none")), (F.col("doc_id") % 11).cast("string")).alias("query_id"), F.round(_unit("doc_id"), 4).alias("raw_score"), (F.length("text") % 37).cast("double").alias("lexical_score"),
        (F.col("doc_id") % 13 == 0).alias("error"), F.concat(F.lit("/"), "source", F.lit(".txt")).alias("file_path"), (F.col("doc_id") % 50 + 1).cast("int").alias("start_line"), (F.col("doc_id") % 50 + 9).cast("int").alias("end_line"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("symbol"),
    )


_CAND = f"""cd AS (SELECT doc_id AS chunk_idx, coalesce(lang, 'none') || (doc_id % 11) AS query_id, round({_UNIT.format('CAST(doc_id AS VARCHAR)')}, 4) AS raw_score, CAST(length(text) % 37 AS DOUBLE) AS lexical_score, doc_id % 13 = 0 AS error, '/' || source || '.txt' AS file_path,
  doc_id % 50 + 1 AS start_line, doc_id % 50 + 9 AS end_line, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 's' || doc_id END AS symbol FROM documents WHERE text IS NOT NULL),
fz AS (SELECT *, avg(lexical_score) OVER (PARTITION BY query_id) AS mean, stddev_pop(lexical_score) OVER (PARTITION BY query_id) AS sd, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_idx) AS place FROM cd),
fu AS (SELECT *, CASE WHEN error THEN raw_score ELSE round(1 / (1 + exp(-({_logit('raw_score', '1e-4')} + greatest(-3.0, least(3.0, (lexical_score - mean) / greatest(sd, 3.0)))))), 4) END AS score FROM fz)"""
_HEAD = f"""{_CAND}, h0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank, count(*) FILTER (WHERE score >= 0.65) OVER (PARTITION BY query_id) AS ok FROM fu WHERE place <= 16)"""


@_register("head_or_best", f"WITH {_HEAD} SELECT query_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM h0 WHERE CASE WHEN ok > 0 THEN score >= 0.65 ELSE rank <= 3 END")
def head_or_best(spark, sf_dir):
    return hooks.head_or_best(_candidates(spark, sf_dir), ["query_id"], 0.65).select("query_id", "chunk_idx", "score", "rank")


_BUDGET = f"""{_CAND}, b0 AS (SELECT *, NOT error AND raw_score >= 0.65 AS good FROM fu WHERE place <= {hooks.CHUNKS}),
b1 AS (SELECT b.*, (SELECT count(*) FROM b0 x WHERE x.query_id = b.query_id AND x.good AND x.place <= ((b.place - 1) // {hooks.BATCH}) * {hooks.BATCH}) AS begun FROM b0 b),
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM b1 WHERE begun < {hooks.TOP} AND NOT error AND score >= 0.65), cited AS (SELECT * FROM b2 WHERE rank <= {hooks.TOP})"""


@_register("within_budget", f"WITH {_BUDGET} SELECT query_id, chunk_idx, score, CAST(rank AS INT) AS rank FROM cited")
def within_budget(spark, sf_dir):
    return hooks.within_budget(_candidates(spark, sf_dir), ["query_id"]).select("query_id", "chunk_idx", "score", "rank")


def _percent(x: str) -> str:
    return f"printf('%.1f', round(round({x} * 100, 6), 1)) || '%'"


@_register("citation_message", f"""WITH {_BUDGET} SELECT query_id, 'Code citations for this prompt, ranked by a local model:' || chr(10) || string_agg('- ' || file_path || ':' || start_line || '-' || end_line || ' (' || CASE WHEN symbol = '' THEN 'module scope' ELSE symbol END || '), confidence ' || {_percent('score')} || ' (model ' || {_percent('raw_score')} || ')', chr(10) ORDER BY rank) AS message FROM cited GROUP BY 1""")
def citation_message(spark, sf_dir):
    return hooks.citation_message(hooks.within_budget(_candidates(spark, sf_dir), ["query_id"]), ["query_id"])


@_register("injected_message", f"""WITH {_HEAD}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS k FROM h0 WHERE CASE WHEN ok > 0 THEN score >= 0.65 ELSE rank <= 3 END AND score >= 0.65)
SELECT query_id, 'Pre-computed code citations for your task:' || chr(10) || string_agg('* ' || file_path || ':' || start_line || '-' || end_line || ' (' || symbol || ') - confidence: ' || {_percent('score')}, chr(10) ORDER BY k) || chr(10) || 'Tip: read the cited line ranges only.' AS message FROM p WHERE k <= 3 GROUP BY 1""")
def injected_message(spark, sf_dir):
    return hooks.injected_message(hooks.head_or_best(_candidates(spark, sf_dir), ["query_id"], 0.65), ["query_id"])


@_register("decisions", """WITH p AS (SELECT conv_id * 1000 + turn AS prompt_id, coalesce(text, '') AS query, turn % 3 = 1 AS code, turn % 3 = 2 AS machine, turn % 5 <> 4 AS found, turn % 7 <> 6 AS server, turn % 2 = 1 AS hit FROM conversations),
o AS (SELECT *, CASE WHEN NOT code THEN CASE WHEN machine THEN 'machine-text' ELSE 'not-code' END WHEN NOT server THEN 'no-server' WHEN NOT found THEN 'no-candidates' WHEN NOT hit THEN 'no-hits' ELSE 'cited' END AS outcome FROM p)
SELECT prompt_id, 'hook' AS caller, query, code AS is_code_question, code AS queried, outcome, CASE WHEN outcome = 'cited' THEN '/a.py:1-9,/b.py:' || (prompt_id % 90) || '-99' ELSE '' END AS top FROM o""")
def decisions(spark, sf_dir):
    conv = _table(spark, sf_dir, "conversations")
    prompts = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"), "turn")
    cited = prompts.where("turn % 2 = 1").select("prompt_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("/a.py").alias("file_path"), F.lit(1).cast("bigint").alias("start_line"), F.lit(9).alias("end_line")), F.struct(F.lit(2).alias("rank"), F.lit("/b.py").alias("file_path"), (F.col("prompt_id") % 90).cast("bigint").alias("start_line"), F.lit(99).alias("end_line")))).alias("c")).select("prompt_id", "c.*")
    turn = F.col("turn")
    return hooks.decisions(prompts, cited, turn % 3 == 2, turn % 3 == 1, turn % 5 != 4, turn % 7 != 6).withColumn("top", F.array_join("top", ","))


# --- review ---------------------------------------------------------------------------------------------

_CITED = f"""{_FILES}, parts AS (SELECT file_idx, file_path, string_split(body, chr(10)) AS p FROM files), whole AS (SELECT file_idx, file_path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM parts),
ct AS (SELECT file_idx AS candidate_id, CASE WHEN file_idx % 10 = 9 THEN '/gone.txt' ELSE file_path END AS file_path, CAST(file_idx % 3 AS INT) AS start_line, CAST(file_idx % 3 + file_idx % 6 AS INT) AS end_line FROM files),
cl AS (SELECT ct.*, CASE WHEN start_line >= 1 AND end_line >= start_line AND end_line <= len(l) THEN l[start_line:end_line] END AS lines FROM ct LEFT JOIN whole USING (file_path))"""


def _cited(spark, sf_dir):
    i = F.col("file_idx")
    return _files(spark, sf_dir).select(i.alias("candidate_id"), F.when(i % 10 == 9, "/gone.txt").otherwise(F.col("file_path")).alias("file_path"), (i % 3).cast("int").alias("start_line"), (i % 3 + i % 6).cast("int").alias("end_line"))


@_register("citation_lines", f"WITH {_CITED} SELECT candidate_id, array_to_string(lines, chr(10)) AS lines FROM cl")
def citation_lines(spark, sf_dir):
    return review.citation_lines(_cited(spark, sf_dir), _files(spark, sf_dir)).select("candidate_id", F.array_join("lines", "\n").alias("lines"))


# claims 0 to 5 of a reply; claim 0 quotes the first line of the citation
_EVIDENCE = "CASE k WHEN 0 THEN substr(trim(regexp_replace(first, '\\s+', ' '{flags})), 1, 60) WHEN 1 THEN '' WHEN 2 THEN 'tiny' WHEN 3 THEN 'there is no such line at all' ELSE 'xy zz' END"
_SAFE = "replace(replace({0}, '|', ' '), '`', ' ')"
_REVIEW = f"""{_CITED}, raw AS (SELECT candidate_id, coalesce(lines[1], '') AS first0 FROM cl WHERE lines IS NOT NULL AND candidate_id % 8 <> 7), base AS (SELECT candidate_id, {_SAFE.format('first0')} AS first, first0 FROM raw),
ev AS (SELECT candidate_id, k, 'claim ' || k AS text, trim({_EVIDENCE.format(flags=", 'g'")}) AS e, trim(regexp_replace(first0, '\\s+', ' ', 'g')) AS own FROM base, range(6) r(k)),
ok AS (SELECT candidate_id, k, text, regexp_replace(e, '^[`"'']+|[`"'']+$', '', 'g') AS e, own FROM ev WHERE k < 4),
gt AS (SELECT candidate_id, k + 1 AS claim_no, text, e, CASE WHEN e = '' THEN 'EMPTY_EVIDENCE' WHEN length(e) < {V.EVIDENCE_LEAST} THEN 'EVIDENCE_TOO_SHORT' WHEN k = 0 AND contains(own, e) THEN NULL ELSE 'EVIDENCE_NOT_FOUND' END AS r0 FROM ok),
jd AS (SELECT *, coalesce(r0, CASE WHEN candidate_id % 5 = 0 THEN 'SUPPORT_UNVERIFIED' WHEN candidate_id % 5 = 1 THEN 'CLAIM_NOT_SUPPORTED' WHEN candidate_id % 5 = 2 AND candidate_id % 4 = 0 THEN 'CLAIM_CONTRADICTED' END) AS reason FROM gt),
rv AS (SELECT candidate_id, CAST(claim_no AS INT) AS claim_no, text, reason FROM jd UNION ALL SELECT candidate_id, 0, '', 'CHUNK_UNREADABLE' FROM cl WHERE lines IS NULL)"""


def _reviewed(spark, sf_dir):
    files, cited = _files(spark, sf_dir), _cited(spark, sf_dir)
    first = F.expr("replace(replace(coalesce(element_at(lines, 1), ''), '|', ' '), '`', ' ')")
    base = review.citation_lines(cited, files).where("lines is not null").select("candidate_id", first.alias("first"))
    claims = [F.concat(F.lit(f"FINDING: claim {k} | EVIDENCE: "), F.expr(_EVIDENCE.format(flags="").replace("\\s", "\\\\s").replace("CASE k", f"CASE {k}"))) for k in range(6)]
    replies = base.select("candidate_id", F.when(F.col("candidate_id") % 8 != 7, F.concat_ws("\n", *claims)).alias("reply"))
    i = F.col("candidate_id")
    judged = base.select("candidate_id", F.explode(F.array(*[F.lit(n) for n in range(1, 5)])).alias("claim_no"), F.when(i % 5 == 0, "failed").when(i % 5 == 3, "skipped").otherwise("scored").alias("support_status"), F.when(i % 5 == 1, 0.2).otherwise(0.9).alias("support_score"), F.when(i % 5 == 2, "scored").otherwise("failed").alias("contradiction_status"), F.when(i % 4 == 0, 0.7).otherwise(0.1).alias("contradiction_score"))
    return cited, replies, review.review(cited, files, replies, judged)


@_register("review_claims", f"WITH {_REVIEW} SELECT candidate_id, claim_no, text, reason FROM rv")
def review_claims(spark, sf_dir):
    return _reviewed(spark, sf_dir)[2].select("candidate_id", F.col("claim_no").cast("int").alias("claim_no"), "text", "reason")


@_register("review_counts", f"WITH {_REVIEW} SELECT (SELECT count(*) FROM cl) AS chunks_reviewed, (SELECT count(*) FROM jd) AS claims_generated, (SELECT count(*) FROM rv WHERE reason IS NULL) AS claims_verified, (SELECT count(*) FROM rv WHERE reason IS NOT NULL) AS claims_dropped, (SELECT count(*) FROM cl WHERE lines IS NOT NULL AND candidate_id % 8 = 7) AS model_failures")
def review_counts(spark, sf_dir):
    return review.review_counts(*_reviewed(spark, sf_dir))


@_register("review_report", f"WITH {_REVIEW} SELECT candidate_id, claim_no, CASE WHEN reason IS NULL THEN '  [verified] ' || file_path || ':' || start_line || ' - ' || text ELSE '  [dropped:' || reason || '] ' || CASE WHEN text <> '' THEN text ELSE file_path END END AS line FROM rv JOIN ct USING (candidate_id)")
def review_report(spark, sf_dir):
    cited, _, out = _reviewed(spark, sf_dir)
    return review.report_lines(cited, out).withColumn("claim_no", F.col("claim_no").cast("int"))


_TRUST = "tr AS (SELECT doc_id % 3 <> 0 AS supported, CASE WHEN doc_id % 4 = 0 THEN 'EVIDENCE_NOT_FOUND' END AS reason FROM documents)"


@_register("review_trust", f"WITH {_TRUST} SELECT count(*) AS claims, CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS reported, round(count(*) FILTER (WHERE reason IS NULL AND supported) / count(*) FILTER (WHERE reason IS NULL), 4) AS precision_with_gates, round(count(*) FILTER (WHERE supported) / count(*), 4) AS precision_without_gates, round(count(*) FILTER (WHERE reason IS NULL AND supported) / count(*) FILTER (WHERE supported), 4) AS recall FROM tr")
def review_trust(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 != 0).alias("supported"), F.when(F.col("doc_id") % 4 == 0, "EVIDENCE_NOT_FOUND").alias("reason"))
    return review.trust(rows).withColumn("reported", F.col("reported").cast("bigint"))


# --- usage and evaluation -------------------------------------------------------------------------------


@_register("usage_report", f"""WITH {_USAGE}, c AS (SELECT coalesce(caller, 'unknown') AS caller, count(*) AS n, median(latencyMs) AS m FROM usage WHERE queried GROUP BY 1), h AS (SELECT count(*) AS p, sum(CAST(queried AS INT)) AS q FROM usage WHERE caller = 'hook' AND outcome <> 'machine-text')
SELECT 0 AS part, '' AS caller, 'Queries: ' || (SELECT sum(n) FROM c) AS line UNION ALL SELECT 1, caller, '  ' || rpad(caller, greatest(6, length(caller))::INT, ' ') || ' ' || lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INT, ' ') || ' queries  median ' || printf('%.1f', m / 1000) || ' s' FROM c
UNION ALL SELECT 2, '', 'Hook prompts that queried: ' || q || ' of ' || p || ' (' || printf('%.1f', q * 100.0::DOUBLE / p) || '%)' FROM h""")
def usage_report(spark, sf_dir):
    rows = _usage(spark, sf_dir)
    return usage.report_lines(usage.latency_by_caller(rows), usage.hook_share(rows))


_TELE = """te AS (SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS chunks_evaluated, CAST(l_linenumber AS BIGINT) AS cache_hits, CAST(l_quantity - l_linenumber AS BIGINT) AS cache_misses, CAST(l_linenumber % 3 AS BIGINT) AS ambiguous, CAST(l_partkey AS BIGINT) AS prompt_tokens, CAST(l_suppkey AS BIGINT) AS completion_tokens,
 CAST(l_linenumber % 4 AS DOUBLE) * 100 AS prefill_rate, CAST(l_linenumber % 5 AS DOUBLE) AS decode_rate, CAST(l_quantity AS DOUBLE) * 10 AS latency_p95, l_linenumber = 1 AS floor_triggered, l_linenumber = 2 AS abstained, CAST(l_linenumber AS DOUBLE) / 4 AS reduction_ratio, CAST(l_linenumber % 2 AS DOUBLE) / 2 AS yes_rate, CAST(l_linenumber % 3 AS DOUBLE) / 4 AS no_rate, CAST(l_linenumber % 2 AS BIGINT) AS redundancy_penalties, CAST(l_linenumber % 6 AS BIGINT) AS symbol_boosts FROM lineitem)"""
_TOTALS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in ("chunks_evaluated", "cache_hits", "cache_misses", "ambiguous", "prompt_tokens", "completion_tokens", "redundancy_penalties", "symbol_boosts"))
_MEANS = ", ".join(f"round(avg({c}) FILTER (WHERE {c} > 0), {n}) AS avg_{c}" for c, n in (("prefill_rate", 1), ("decode_rate", 1), ("reduction_ratio", 2), ("yes_rate", 4), ("no_rate", 4)))
_RATES = ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}_count, round(count(*) FILTER (WHERE {c}) / count(*), 4) AS {c}_rate" for c in ("floor_triggered", "abstained"))


@_register("telemetry_summary", f"WITH {_TELE} SELECT count(*) AS total_tasks, {_TOTALS}, round(sum(cache_hits) / sum(chunks_evaluated), 4) AS cache_hit_rate, round(sum(ambiguous) / sum(chunks_evaluated), 4) AS ambiguous_rate, {_MEANS}, round(max(latency_p95), 2) AS latency_p95, {_RATES} FROM te")
def telemetry_summary(spark, sf_dir):
    columns = _TELE[_TELE.index("SELECT ") + 7 : _TELE.index(" FROM lineitem")]
    return metrics.telemetry_summary(_table(spark, sf_dir, "lineitem").selectExpr(*re.split(r",\s+", columns)))


@_register("top_metadata", f"WITH {_EVAL_CTES} SELECT ev.task_id, string_agg(ev.rank || ' ' || c.file_path || ' ' || c.start_line || '-' || c.end_line, ';' ORDER BY ev.rank) AS top FROM ev JOIN chunks c USING (id) WHERE ev.rank <= 3 GROUP BY 1")
def top_metadata(spark, sf_dir):
    rows = _eval_rows(spark, sf_dir, "start_line", "end_line", "is_test").withColumn("raw_score", F.col("score"))
    text = F.transform("top", lambda x: F.concat(x["rank"].cast("string"), F.lit(" "), x["file_path"], F.lit(" "), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string")))
    return metrics.top_metadata(rows).select("task_id", F.array_join(text, ";").alias("top"))


# --- sources --------------------------------------------------------------------------------------------

_INPUTS = "ip AS (SELECT doc_id AS no, CASE doc_id % 4 WHEN 0 THEN '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' WHEN 1 THEN '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt:12: hit' WHEN 2 THEN '/no/such.txt:7' ELSE 'raw text ' || doc_id END AS value FROM documents)"


def _inputs(spark, sf_dir):
    i, path = F.col("doc_id"), F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select(i.alias("no"), F.when(i % 4 == 0, path).when(i % 4 == 1, F.concat(path, F.lit(":12: hit"))).when(i % 4 == 2, "/no/such.txt:7").otherwise(F.concat(F.lit("raw text "), i.cast("string"))).alias("value"))


@_register("candidate_inputs", f"WITH {_FILES}, {_INPUTS}, cutp AS (SELECT no, value, CASE WHEN contains(value, ':') THEN string_split(value, ':')[1] ELSE value END AS head FROM ip) SELECT no, CASE WHEN f.file_path IS NOT NULL THEN head ELSE value END AS candidate, f.file_path IS NOT NULL AS is_path FROM cutp LEFT JOIN files f ON f.file_path = head")
def candidate_inputs(spark, sf_dir):
    return source.candidate_inputs(_inputs(spark, sf_dir), _files(spark, sf_dir))


@_register("prepared_inputs", f"WITH {_FILES}, {_INPUTS}, cutp AS (SELECT no, value, CASE WHEN contains(value, ':') THEN string_split(value, ':')[1] ELSE value END AS head FROM ip) SELECT no AS file_idx, f.file_path, CASE WHEN f.file_path IS NOT NULL THEN f.body ELSE value END AS body FROM cutp LEFT JOIN files f ON f.file_path = head")
def prepared_inputs(spark, sf_dir):
    return source.prepared_inputs(_inputs(spark, sf_dir), _files(spark, sf_dir))


@_register("sliced_once", f"WITH {_FAST} SELECT id, sha256(content) AS content_hash FROM placed")
def sliced_once(spark, sf_dir):
    return source.sliced_once(_files(spark, sf_dir), lambda f: chunking.slices(f, SIZE, OVERLAP)).select("id", F.sha2("content", 256).alias("content_hash"))


@_register("binary_sniff", "SELECT doc_id, doc_id % 5 = 0 OR doc_id % 5 = 1 AS is_binary FROM documents WHERE text IS NOT NULL AND length(text) >= 10")
def binary_sniff(spark, sf_dir):
    # a NUL at the front, or a byte that begins no character
    i = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents").where("text is not null and length(text) >= 10")
    raw = F.when(i % 5 == 0, F.concat(F.unhex(F.lit("4100")), F.encode("text", "UTF-8"))).when(i % 5 == 1, F.concat(F.unhex(F.lit("41FF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", source.is_binary(raw).alias("is_binary"))


@_register("path_keyword_files", f"WITH {_FILES}, s AS (SELECT file_path, file_idx, 2 * (CAST(contains(lower(file_path), 'src3') AS INT) + CAST(contains(lower(file_path), '/de/') AS INT) + CAST(contains(lower(file_path), '17') AS INT) * 0) AS path_score FROM files) SELECT file_path, path_score FROM s ORDER BY path_score DESC, file_idx LIMIT 30")
def path_keyword_files(spark, sf_dir):
    return source.path_keyword_files(_files(spark, sf_dir), ["src3", "/de/", "17"]).select("file_path", "path_score")


@_register("resolve_paths", f"WITH {_FILES} SELECT DISTINCT file_path FROM files WHERE regexp_matches(file_path, '^/src1/[^/]*/[^/]*5\\.txt$') OR regexp_matches(file_path, '^/(.*/)?fr/[^/]1\\.txt$') OR starts_with(file_path, '/src2/de/') ORDER BY file_path LIMIT 200")
def resolve_paths(spark, sf_dir):
    return source.resolve_paths(_files(spark, sf_dir), ["/src1/*/*5.txt", "/**/fr/?1.txt", "/src2/de"]).select("file_path")


@_register("last_user_request", "WITH t AS (SELECT conv_id * 1000 + turn AS n, coalesce(text, '') AS text, turn % 2 AS k FROM conversations WHERE role = 'user' AND turn % 3 <> 2) SELECT arg_max(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), n) AS request FROM t WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def last_user_request(spark, sf_dir):
    conv = _table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    content = F.when(turn % 2 == 0, F.concat(F.lit("before <USER_REQUEST>"), F.coalesce("text", F.lit("")), F.lit("</USER_REQUEST> after"))).otherwise(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("role") == "user", "USER_INPUT").otherwise("REPLY")
    line = F.when(turn % 3 == 2, F.lit('{"type": "USER_INPUT", "content": "torn')).otherwise(F.to_json(F.struct(kind.alias("type"), content.alias("content"))))
    asked = conv.where("regexp_replace(coalesce(text, ''), '\\\\s+', '') != ''")
    return source.last_user_request(asked.select((F.col("conv_id") * 1000 + turn).alias("line_no"), line.alias("value")))


@_register("put_scores", "WITH s AS (SELECT sha256(CAST(doc_id // 3 AS VARCHAR)) AS cache_key, CAST(doc_id AS DOUBLE) / 8 AS score, doc_id AS created_at, doc_id % 7 = 0 AS ambiguous, doc_id % 11 = 0 AS failed FROM documents), c AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS cache_key FROM documents WHERE doc_id % 5 = 0), n AS (SELECT cache_key, max(created_at) AS created_at, arg_max(score, created_at) AS score FROM s WHERE NOT ambiguous AND NOT failed GROUP BY 1) SELECT cache_key, score FROM n WHERE cache_key NOT IN (SELECT cache_key FROM c)")
def put_scores(spark, sf_dir):
    docs, i = _table(spark, sf_dir, "documents"), F.col("doc_id")
    scores = docs.select(F.sha2(F.floor(i / 3).cast("string"), 256).alias("cache_key"), (i.cast("double") / 8).alias("score"), i.alias("created_at"), (i % 7 == 0).alias("ambiguous"), (i % 11 == 0).alias("failed"))
    cache = docs.where("doc_id % 5 = 0").select(F.sha2(i.cast("string"), 256).alias("cache_key"))
    return source.put_scores(scores, cache).select("cache_key", "score")


@_register("expansion_cache", "SELECT doc_id, 'k' || (doc_id % 50) AS key FROM documents WHERE doc_id % 40 < 30")
def expansion_cache(spark, sf_dir):
    i = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("k"), (i % 50).cast("string")).alias("key"), F.array(F.lit("term")).alias("terms"), (F.lit(1_700_000_000_000) - (i % 40) * 86_400_000).alias("ts"))
    return source.fresh_expansions(rows, 1_700_000_000_000).select("doc_id", "key")


# --- reports --------------------------------------------------------------------------------------------


@_register("markdown_report", "SELECT CAST(0 AS BIGINT) AS place, '| n_nationkey | n_name | n_regionkey |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS BIGINT), '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM nation")
def markdown_report(spark, sf_dir):
    return reports.markdown_lines(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@_register("json_report", """SELECT '{"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}' AS value FROM lineitem""")
def json_report(spark, sf_dir):
    return reports.json_lines(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"))


_STATUS = "[{}]".format(", ".join(f"'{s}'" for s in schemas.STATUSES))


@_register("result_report", f"""WITH r AS (SELECT doc_id, {_STATUS}[doc_id % 7 + 1] AS status, doc_id % 4 = 0 AS below, round({_UNIT.format('CAST(doc_id AS VARCHAR)')}, 4) AS score FROM documents)
SELECT doc_id AS rank, '#' || doc_id || ' | ' || {_percent('score')} || ' | /d/' || doc_id || '.txt:1-' || (doc_id % 90 + 1) || ' | ' || CASE WHEN below THEN 'FLOOR (SUB-THR)' ELSE CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.BADGES.items())} END END AS line FROM r""")
def result_report(spark, sf_dir):
    i = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select(i.alias("rank"), F.round(_unit("doc_id"), 4).alias("calibrated_score"), F.concat(F.lit("/d/"), i.cast("string"), F.lit(".txt")).alias("file_path"), F.lit(1).alias("start_line"), (i % 90 + 1).alias("end_line"), F.get(F.array(*[F.lit(s) for s in schemas.STATUSES]), (i % 7).cast("int")).alias("ground_truth_status"), (i % 4 == 0).alias("below_threshold"))
    return reports.result_lines(rows)


@_register("parsed_claims", """WITH c AS (SELECT doc_id AS candidate_id, unnest(range(1, 6)) AS k FROM documents), l AS (SELECT candidate_id, k, CASE WHEN (candidate_id + k) % 3 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY candidate_id, (candidate_id + k) % 3 = 0 ORDER BY k) END AS n FROM c)
SELECT candidate_id, 'claim ' || k AS text, 'line ' || (candidate_id % 7) AS evidence, CAST(n AS INT) AS claim_no FROM l WHERE n <= 3""")
def parsed_claims(spark, sf_dir):
    line = lambda k: F.when((F.col("doc_id") + k) % 3 == 0, F.concat(F.lit("remark "), F.lit(str(k)))).otherwise(F.concat(F.lit(f"- finding:  claim {k} | Evidence: line "), (F.col("doc_id") % 7).cast("string"), F.lit(" ")))
    replies = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), F.concat_ws("\n", *[line(k) for k in range(1, 6)]).alias("reply"))
    return review.parse_claims(replies, 3).select("candidate_id", "text", "evidence", "claim_no")


@_register("usage_log", "SELECT event_id, event_type AS caller, value AS \"latencyMs\" FROM events WHERE event_id % 6 <> 0")
def usage_log(spark, sf_dir):
    # every sixth line is torn
    e = _table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("query"), F.col("event_type").alias("caller"), F.col("value").alias("latencyMs")))
    lines = e.select(F.when(F.col("event_id") % 6 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    return source.parse_usage(lines).select(F.col("query").cast("bigint").alias("event_id"), "caller", "latencyMs")
