"""From model scores to a ranked, cited answer: priors, clamp, diversity, policy, manifest.

Every step works per query when `by` names a query column, so many queries are ranked at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import scores as S
from ..functions import text as T
from ..functions import vocab as V


def prior_delta(intent: str, is_test: Column, is_doc: Column) -> Column:
    table = V.PRIORS[intent]
    return F.when(is_test, table["test"]).when(is_doc, table["doc"]).otherwise(0.0)


# Words that carry no identity within a symbol.
SYMBOL_FILLER = ("from", "to", "is", "for", "the", "in", "of", "and", "by", "with")


def symbol_delta(q: Q.Query, symbol: Column, file_path: Column, content: Column, is_test: Column, strict_reference: bool = False) -> tuple[Column, Column]:
    """(logit delta, matched): how strongly the query names the chunk's symbol.

    strict_reference lets an absent symbol match any long identifier, as empty text lies in every text."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce(symbol, F.lit("")), r"\s*\((?:part|lines?)\s+[^)]+\)", "")))
    text = q.text.lower()
    tokens = sorted(set(re.findall(r"[a-z0-9_]+", text)))
    words = sorted(set(re.findall(r"\b[a-z0-9]+\b", text)))
    whole = (name != "") & (name != "module_scope") & F.array_contains(T.strings(tokens), name)
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.trim(F.coalesce(symbol, F.lit(""))), "([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+"), F.lower), lambda p: (F.length(p) >= 2) & ~p.isin(*SYMBOL_FILLER))
    begun = lambda p: F.exists(T.strings(words), lambda w: w.startswith(p))
    shared = F.filter(parts, begun)
    ratio = F.when(F.size(parts) >= 2, F.size(shared) / F.size(parts)).otherwise(0.0)
    path = F.lower(F.coalesce(file_path, F.lit("")))
    half = F.lit(0.85) + F.when(F.exists(shared, lambda p: F.contains(path, p)), 0.35).otherwise(0.0)
    by_parts = F.when(ratio == 1.0, 1.60).when(ratio >= 0.75, 1.10).when(ratio >= 0.5, half).otherwise(0.0)
    delta = F.greatest(F.when(whole, 1.40).otherwise(0.0), by_parts)
    if q.intent == "REFACTOR":
        delta = delta - F.when(is_test, 0.35).otherwise(0.0)
    matched = whole | (by_parts > 0)
    fallback = F.lit(0.0)
    for ident in q.identifiers:
        low = ident.lower()
        near = F.contains(name, F.lit(low)) | F.contains(F.lit(low), name)
        if not strict_reference:
            near = near & (name != "")
        defines = F.lit(False)
        for form in (f"def {ident}", f"function {ident}", f"const {ident}", f"let {ident}", f"{ident} = ", f"{ident}("):
            defines = defines | F.contains(content, F.lit(form))
        found = F.when(name == low, 1.60).when(near if len(ident) >= 4 else F.lit(False), 1.10).when(defines, 0.75).otherwise(0.0)
        fallback = F.greatest(fallback, found)
    if q.identifiers:
        delta = F.when(~matched, F.greatest(delta, F.when(fallback > 0, fallback).otherwise(delta))).otherwise(delta)
        matched = matched | (fallback > 0)
    return delta, matched


def alignment(q: Q.Query, symbol: Column, file_path: Column, content: Column, lines: Column) -> Column:
    """Counters of a chunk's stake in the query's domain and of its symptom words, as a struct."""
    d = q.decomposition
    domain, symptoms = T.strings(d.domain), T.strings(d.symptoms)
    own = F.array_distinct(F.concat(T.symbol_components(symbol), T.lexical_terms(file_path)))
    name = F.lower(F.coalesce(symbol, F.lit("")))
    words = sorted(set(re.findall(r"[a-z0-9_]+", q.text.lower())))
    named = (name != "") & (name != "module_scope") & (name.isin(*([i.lower() for i in q.identifiers] or [""])) | F.array_contains(T.strings(words), name))

    def in_structure(structural):
        return [F.array_contains(structural, a) & F.array_contains(structural, b) for a, b in (p.split(" ") for p in d.phrases)]

    def count(flags):
        return sum((f.cast("int") for f in flags), F.lit(0))

    def of(body: Column, structural: Column) -> Column:
        in_either = F.array_distinct(F.concat(structural, body))
        # all words are folded only where a phrase may be
        whole = T.held(F.array_join(T.lexical_terms(content), " "), lambda text: count([s | F.contains(text, F.lit(p)) for s, p in zip(in_structure(structural), d.phrases)]))
        return F.struct(
            F.size(F.array_intersect(domain, in_either)).alias("domain_hits"),
            F.size(F.array_intersect(domain, structural)).alias("structural_domain_hits"),
            T.occurrences(body, domain).alias("content_domain_tf"),
            T.occurrences(body, symptoms).alias("symptom_tf"),
            F.when(T.may_hold_phrase(content, d.phrases), whole).otherwise(count(in_structure(structural))).alias("phrase_hits"),
            F.size(F.array_intersect(symptoms, in_either)).alias("symptom_hits"),
            T.symbol_role(symbol, content, file_path, lines).alias("symbol_role"),
            named.alias("named"),
        )

    held = F.struct(T.terms_among(content, [*d.domain, *d.symptoms]).alias("body"), own.alias("structural"))
    return T.held(held, lambda h: of(h["body"], h["structural"]))


def trap_delta(q: Q.Query, a: Column) -> Column:
    """Log-odds for owning the domain, and against helpers and chunks that only share symptom words."""
    if not q.decomposition.domain:
        return F.lit(0.0)
    owns = (a["symbol_role"] == "PUBLIC_API") & (a["structural_domain_hits"] >= 1)
    boost = V.CENTRALITY * T.saturate(a["structural_domain_hits"]) + V.PHRASE * T.saturate(a["phrase_hits"])
    outside = (a["domain_hits"] == 0) & ~a["named"]
    helper = V.HELPER_PENALTY * (1.0 + V.HELPER_DENSITY * T.saturate(a["content_domain_tf"] + a["symptom_tf"], V.TF_K))
    symptom = V.SYMPTOM_PENALTY * (1.0 + V.SYMPTOM_DENSITY * T.saturate(a["symptom_tf"], V.TF_K))
    zero = F.lit(0.0)
    return F.when(owns, boost).otherwise(zero) + F.when(outside & (a["symbol_role"] == "INTERNAL_HELPER"), helper).otherwise(zero) + F.when(outside & (a["symptom_hits"] >= 1), symptom).otherwise(zero)


def decide(scored: DataFrame, q: Q.Query) -> DataFrame:
    """chunks with raw_score -> plus alignment, deltas, decision_score and calibrated_score."""
    lines = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    out = scored.withColumn("alignment", alignment(q, F.col("symbol"), F.col("file_path"), F.col("content"), lines))
    by_symbol, matched = symbol_delta(q, F.col("symbol"), F.col("file_path"), F.col("content"), F.col("is_test"))
    delta = prior_delta(q.intent, F.col("is_test"), T.is_doc(F.col("file_path"), F.col("symbol"))) + by_symbol + trap_delta(q, F.col("alignment"))
    out = out.withColumns({"logit_delta": delta, "symbol_boosted": matched})
    out = out.withColumn("decision_score", F.round(S.with_prior(F.col("raw_score"), F.col("logit_delta"), q.confidence), 4))
    return out.withColumn("calibrated_score", S.platt(F.col("decision_score")))


def _scalars(rows: DataFrame, aggregates: list[Column], by: list[str]) -> DataFrame:
    """rows joined with aggregates of their query (or of all rows): a grouped aggregate, combined before
    the shuffle, instead of a window that sorts."""
    if by:
        return rows.join(rows.groupBy(*by).agg(*aggregates), by)
    return rows.join(F.broadcast(rows.agg(*aggregates)), how="inner", on=F.lit(True))


def clamp_domain(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """No chunk outside the domain scores above the third-best anchor, less 0.02."""
    if not by:
        anchors = rows.where("structural_domain_hits >= 1").select("decision_score").orderBy(F.desc("decision_score")).limit(3)
        floor = anchors.agg(F.min("decision_score").alias("floor"))
        held = rows.join(F.broadcast(floor), how="inner", on=F.lit(True))
    else:
        w = Window.partitionBy(*by).orderBy(F.desc("decision_score"))
        third = rows.where("structural_domain_hits >= 1").withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy(*by).agg(F.min("decision_score").alias("floor"))
        held = rows.join(third, by, "left")
    ceiling = F.round(F.greatest(F.lit(0.0), F.col("floor") - 0.02), 4)
    demoted = F.coalesce((F.col("domain_hits") == 0) & ~F.col("named") & (F.col("decision_score") > ceiling), F.lit(False))
    return held.withColumns({"decision_score": F.when(demoted, ceiling).otherwise(F.col("decision_score")), "utility_trap_demoted": demoted}).drop("floor")


def diversify(rows: DataFrame, by: list[str] | None = None, penalty: float = V.REDUNDANCY, exempt: float = V.SIBLING_EXEMPT) -> DataFrame:
    """Each later chunk of a file loses `penalty` in log-odds, unless it scores `exempt` or more.

    The greedy selection has a closed form: a file's best chunk is never a sibling and is always taken
    before the others, so siblings are known from ranks within files.  Order among rows of score zero may
    differ from the greedy loop's."""
    w = Window.partitionBy(*(by or []), "file_path").orderBy(F.desc("decision_score"), "chunk_idx")
    sibling = F.coalesce((F.col("file_path") != "") & (F.row_number().over(w) > 1) & (F.col("decision_score") < exempt), F.lit(False))
    out = rows.withColumn("redundancy_penalized", sibling)
    lowered = S.sigmoid(S.logit(F.col("decision_score")) - F.lit(penalty))
    return out.withColumns({"order_score": F.when(F.col("redundancy_penalized"), lowered).otherwise(F.col("decision_score")), "decision_score": F.when(F.col("redundancy_penalized"), F.round(lowered, 4)).otherwise(F.col("decision_score"))})


def policy(rows: DataFrame, threshold: float, by: list[str] | None = None, top_k: int | None = None, margin: float = V.MARGIN, allow_empty: bool = False, abstain_below: float = V.ABSTAIN_BELOW, strict: bool = False, bug_tests: bool = False) -> DataFrame:
    """The rows of the answer, with rank, below_threshold and included_by: `policy`, `fallback` or `bug_test`.

    rows need order_score, decision_score, chunk_idx and is_test (ground_truth_status if strict).
    The answer's bounds are found from grouped aggregates; only rows that may be shown are sorted."""
    by = by or []
    top = F.max(F.struct("order_score", -F.col("chunk_idx"), "decision_score")).alias("best")
    held = _scalars(rows, [top, F.count(F.lit(1)).alias("n")], by).withColumn("top", F.col("best.decision_score"))
    passing = F.lit(True) if threshold == 0.0 else (F.col("decision_score") >= F.col("top") - F.lit(margin)) & (F.col("decision_score") >= F.lit(threshold))
    held = _scalars(held.drop("best").withColumn("passing", passing), [F.sum(F.col("passing").cast("int")).alias("n_pass")], by)
    w = Window.partitionBy(*by).orderBy(F.desc("order_score"), "chunk_idx") if by else Window.orderBy(F.desc("order_score"), "chunk_idx")
    short = F.col("n_pass") < F.least(F.lit(V.FLOOR), F.col("n"))
    if by:
        ranked = held.withColumn("rank", F.row_number().over(w))
    else:
        # the window sees passing rows and a bounded head only
        head = held.orderBy(F.desc("order_score"), "chunk_idx").limit(V.FLOOR).select("chunk_idx", F.lit(True).alias("head"))
        ranked = held.join(F.broadcast(head), "chunk_idx", "left").where("passing or head").drop("head").withColumn("rank", F.row_number().over(w))
    keep = F.when(short, F.col("rank") <= F.least(F.lit(V.FLOOR), F.col("n"))).otherwise(F.col("passing"))
    if allow_empty:
        keep = keep & (F.col("top") >= abstain_below)
    shown = ranked.where(keep).withColumns({"below_threshold": F.col("decision_score") < threshold, "included_by": F.when(F.col("decision_score") < threshold, "fallback").otherwise("policy")})
    if strict:
        shown = shown.where(F.col("ground_truth_status").isin("VERIFIED", "UNVERIFIED_RAW_TEXT"))
    if top_k is not None:
        again = Window.partitionBy(*by).orderBy("rank") if by else Window.orderBy("rank")
        shown = shown.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= top_k)
    shown = shown.drop("n", "n_pass", "passing")
    return _with_test(shown, held, threshold, by, top_k, allow_empty, abstain_below) if bug_tests else shown.drop("top")


def _with_test(shown: DataFrame, held: DataFrame, threshold: float, by: list[str], top_k: int | None, allow_empty: bool, abstain_below: float) -> DataFrame:
    """The best test chunk joins the answer; with a full answer it replaces the last row."""
    keys = by or [F.lit(1).alias("one")]
    tests = held.where("is_test")
    if allow_empty:
        tests = tests.where(F.col("top") >= abstain_below)
    best = tests.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in held.columns]), F.struct("order_score", -F.col("chunk_idx"))).alias("t")).select("t.*")
    new = best.join(shown.select(*by, "chunk_idx"), [*by, "chunk_idx"], "left_anti").drop("n", "n_pass", "passing")
    size = shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    new = new.join(size, by, "left") if by else new.join(F.broadcast(size.select("size")), how="left", on=F.lit(True))
    size_now = F.coalesce("size", F.lit(0))
    last = F.least(size_now + 1, F.lit(top_k)) if top_k is not None else size_now + 1
    new = new.withColumns({"rank": last.cast("int"), "below_threshold": F.col("decision_score") < threshold, "included_by": F.lit("bug_test")}).drop("size")
    kept = shown.join(new.select(*by, F.col("rank").alias("taken")), by, "left") if by else shown.join(F.broadcast(new.select(F.col("rank").alias("taken"))), how="left", on=F.lit(True))
    return kept.where("taken is null or rank < taken").drop("taken").unionByName(new.select(*[c for c in shown.columns])).drop("top")


def verify(chunks: DataFrame, file_lines: DataFrame) -> DataFrame:
    """ground_truth_status of cited line ranges, by a join with (file_path, line_count); scores of what is not there are 0."""
    joined = chunks.join(file_lines, "file_path", "left")
    bad = (F.col("start_line") < 1) | (F.col("end_line") > F.col("line_count")) | (F.col("start_line") > F.col("end_line"))
    status = F.when(F.col("file_path").isNull(), "UNVERIFIED_RAW_TEXT").when(F.col("line_count").isNull(), "FILE_NOT_FOUND").when(bad, "INVALID_LINE_RANGE").otherwise("VERIFIED")
    out = joined.withColumn("ground_truth_status", status).drop("line_count")
    lost = F.col("ground_truth_status").isin("INVALID_LINE_RANGE", "FILE_NOT_FOUND")
    return out.withColumns({c: F.when(lost, 0.0).otherwise(F.col(c)) for c in ("raw_score", "decision_score", "calibrated_score", "order_score") if c in out.columns})


def raw_snippet(content: Column) -> Column:
    """The first 300 characters, for text without a file."""
    return F.substring(content, 1, 300)


def snippet(content: Column) -> Column:
    """The first nine lines."""
    return F.array_join(F.slice(F.split(content, "\n"), 1, 9), "\n")


def manifest(chunks: DataFrame, scores: DataFrame, answer: DataFrame) -> DataFrame:
    """One row per candidate file: chunks, best score (0 where unscored), symbols, included or omitted."""
    path = F.coalesce("file_path", F.lit("raw_text"))
    scored = chunks.join(scores.select("chunk_idx", "decision_score"), "chunk_idx", "left")
    files = scored.groupBy(path.alias("file_path")).agg(
        F.count(F.lit(1)).alias("chunks_count"),
        F.max(F.coalesce("decision_score", F.lit(0.0))).alias("max_score"),
        F.array_sort(F.collect_set(F.when(F.col("symbol") != "", F.col("symbol")))).alias("symbols"),
        F.min_by("is_test", "chunk_idx").alias("is_test"),
    )
    shown = answer.where("file_path is not null").select("file_path").distinct().withColumn("shown", F.lit(True))
    return files.join(shown, "file_path", "left").withColumn("status", F.when(F.col("shown"), "included").otherwise("omitted")).drop("shown")


def fuse_lexical(rows: DataFrame, by: list[str] | None = None, head: int | None = None) -> DataFrame:
    """Scores shifted by the lexical z-score over all kept candidates (rows: raw_score, lexical_score,
    error); with head, only so many rows in lexical order are returned.  Failed rows are untouched."""
    by = by or []
    held = _scalars(rows, [F.avg("lexical_score").alias("mean"), F.stddev_pop("lexical_score").alias("sd")], by)
    z = F.greatest(F.lit(-V.FUSION_MAX), F.least(F.lit(V.FUSION_MAX), (F.col("lexical_score") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(V.FUSION_FLOOR))))
    fused = F.round(S.sigmoid(S.logit(F.col("raw_score"), V.FUSION_EPS) + z), 4)
    out = held.withColumn("score", F.when(F.col("error"), F.col("raw_score")).otherwise(fused)).drop("mean", "sd")
    if head is None:
        return out
    if not by:
        return out.orderBy(F.desc("lexical_score"), "chunk_idx").limit(head)
    w = Window.partitionBy(*by).orderBy(F.desc("lexical_score"), "chunk_idx")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= head).drop("r")


def group_slices(rows: DataFrame) -> DataFrame:
    """Results per architectural slice, best first: slice, max_score, items (ids by score)."""
    return (
        rows.withColumn("slice", T.slice_of(F.col("file_path")))
        .groupBy("slice")
        .agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n_items"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_idx", "id"))), lambda x: x["id"]).alias("items"))
        .orderBy(F.desc("max_score"), "slice")
    )


def lookup_scores(chunks: DataFrame, cache: DataFrame, legacy_fallback: bool = False) -> DataFrame:
    """chunks (cache_key, content_hash, normalized_query) with cached score columns and `cached`.

    legacy_fallback also takes the newest row of the same query and content under any other key."""
    keyed = cache.groupBy("cache_key").agg(F.max_by(F.struct("score", "logprob_yes", "logprob_no"), "created_at").alias("hit"))
    out = chunks.join(keyed, "cache_key", "left")
    if legacy_fallback:
        old = cache.groupBy("normalized_query", F.col("chunk_hash").alias("content_hash")).agg(F.max_by(F.struct("score", "logprob_yes", "logprob_no"), "created_at").alias("old"))
        out = out.join(old, ["normalized_query", "content_hash"], "left").withColumn("hit", F.coalesce("hit", "old")).drop("old")
    return out.withColumns({"cached": F.col("hit").isNotNull(), "cached_score": F.col("hit.score"), "cached_yes": F.col("hit.logprob_yes"), "cached_no": F.col("hit.logprob_no")}).drop("hit")
