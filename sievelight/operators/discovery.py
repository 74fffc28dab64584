"""Candidate files for a query, by path and body hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..functions import vocab as V


def discover(files: DataFrame, query: str, extra_terms: tuple = (), limit: int = V.DISCOVERY_LIMIT) -> DataFrame:
    """Files (file_idx, file_path, body) by score: every term is looked for in paths, the first few in
    bodies; tests count half.  Without any hit the first files by path are a sample."""
    base = Q.search_terms(query)
    more = [t for t in dict.fromkeys((e or "").lower().strip() for e in extra_terms) if t and t not in base]
    if not base:
        return files.select("file_path", F.lit(0.0).alias("score")).limit(0)
    weight = {**dict.fromkeys(base, 1.0), **dict.fromkeys(more, V.EXPANDED_WEIGHT)}
    in_body = base[: V.BODY_TERMS] + more[: V.EXPANDED_BODY_TERMS]
    path, body = F.lower("file_path"), F.lower("body")
    hits = sum((F.when(F.contains(path, F.lit(t)), F.lit(V.PATH_WEIGHT * w)).otherwise(0.0) for t, w in weight.items()), F.lit(0.0))
    hits = hits + sum((F.when(F.contains(body, F.lit(t)), F.lit(weight[t])).otherwise(0.0) for t in in_body), F.lit(0.0))
    score = hits * F.when(T.is_test_path(F.col("file_path")), V.TEST_FACTOR).otherwise(1.0)
    scored = files.select("file_path", score.alias("score"))
    depth = F.length("file_path") - F.length(F.replace("file_path", F.lit("/"), F.lit("")))
    best = scored.where("score > 0").orderBy(F.desc("score"), depth, "file_path").limit(limit)
    # the sample is taken only when `best` is empty: one row says so
    some = best.agg(F.count(F.lit(1)).alias("hits"))
    sample = files.select("file_path", F.lit(0.0).alias("score")).orderBy("file_path").limit(V.NO_MATCH_FILES).join(F.broadcast(some.where("hits = 0")), how="inner", on=F.lit(True)).select("file_path", "score")
    return best.unionByName(sample)


def discover_tokens(files: DataFrame, query: str, limit: int = V.DISCOVERY_LIMIT) -> DataFrame:
    """As discover(), with whole-token keys on paths without their extension; a term whose keys an earlier
    term already has adds nothing."""
    terms, seen = [], set()
    for t in Q.search_terms(query):
        keys = Q.term_keys(t)
        if not set(keys) <= seen:
            terms.append((t, keys))
        seen |= set(keys)
    keyed = files.withColumn("keys", T.token_keys(F.regexp_replace("file_path", r"\.[^./]*$", "")))
    body = F.lower("body")
    hits = sum((F.when(F.arrays_overlap("keys", T.strings(k)), V.PATH_WEIGHT).otherwise(0.0) for _, k in terms), F.lit(0.0))
    hits = hits + sum((F.when(F.contains(body, F.lit(t)), 1.0).otherwise(0.0) for t in Q.search_terms(query)[: V.BODY_TERMS]), F.lit(0.0))
    score = hits * F.when(T.is_test_path(F.col("file_path")), V.TEST_FACTOR).otherwise(1.0)
    depth = F.length("file_path") - F.length(F.replace("file_path", F.lit("/"), F.lit("")))
    return keyed.select("file_path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), depth, "file_path").limit(limit)


def body_hits(files: DataFrame, terms: list[str]) -> DataFrame:
    """(file_path, term) for every term that a body holds."""
    return files.select("file_path", F.explode(F.filter(T.strings(terms), lambda t: F.contains(F.lower("body"), t))).alias("term"))


def live_expansions(cache: DataFrame, now_ms, days: int = 30) -> DataFrame:
    """Cached query expansions (key, terms, ts in ms) that are not older than `days`, the newest per key."""
    fresh = cache.where(F.lit(now_ms) - F.col("ts") <= days * 86_400_000)
    order = Window.partitionBy("key").orderBy(F.desc("ts"))
    return fresh.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
