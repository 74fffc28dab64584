"""Registered queries: each applies one operator to the driver's tables, with the same result in SQL.

How the tables are read: `documents` are files (path /source/lang/id.txt), `pages` give paths, `conversations`
prompts, `benchmark` queries, `events` a usage log (caller = event type, latency = value), `labels` and
`lineitem` probabilities with outcomes.  Chunk windows are ten lines with five in common, as documents are
short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import query as Q
from .functions import scores as S
from .functions import text as T
from .functions import vocab as V
from .operators import calibration, chunking, context, discovery, lexical, metrics, ranking, review, scoring, usage
from .plans import rerank as plan
from .sources import files as source

SIZE, OVERLAP = 10, 5
QUERY = "where is the thing about retion handled, and why does erthing of the onere crash with an error"
FLAGSHIP = "rerank"
QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark, sf_dir) -> DataFrame:
    return source.documents_as_files(spark, sf_dir)


def _chunks(spark, sf_dir) -> DataFrame:
    return chunking.with_index(chunking.windows(_files(spark, sf_dir), SIZE, OVERLAP))


def _slices_of(spark, sf_dir) -> DataFrame:
    return chunking.with_index(chunking.slices(_files(spark, sf_dir), SIZE, OVERLAP))


def _unit(key: str):
    """A number in (0, 1) from a hash of a text column."""
    return F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def _ranked(spark, sf_dir) -> DataFrame:
    """Documents as scored rows: one query per language, one file per source."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_idx"), F.col("lang").alias("query_id"), F.concat(F.lit("/"), F.col("source"), F.lit(".txt")).alias("file_path"), F.round(_unit("doc_id"), 4).alias("decision_score"), (F.col("doc_id") % 5 == 0).alias("is_test"), (F.col("doc_id") % 3).cast("int").alias("domain_hits"), F.when(F.col("doc_id") % 7 == 1, 1).otherwise(0).alias("structural_domain_hits"), (F.col("doc_id") % 11 == 0).alias("named"))


def _outcomes(spark, sf_dir) -> DataFrame:
    """(y, p) from lineitem: 600,000 rows at scale 0.1, 101 distinct scores."""
    return _table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.round((F.col("l_quantity") * 2 + F.col("l_discount") * 10) / 101, 4).alias("p"), "l_linestatus")


def _labelled(spark, sf_dir) -> DataFrame:
    """(doc_id, y, z): labels with logits drawn from a hash and the label."""
    lab = _table(spark, sf_dir, "labels").where("quality is not null")
    p = F.least(F.greatest(F.lit(0.25) * F.col("quality") + F.lit(0.6) * _unit("doc_id") + F.lit(0.05), F.lit(1e-6)), F.lit(1 - 1e-6))
    return lab.select("doc_id", F.col("quality").cast("double").alias("y"), F.round(F.ln(p / (1 - p)), 2).alias("z"))


# --- SQL fragments -----------------------------------------------------------------------------

_FILES = "files AS (SELECT doc_id AS file_idx, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' AS file_path, coalesce(text, '') AS body FROM documents)"
_LINES = "cut AS (SELECT file_idx, file_path, regexp_split_to_array(body, '\\r\\n|\\r|\\n') AS l FROM files), lined AS (SELECT file_idx, file_path, CASE WHEN l[len(l)] = '' THEN l[1:len(l)-1] ELSE l END AS lines FROM cut)"
_CHUNKS = f"""{_FILES}, {_LINES},
numbered AS (SELECT *, len(lines) AS n FROM lined WHERE len(lines) > 0),
begun AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((n - {SIZE}) / {SIZE - OVERLAP}.0)) AS INT) * {SIZE - OVERLAP}, {SIZE - OVERLAP})) AS s FROM numbered),
chunks AS (SELECT file_idx, file_path, CAST(s + 1 AS INT) AS start_line, CAST(least(n, s + {SIZE}) AS INT) AS end_line,
  file_path || ':' || (s + 1) || '-' || least(n, s + {SIZE}) AS id,
  array_to_string([(i)::VARCHAR || ': ' || lines[i] for i in generate_series(s + 1, least(n, s + {SIZE}))], chr(10)) AS content,
  CAST(coalesce(list_sum([strlen(lines[i]) + 1 for i in generate_series(1, s)]), 0) AS BIGINT) AS start_byte,
  CAST(coalesce(list_sum([strlen(lines[i]) + 1 for i in generate_series(1, least(n, s + {SIZE}))]), 0) - 1 AS BIGINT) AS end_byte,
  (file_idx << 32) + s + 1 AS chunk_idx FROM begun)"""


def _norm(x: str) -> str:
    return f"(CASE WHEN length({x}) <= 3 THEN {x} WHEN ends_with({x}, 'ies') AND length({x}) > 4 THEN {x}[:-4] || 'y' WHEN regexp_matches({x}, '(sses|shes|ches|xes)$') THEN {x}[:-3] WHEN regexp_matches({x}, '[^sui]s$') THEN {x}[:-2] ELSE {x} END)"


def _terms(text: str) -> str:
    return f"[{_norm('w')} for w in [lower(v) for v in regexp_extract_all({text}, '[a-zA-Z0-9]+')]]"


def _key(x: str) -> str:
    a = f"(CASE WHEN length({x}) > 4 AND ends_with({x}, 'ies') THEN {x}[:-4] || 'y' WHEN length({x}) > 4 AND regexp_matches({x}, '(s|x|z|ch|sh)es$') THEN {x}[:-3] WHEN length({x}) > 3 AND ends_with({x}, 's') AND NOT ends_with({x}, 'ss') THEN {x}[:-2] ELSE {x} END)"
    b = f"(CASE WHEN length({a}) > 5 AND ends_with({a}, 'ing') THEN {a}[:-4] ELSE {a} END)"
    return f"(CASE WHEN length({b}) > 3 AND ends_with({b}, 'e') THEN {b}[:-2] ELSE {b} END)"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _sat(c: str, k: float = 1.2) -> str:
    return f"(CASE WHEN {c} <= 0 THEN 0.0 ELSE {c} / ({c} + {k}) END)"


_UNIT = "(CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE)"
_RANKED = f"ranked AS (SELECT doc_id AS chunk_idx, lang AS query_id, '/' || source || '.txt' AS file_path, round({_UNIT.format('CAST(doc_id AS VARCHAR)')}, 4) AS decision_score, doc_id % 5 = 0 AS is_test, CAST(doc_id % 3 AS INT) AS domain_hits, CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END AS structural_domain_hits, doc_id % 11 = 0 AS named FROM documents)"
_OUTCOMES = "outcomes AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS y, round((l_quantity * 2 + l_discount * 10) / 101, 4) AS p, l_linestatus FROM lineitem)"
_LABELLED = f"lab0 AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, least(greatest(0.25 * quality + 0.6 * {_UNIT.format('CAST(doc_id AS VARCHAR)')} + 0.05, 1e-6), 1 - 1e-6) AS p FROM labels WHERE quality IS NOT NULL), labelled AS (SELECT doc_id, y, round(ln(p / (1 - p)), 2) AS z FROM lab0)"


# --- chunking and text ----------------------------------------------------------------------------


@_register("chunk_windows", f"WITH {_CHUNKS} SELECT id, file_path, start_line, end_line, start_byte, end_byte, sha256(content) AS content_hash, CAST(greatest(1, floor(length(content) / 3.6)) AS INT) AS token_est FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunking.windows(_files(spark, sf_dir), SIZE, OVERLAP).select("id", "file_path", "start_line", "end_line", "start_byte", "end_byte", "content_hash", "token_est")


_SLICES = f"""{_FILES}, parts AS (SELECT file_idx, file_path, string_split(body, chr(10)) AS lines FROM files),
numbered AS (SELECT *, len(lines) AS n FROM parts),
begun AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((n - {SIZE}) / {SIZE - OVERLAP}.0)) AS INT) * {SIZE - OVERLAP}, {SIZE - OVERLAP})) AS s FROM numbered),
slices AS (SELECT file_idx, file_path, CAST(s + 1 AS INT) AS start_line, CAST(least(n, s + {SIZE}) AS INT) AS end_line, (file_idx << 32) + s + 1 AS chunk_idx,
  [x for x in [regexp_extract(v, '^(?:export\\s+|public\\s+|static\\s+|async\\s+)*(?:class|interface|struct|function|def|fn|func|type)\\s+([A-Za-z0-9_]+)', 1) for v in lines[s+1:least(n, s+{SIZE})]] if x <> ''] AS found,
  array_to_string([(i)::VARCHAR || ': ' || lines[i] for i in generate_series(s + 1, least(n, s + {SIZE}))], chr(10)) AS content FROM begun),
placed AS (SELECT *, file_path || ':' || start_line || '-' || end_line || CASE WHEN len(found) > 0 THEN ':' || found[1] ELSE '' END AS id, coalesce(found[1], regexp_extract(file_path, '[^/]*$')) AS symbol FROM slices)"""


@_register("chunk_slices", f"WITH {_SLICES} SELECT id, symbol, start_line, end_line, sha256(content) AS content_hash, CAST(ceil(length(content) / 4) AS INT) AS token_est FROM placed")
def chunk_slices(spark, sf_dir):
    return chunking.slices(_files(spark, sf_dir), SIZE, OVERLAP).select("id", "symbol", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), "token_est")


@_register("cache_keys", f"WITH {_CHUNKS} SELECT id, sha256('where is it?:' || sha256(content) || ':lfm:v1:' || start_byte || '-' || end_byte || '::v0.3.2:') AS cache_key FROM chunks")
def cache_keys(spark, sf_dir):
    return scoring.cache_keys(_chunks(spark, sf_dir), "  Where is\n IT? ").select("id", "cache_key")


@_register("lexical_term_stats", f"WITH t AS (SELECT unnest({_terms('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t GROUP BY term) SELECT term, CAST(n AS BIGINT) AS n, round(n / (n + 1.2::DOUBLE), 6) AS saturated FROM c")
def lexical_term_stats(spark, sf_dir):
    terms = _table(spark, sf_dir, "documents").select(F.explode(T.lexical_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", "n", F.round(T.saturate(F.col("n")), 6).alias("saturated"))


_SPLIT = r"string_split(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), ' ')"


@_register("symbol_components", f"SELECT page_id, array_to_string([{_norm('w')} for w in string_split_regex(lower(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+') if w <> ''], ' ') AS components FROM pages")
def symbol_components(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(T.symbol_components(F.col("url")), " ").alias("components"))


@_register("token_keys", f"WITH w AS (SELECT page_id, [[p for p in {_SPLIT.format('v')} if p <> ''] for v in regexp_extract_all(url, '[A-Za-z0-9]+')] AS words FROM pages) SELECT page_id, array_to_string(list_sort(list_distinct(flatten([list_concat([{_key('p')} for p in q], [{_key('p')} for p in [q[i] || q[i+1] for i in generate_series(1, len(q) - 1)]]) for q in words]))), ' ') AS keys FROM w")
def token_keys(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(T.token_keys(F.col("url")))), " ").alias("keys"))


_TEST_SUB = " OR ".join(f"contains(lower(url), '{p}')" for p in V.TEST_PARTS)
_TEST_RULE = "(regexp_matches(lower({0}), '(^|/)(tests?|__tests__|specs?)(/|$)') OR regexp_matches(regexp_extract(lower({0}), '[^/]*$'), '\\.(test|spec)\\.[a-z0-9]+$') OR starts_with(regexp_extract(lower({0}), '[^/]*$'), 'test_') OR regexp_matches(regexp_extract(lower({0}), '[^/]*$'), '_test\\.[a-z0-9]+$'))"


@_register("path_is_test", f"SELECT page_id, ({_TEST_SUB}) AS by_substring, {_TEST_RULE.format('url')} AS by_rule FROM pages")
def path_is_test(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.is_test_substring(F.col("url")).alias("by_substring"), T.is_test_path(F.col("url")).alias("by_rule"))


_SLICE = """parts AS (SELECT page_id, [p for p in string_split(replace(path, '\\', '/'), '/') if p <> ''] AS q FROM paths),
pos AS (SELECT page_id, q, len(q) AS n, list_position([list_contains({roots}, lower(x)) for x in q[1:greatest(len(q)-1, 0)]], true) AS r, list_position(q, 'src') AS s FROM parts),
sliced AS (SELECT page_id, CASE WHEN coalesce(r, 0) > 0 THEN q[r + 1] WHEN coalesce(s, 0) > 0 AND s < n - 1 THEN q[s + 1] WHEN n > 1 THEN q[1] ELSE 'root' END AS slice FROM pos)""".format(roots=_list(V.SLICE_ROOTS))
_PATHS = "paths AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'apps/' WHEN 1 THEN 'src/' WHEN 2 THEN 'lib/Features/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def _paths(spark, sf_dir):
    lead = F.when(F.col("page_id") % 4 == 0, "apps/").when(F.col("page_id") % 4 == 1, "src/").when(F.col("page_id") % 4 == 2, "lib/Features/").otherwise("")
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(lead, F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


@_register("slice_detect", f"WITH {_PATHS}, {_SLICE} SELECT page_id, slice FROM sliced")
def slice_detect(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", T.slice_of(F.col("path")).alias("slice"))


@_register("slice_groups", f"WITH {_PATHS}, {_SLICE}, x AS (SELECT page_id, slice, round({_UNIT.format('CAST(page_id AS VARCHAR)')}, 4) AS score FROM sliced) SELECT slice, max(score) AS max_score, CAST(count(*) AS BIGINT) AS n_items, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY score DESC, page_id) AS items FROM x GROUP BY slice")
def slice_groups(spark, sf_dir):
    rows = _paths(spark, sf_dir).select(F.col("page_id").alias("chunk_idx"), F.col("page_id").cast("string").alias("id"), F.col("path").alias("file_path"), F.round(_unit("page_id"), 4).alias("score"))
    return ranking.group_slices(rows).withColumn("items", F.array_join("items", ","))


@_register("dedupe_by_hash", f"WITH {_CHUNKS} SELECT sha256(content) AS content_hash, min(chunk_idx) AS first_idx, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY 1")
def dedupe_by_hash(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("content_hash").agg(F.min("chunk_idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))


# --- discovery and tier one --------------------------------------------------------------------------

_BASE_TERMS = Q.search_terms(QUERY)
_EXTRA = ("tionre", "src3")
_EXPANDED = [t for t in _EXTRA if t not in _BASE_TERMS]
_PATH_SUM = " + ".join([f"CASE WHEN contains(lower(file_path), '{t}') THEN {V.PATH_WEIGHT * w} ELSE 0 END" for t, w in [*((t, 1.0) for t in _BASE_TERMS), *((t, V.EXPANDED_WEIGHT) for t in _EXPANDED)]])
_BODY_SUM = " + ".join([f"CASE WHEN contains(lower(body), '{t}') THEN {w} ELSE 0 END" for t, w in [*((t, 1.0) for t in _BASE_TERMS[: V.BODY_TERMS]), *((t, V.EXPANDED_WEIGHT) for t in _EXPANDED)]])


@_register("discover_files", f"WITH {_FILES}, s AS (SELECT file_path, CAST(({_PATH_SUM} + {_BODY_SUM}) * CASE WHEN {_TEST_RULE.format('file_path')} THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score FROM files) SELECT file_path, score FROM s WHERE score > 0 ORDER BY score DESC, length(file_path) - length(replace(file_path, '/', '')), file_path LIMIT {V.DISCOVERY_LIMIT}")
def discover_files(spark, sf_dir):
    return discovery.discover(_files(spark, sf_dir), QUERY, _EXTRA)


def _token_path_sum() -> str:
    out, seen = [], set()
    for t in Q.search_terms(QUERY):
        keys = Q.term_keys(t)
        if not set(keys) <= seen:
            out.append(f"CASE WHEN list_has_any(keys, {_list(keys)}) THEN {V.PATH_WEIGHT} ELSE 0 END")
        seen |= set(keys)
    return " + ".join(out)


_KEYS_OF = "flatten([list_concat([{k} for p in q], [{k} for p in [q[i] || q[i+1] for i in generate_series(1, len(q) - 1)]]) for q in [[p for p in {split} if p <> ''] for v in regexp_extract_all({{0}}, '[A-Za-z0-9]+')]])".format(k=_key("p"), split=_SPLIT.format("v"))


@_register("discover_files_token", f"WITH {_FILES}, k AS (SELECT *, {_KEYS_OF.format(chr(114) + 'egexp_replace(file_path, ' + chr(39) + r'\.[^./]*$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS keys FROM files), s AS (SELECT file_path, CAST(({_token_path_sum()} + {' + '.join(f'CASE WHEN contains(lower(body), {chr(39)}{t}{chr(39)}) THEN 1.0 ELSE 0 END' for t in _BASE_TERMS[: V.BODY_TERMS])}) * CASE WHEN {_TEST_RULE.format('file_path')} THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score FROM k) SELECT file_path, score FROM s WHERE score > 0 ORDER BY score DESC, length(file_path) - length(replace(file_path, '/', '')), file_path LIMIT {V.DISCOVERY_LIMIT}")
def discover_files_token(spark, sf_dir):
    return discovery.discover_tokens(_files(spark, sf_dir), QUERY)


_Q = Q.Query.of(QUERY)
_SCORED = f"""{_CHUNKS}, termed AS (SELECT *, {_terms('content')} AS terms, {_terms('file_path')} AS pterms FROM chunks),
counted AS (SELECT *, len([x for x in terms if list_contains({_list(_Q.content)}, x)]) AS tf, len(list_intersect(list_distinct(terms), {_list(_Q.content)})) AS covered, len([x for x in terms if list_contains({_list(_Q.symptoms)}, x)]) AS sym, len(list_intersect(list_distinct(pterms), {_list(_Q.content)})) AS onpath FROM termed),
scored AS (SELECT chunk_idx, id, file_path, start_line, end_line, content, round({V.W_PATH} * {_sat('onpath')} + {V.W_COVERAGE} * covered / {float(len(_Q.content))} + {V.W_FREQUENCY} * {_sat('tf', 3.0)} + {V.W_SYMPTOM} * {_sat('sym', 3.0)}, 4) AS lexical_score FROM counted)"""


@_register("tier1_scores", f"WITH {_SCORED} SELECT id, CAST(lexical_score AS DOUBLE) AS lexical_score FROM scored")
def tier1_scores(spark, sf_dir):
    return lexical.scored(_chunks(spark, sf_dir), _Q).select("id", "lexical_score")


_TIERED = f"{_SCORED}, tiered AS (SELECT *, row_number() OVER (ORDER BY lexical_score DESC, chunk_idx) AS r, count(*) OVER () AS total FROM scored)"


@_register("tier1_kept", f"WITH {_TIERED} SELECT id, CAST(CASE WHEN total > {V.TIER1_BYPASS} THEN lexical_score END AS DOUBLE) AS lexical_score, (total <= {V.TIER1_BYPASS} OR r <= {V.TIER1_KEEP}) AS kept, CASE WHEN total <= {V.TIER1_BYPASS} THEN 'small_candidate_set' WHEN total <= {V.TIER1_KEEP} THEN 'tier1_top_n_covers_all' ELSE 'tier1_lexical_prefilter' END AS reason FROM tiered")
def tier1_kept(spark, sf_dir):
    return lexical.tier_one(_chunks(spark, sf_dir), _Q).select("id", "lexical_score", "kept", "reason")


_PLAIN = Q.plain_terms(QUERY)


def _fast_sum() -> str:
    out = []
    for t in _PLAIN:
        k = _list(Q.term_keys(t))
        n = f"len([x for x in body if list_contains({k}, x)])"
        out.append(f"CASE WHEN list_has_any(names, {k}) THEN 10.0 ELSE 0 END + CASE WHEN list_has_any(pkeys, {k}) THEN 3.0 ELSE 0 END + 2.0 * ({n} / ({n} + 1.2))")
    return " + ".join(out)


_FAST = f"""{_SLICES}, keyed AS (SELECT *, {_KEYS_OF.format("regexp_extract(file_path, '[^/]*$')[:-5] || ' ' || symbol")} AS names, {_KEYS_OF.format("regexp_extract(file_path, '^(.*)/[^/]*$', 1) || ' ' || regexp_extract(file_path, '[^/]*$')[:-5]")} AS pkeys, {_KEYS_OF.format('content')} AS body FROM placed),
fast AS (SELECT chunk_idx, id, file_path, CAST({_fast_sum()} AS DOUBLE) AS score FROM keyed)"""


@_register("fast_rank", f"WITH {_FAST} SELECT id, file_path, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, chunk_idx) AS INT) AS rank FROM fast ORDER BY score DESC, chunk_idx LIMIT 10")
def fast_rank(spark, sf_dir):
    return plan.fast(_files(spark, sf_dir), QUERY, SIZE, OVERLAP).select("id", "file_path", F.round("score", 6).alias("score"), "rank")


_TASK_TERMS = "asked AS (SELECT item_id AS query_id, list_distinct({0}) AS terms FROM benchmark)".format(_terms("text"))
_MULTI = f"""{_CHUNKS}, {_TASK_TERMS}, t AS (SELECT chunk_idx, id, unnest({_terms('content')}) AS term FROM chunks), ix AS (SELECT chunk_idx, id, term, count(*) AS tf FROM t GROUP BY ALL),
a AS (SELECT query_id, len(terms) AS asked, unnest(terms) AS term FROM asked), j AS (SELECT query_id, asked, chunk_idx, id, count(*) AS hit, sum(tf) AS tf FROM ix JOIN a USING (term) GROUP BY ALL),
sc AS (SELECT query_id, chunk_idx, id, round({V.W_COVERAGE}::DOUBLE * hit / asked + {V.W_FREQUENCY}::DOUBLE * (tf / (tf + 3.0::DOUBLE)), 4) AS score FROM j), multi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM sc)"""


def _tasks(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.lexical_terms(F.col("text")).alias("terms"))


@_register("fast_rank_multi", f"WITH {_MULTI} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM multi WHERE rank <= 10")
def fast_rank_multi(spark, sf_dir):
    return lexical.rank_many(_chunks(spark, sf_dir), _tasks(spark, sf_dir)).select("query_id", "id", "score", "rank")


# --- scoring and ranking ---------------------------------------------------------------------------


def _logit(p: str, eps: str = "1e-6") -> str:
    x = f"least(greatest({p}, {eps}), 1 - {eps})"
    return f"ln({x} / (1 - {x}))"


_MODEL_U = f"least(greatest({_UNIT.format(chr(39) + 'v1:' + QUERY + ':' + chr(39) + ' || sha256(content)')}, 1e-6), 1 - 1e-6)"
_MODEL = f"{_CHUNKS}, u AS (SELECT *, {_MODEL_U} AS u, CAST(greatest(1, floor(length(content) / 3.6)) AS INT) AS token_est FROM chunks), modelled AS (SELECT *, round(1 / (1 + exp(-((ln(u) - ln(1 - u)) * power(120.0::DOUBLE / greatest(40.0, token_est), 0.15)))), 4) AS raw_score FROM u)"


@_register("model_scores", f"WITH {_MODEL} SELECT id, raw_score FROM modelled")
def model_scores(spark, sf_dir):
    return scoring.raw_scores(scoring.HashScorer().score(_chunks(spark, sf_dir), QUERY)).select("id", "raw_score")


def _counts(words, text="lower(text)") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


_INTENT = f"""c AS (SELECT conv_id, turn, {_counts(V.BUG_WORDS)} AS b, {_counts(V.SPEC_WORDS)} AS s, {_counts(V.REFACTOR_WORDS)} AS r, {_counts(V.IMPL_WORDS)} AS i FROM conversations WHERE text IS NOT NULL),
m AS (SELECT *, greatest(b, s, r, i) AS top FROM c)"""


@_register("intent_detect", f"WITH {_INTENT} SELECT conv_id, turn, CASE WHEN top = 0 THEN 'IMPLEMENTATION' WHEN b = top THEN 'BUG_DIAGNOSIS' WHEN s = top THEN 'SPECIFICATION' WHEN r = top THEN 'REFACTOR' ELSE 'IMPLEMENTATION' END AS intent, CAST(CASE WHEN top = 0 THEN 0.0 WHEN top = 1 OR CAST(b = top AS INT) + CAST(s = top AS INT) + CAST(r = top AS INT) + CAST(i = top AS INT) > 1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confidence FROM m")
def intent_detect(spark, sf_dir):
    intent, confidence = T.intent_of(F.col("text"))
    return _table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", intent.alias("intent"), confidence.alias("confidence"))


def _matches(regex: str) -> str:
    return "regexp_matches(p, '" + regex.replace("'", "''") + "')"


@_register("prompt_gate", f"WITH q AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS p FROM conversations) SELECT conv_id, turn, (length(p) >= 8 AND NOT ({' OR '.join(map(_matches, V.PROMPT_IGNORE))}) AND ({' OR '.join(map(_matches, V.PROMPT_SEARCH))})) AS wants FROM q")
def prompt_gate(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wants_rerank(F.col("text")).alias("wants"))


def _sql_regex(column: str, regex: str) -> str:
    return f"regexp_matches({column}, '" + regex.replace("'", "''") + "')"


_CODE_SQL = f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'where is parse_token defined ' WHEN turn % 3 = 2 THEN 'how is the cache sorted, ' ELSE '' END || coalesce(text, '') AS q FROM conversations),
b AS (SELECT *, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS t FROM a), c AS (SELECT *, lower(t) AS l, regexp_replace(regexp_replace(t, '{V.NOT_CODE[0]}', '', 'g'), '{V.NOT_CODE[1]}', '', 'g') AS s FROM b)
SELECT conv_id, turn, CASE WHEN length(t) < 8 OR regexp_matches(q, '^\\s*[</]') OR {_sql_regex('l', V.PROCESS_LEAD)} THEN false WHEN {' OR '.join(_sql_regex('s', r) for r in V.CODE_SIGNS)} THEN true
WHEN {_sql_regex('l', V.PROCESS_NOUNS)} OR {_sql_regex('l', V.ASKS_US)} THEN false
ELSE {_sql_regex('l', V.LOCATOR_UNIT)} OR ({_sql_regex('l', V.LOCATOR)} AND ({_sql_regex('l', V.CODE_VERB)} OR ({_sql_regex('l', V.SET_VERB)} AND NOT {_sql_regex('l', V.NOT_SET_VERB)}) OR {_sql_regex('l', V.PARTICIPLE)})) OR ({_sql_regex('l', V.MECHANISM)} AND ({_sql_regex('l', V.CODE_VERB)} OR ({_sql_regex('l', V.SET_VERB)} AND NOT {_sql_regex('l', V.NOT_SET_VERB)}))) OR {_sql_regex('l', V.DEBUGGING)} END AS asks FROM c"""


@_register("code_question", _CODE_SQL)
def code_question(spark, sf_dir):
    lead = F.when(F.col("turn") % 3 == 1, "where is parse_token defined ").when(F.col("turn") % 3 == 2, "how is the cache sorted, ").otherwise("")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_code_question(F.concat(lead, F.coalesce("text", F.lit("")))).alias("asks"))


_D = _Q.decomposition
_PHRASES = " + ".join(f"CAST((list_contains(pterms, '{p.split()[0]}') AND list_contains(pterms, '{p.split()[1]}')) OR contains(array_to_string(terms, ' '), '{p}') AS INT)" for p in _D.phrases) or "0"
_ALIGN = f"""{_CHUNKS}, termed AS (SELECT *, {_terms('content')} AS terms, list_distinct({_terms('file_path')}) AS pterms FROM chunks),
aligned AS (SELECT *, len(list_intersect({_list(_D.domain)}, list_distinct(list_concat(terms, pterms)))) AS domain_hits, len(list_intersect({_list(_D.domain)}, pterms)) AS structural, len([x for x in terms if list_contains({_list(_D.domain)}, x)]) AS domain_tf,
 len([x for x in terms if list_contains({_list(_D.symptoms)}, x)]) AS symptom_tf, len(list_intersect({_list(_D.symptoms)}, list_distinct(list_concat(terms, pterms)))) AS symptom_hits, {_PHRASES} AS phrase_hits FROM termed)"""


@_register("domain_alignment", f"WITH {_ALIGN} SELECT id, CAST(domain_hits AS INT) AS domain_hits, CAST(structural AS INT) AS structural_domain_hits, CAST(domain_tf AS INT) AS content_domain_tf, CAST(symptom_tf AS INT) AS symptom_tf, CAST(phrase_hits AS INT) AS phrase_hits, CAST(symptom_hits AS INT) AS symptom_hits FROM aligned")
def domain_alignment(spark, sf_dir):
    a = ranking.alignment(_Q, F.col("symbol"), F.col("file_path"), F.col("content"), F.col("end_line") - F.col("start_line") + 1)
    names = ("domain_hits", "structural_domain_hits", "content_domain_tf", "symptom_tf", "phrase_hits", "symptom_hits")
    return _chunks(spark, sf_dir).withColumn("a", a).select("id", *[F.col(f"a.{n}").cast("int").alias(n) for n in names])


# Window chunks have no symbol: no helper, no public surface, no symbol delta; .txt files are documentation.
_DELTA = f"({V.PRIORS[_Q.intent]['doc']}::DOUBLE + CASE WHEN symptom_hits >= 1 AND domain_hits = 0 THEN {V.SYMPTOM_PENALTY} * (1.0 + {V.SYMPTOM_DENSITY} * {_sat('symptom_tf', V.TF_K)}) ELSE 0 END)"
_DECIDED = f"""{_TIERED}, kept AS (SELECT chunk_idx FROM tiered WHERE total <= {V.TIER1_BYPASS} OR r <= {V.TIER1_KEEP}),
al AS (SELECT c.*, {_MODEL_U.replace('content', 'c.content')} AS u, {_terms('c.content')} AS terms, list_distinct({_terms('c.file_path')}) AS pterms FROM chunks c JOIN kept USING (chunk_idx)),
al2 AS (SELECT *, len(list_intersect({_list(_D.domain)}, list_distinct(list_concat(terms, pterms)))) AS domain_hits, len(list_intersect({_list(_D.domain)}, pterms)) AS structural, len([x for x in terms if list_contains({_list(_D.symptoms)}, x)]) AS symptom_tf, len(list_intersect({_list(_D.symptoms)}, list_distinct(list_concat(terms, pterms)))) AS symptom_hits,
 round(1 / (1 + exp(-((ln(u) - ln(1 - u)) * power(120.0::DOUBLE / greatest(40.0, greatest(1, floor(length(content) / 3.6))), 0.15)))), 4) AS raw_score FROM al),
al3 AS (SELECT *, {_DELTA} AS delta FROM al2),
decided AS (SELECT *, round(1 / (1 + exp(-({_logit('raw_score')} + delta * {_Q.confidence}))), 4) AS decision_score FROM al3)"""


@_register("prior_decision", f"WITH {_DECIDED} SELECT id, raw_score, round(delta, 6) AS logit_delta, decision_score, round(1 / (1 + exp(-({V.PLATT_A} * {_logit('decision_score')} - 2.1))), 4) AS calibrated_score FROM decided")
def prior_decision(spark, sf_dir):
    return plan.decided(_chunks(spark, sf_dir), _Q).select("id", "raw_score", F.round("logit_delta", 6).alias("logit_delta"), "decision_score", "calibrated_score")


_CLAMPED = f"""{_RANKED}, fl AS (SELECT query_id, min(decision_score) AS floor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY decision_score DESC) AS r FROM ranked WHERE structural_domain_hits >= 1) WHERE r <= 3 GROUP BY query_id),
clamped AS (SELECT ranked.*, coalesce(domain_hits = 0 AND NOT named AND decision_score > round(greatest(0.0, floor - 0.02), 4), false) AS demoted, round(greatest(0.0, floor - 0.02), 4) AS ceiling FROM ranked LEFT JOIN fl USING (query_id))"""


@_register("domain_clamp", f"WITH {_CLAMPED} SELECT chunk_idx, CASE WHEN demoted THEN ceiling ELSE decision_score END AS decision_score, demoted FROM clamped")
def domain_clamp(spark, sf_dir):
    return ranking.clamp_domain(_ranked(spark, sf_dir), ["query_id"]).select("chunk_idx", "decision_score", F.col("utility_trap_demoted").alias("demoted"))


_DIVERSE = f"""{_RANKED}, sib AS (SELECT *, (row_number() OVER (PARTITION BY query_id, file_path ORDER BY decision_score DESC, chunk_idx) > 1 AND decision_score < {V.SIBLING_EXEMPT}) AS penalized FROM ranked),
diverse AS (SELECT chunk_idx, query_id, file_path, is_test, penalized, CASE WHEN penalized THEN 1 / (1 + exp(-({_logit('decision_score')} - {V.REDUNDANCY}))) ELSE decision_score END AS order_score FROM sib),
scored2 AS (SELECT *, CASE WHEN penalized THEN round(order_score, 4) ELSE order_score END AS decision_score FROM diverse)"""


@_register("mmr_order", f"WITH {_DIVERSE} SELECT chunk_idx, decision_score, penalized FROM scored2")
def mmr_order(spark, sf_dir):
    return ranking.diversify(_ranked(spark, sf_dir), ["query_id"]).select("chunk_idx", "decision_score", F.col("redundancy_penalized").alias("penalized"))


_POLICY = f"""{_DIVERSE}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_score DESC, chunk_idx) AS rank, first_value(decision_score) OVER (PARTITION BY query_id ORDER BY order_score DESC, chunk_idx) AS top, count(*) OVER (PARTITION BY query_id) AS n FROM scored2),
p AS (SELECT *, decision_score >= top - {V.MARGIN} AND decision_score >= 0.65 AS passing FROM o), p2 AS (SELECT *, sum(CAST(passing AS INT)) OVER (PARTITION BY query_id) AS n_pass FROM p),
shown AS (SELECT * FROM p2 WHERE CASE WHEN n_pass < least(3, n) THEN rank <= least(3, n) ELSE passing END)"""


@_register("threshold_policy", f"WITH {_POLICY} SELECT query_id, chunk_idx, CAST(rank AS INT) AS rank, decision_score, decision_score < 0.65 AS below_threshold FROM shown")
def threshold_policy(spark, sf_dir):
    rows = ranking.diversify(_ranked(spark, sf_dir), ["query_id"])
    return ranking.policy(rows, 0.65, ["query_id"]).select("query_id", "chunk_idx", "rank", "decision_score", "below_threshold")


@_register("bug_test_policy", f"WITH {_POLICY}, s5 AS (SELECT query_id, chunk_idx, rank FROM shown WHERE rank <= 5), sz AS (SELECT query_id, count(*) AS size FROM s5 GROUP BY 1), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_score DESC, chunk_idx) AS k FROM p2 WHERE is_test) WHERE k = 1), new AS (SELECT best.query_id, best.chunk_idx, least(coalesce(size, 0) + 1, 5) AS rank FROM best LEFT JOIN sz USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM s5 WHERE s5.query_id = best.query_id AND s5.chunk_idx = best.chunk_idx)) SELECT query_id, chunk_idx, CAST(rank AS INT) AS rank FROM s5 WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.query_id = s5.query_id AND new.rank <= s5.rank) UNION ALL SELECT query_id, chunk_idx, CAST(rank AS INT) FROM new")
def bug_test_policy(spark, sf_dir):
    rows = ranking.diversify(_ranked(spark, sf_dir), ["query_id"])
    return ranking.policy(rows, 0.65, ["query_id"], top_k=5, bug_tests=True).select("query_id", "chunk_idx", "rank")


@_register("abstain", f"WITH {_POLICY} SELECT query_id, chunk_idx FROM shown WHERE top >= 0.995")
def abstain(spark, sf_dir):
    rows = ranking.diversify(_ranked(spark, sf_dir), ["query_id"])
    return ranking.policy(rows, 0.65, ["query_id"], allow_empty=True, abstain_below=0.995).select("query_id", "chunk_idx")


_RERANK = f"""{_DECIDED}, fl AS (SELECT min(decision_score) AS floor FROM (SELECT decision_score, row_number() OVER (ORDER BY decision_score DESC) AS r FROM decided WHERE structural >= 1) WHERE r <= 3),
cl AS (SELECT decided.* EXCLUDE (decision_score), coalesce(domain_hits = 0 AND decision_score > round(greatest(0.0, floor - 0.02), 4), false) AS demoted, CASE WHEN coalesce(domain_hits = 0 AND decision_score > round(greatest(0.0, floor - 0.02), 4), false) THEN round(greatest(0.0, floor - 0.02), 4) ELSE decision_score END AS decision_score FROM decided, fl),
sb AS (SELECT *, (row_number() OVER (PARTITION BY file_path ORDER BY decision_score DESC, chunk_idx) > 1 AND decision_score < {V.SIBLING_EXEMPT}) AS penalized FROM cl),
os AS (SELECT * EXCLUDE (decision_score), CASE WHEN penalized THEN 1 / (1 + exp(-({_logit('decision_score')} - {V.REDUNDANCY}))) ELSE decision_score END AS order_score FROM sb),
dv AS (SELECT *, CASE WHEN penalized THEN round(order_score, 4) ELSE order_score END AS decision_score FROM os),
ok AS (SELECT *, row_number() OVER (ORDER BY order_score DESC, chunk_idx) AS rank, first_value(decision_score) OVER (ORDER BY order_score DESC, chunk_idx) AS top, count(*) OVER () AS n FROM dv),
ps AS (SELECT *, decision_score >= top - {V.MARGIN} AND decision_score >= {_Q.threshold} AS passing FROM ok), pn AS (SELECT *, sum(CAST(passing AS INT)) OVER () AS n_pass FROM ps),
answer AS (SELECT * FROM pn WHERE CASE WHEN n_pass < least(3, n) THEN rank <= least(3, n) ELSE passing END)"""


@_register("rerank", f"WITH {_RERANK} SELECT CAST(rank AS INT) AS rank, id AS candidate_id, raw_score, decision_score, 'VERIFIED' AS ground_truth_status, decision_score < {_Q.threshold} AS below_threshold, penalized AS redundancy_penalized, demoted AS utility_trap_demoted FROM answer")
def rerank(spark, sf_dir):
    """The flagship: documents to cited answer."""
    out = plan.rerank(_files(spark, sf_dir), QUERY, size=SIZE, overlap=OVERLAP)
    return out.results.select("rank", "candidate_id", "raw_score", "decision_score", "ground_truth_status", "below_threshold", "redundancy_penalized", "utility_trap_demoted")


@_register("manifest", f"WITH {_RERANK}, m AS (SELECT chunks.file_path, count(*) AS chunks_count, max(coalesce(dv.decision_score, 0)) AS max_score FROM chunks LEFT JOIN dv USING (chunk_idx) GROUP BY 1) SELECT file_path, CAST(chunks_count AS BIGINT) AS chunks_count, CAST(max_score AS DOUBLE) AS max_score, CASE WHEN file_path IN (SELECT file_path FROM answer) THEN 'included' ELSE 'omitted' END AS status, '' AS symbols, false AS is_test FROM m")
def manifest(spark, sf_dir):
    out = plan.rerank(_files(spark, sf_dir), QUERY, size=SIZE, overlap=OVERLAP)
    return out.manifest.select("file_path", "chunks_count", "max_score", "status", F.array_join("symbols", ",").alias("symbols"), "is_test")


@_register("telemetry", f"WITH {_RERANK}, a AS (SELECT count(*) AS chunks_total, sum(CAST(greatest(1, floor(length(content) / 3.6)) AS BIGINT)) AS tokens_total FROM chunks), d AS (SELECT count(*) AS chunks_evaluated, sum(CAST(penalized AS INT)) AS redundancy_penalties, sum(CAST(demoted AS INT)) AS demotions FROM dv), r AS (SELECT count(*) AS results, sum(CAST(decision_score < {_Q.threshold} AS INT)) AS below_threshold FROM answer) SELECT CAST(chunks_total AS BIGINT) AS chunks_total, CAST(tokens_total AS BIGINT) AS tokens_total, CAST(chunks_evaluated AS BIGINT) AS chunks_evaluated, CAST(redundancy_penalties AS BIGINT) AS redundancy_penalties, CAST(demotions AS BIGINT) AS demotions, CAST(results AS BIGINT) AS results, CAST(below_threshold AS BIGINT) AS below_threshold FROM a, d, r")
def telemetry(spark, sf_dir):
    out = plan.rerank(_files(spark, sf_dir), QUERY, size=SIZE, overlap=OVERLAP)
    return out.telemetry.select("chunks_total", "tokens_total", "chunks_evaluated", "redundancy_penalties", "demotions", "results", "below_threshold")


@_register("verify_ranges", f"WITH {_FILES}, {_LINES}, c AS (SELECT file_idx AS chunk_idx, CASE WHEN file_idx % 10 = 0 THEN NULL WHEN file_idx % 10 = 1 THEN '/gone.txt' ELSE file_path END AS file_path, CAST(file_idx % 4 AS INT) AS start_line, CAST(file_idx % 30 AS INT) AS end_line FROM files), n AS (SELECT file_path, len(lines) AS k FROM lined), vr AS (SELECT chunk_idx, CASE WHEN c.file_path IS NULL THEN 'UNVERIFIED_RAW_TEXT' WHEN k IS NULL THEN 'FILE_NOT_FOUND' WHEN start_line < 1 OR end_line > k OR start_line > end_line THEN 'INVALID_LINE_RANGE' ELSE 'VERIFIED' END AS ground_truth_status FROM c LEFT JOIN n ON c.file_path = n.file_path) SELECT *, CASE WHEN ground_truth_status IN ('INVALID_LINE_RANGE', 'FILE_NOT_FOUND') THEN 0.0::DOUBLE ELSE 0.5 END AS raw_score FROM vr")
def verify_ranges(spark, sf_dir):
    f = _files(spark, sf_dir)
    cited = f.select(F.col("file_idx").alias("chunk_idx"), F.when(F.col("file_idx") % 10 == 0, None).when(F.col("file_idx") % 10 == 1, "/gone.txt").otherwise(F.col("file_path")).alias("file_path"), (F.col("file_idx") % 4).cast("int").alias("start_line"), (F.col("file_idx") % 30).cast("int").alias("end_line"))
    lines = f.select("file_path", (F.size(F.split("body", chunking.NEWLINE)) - F.col("body").rlike("(\r|\n)\\z|^\\z").cast("int")).alias("line_count"))
    return ranking.verify(cited.withColumn("raw_score", F.lit(0.5)), lines).select("chunk_idx", "ground_truth_status", "raw_score")


_FUSE = f"f0 AS (SELECT doc_id AS chunk_idx, lang AS query_id, round({_UNIT.format('CAST(doc_id AS VARCHAR)')}, 4) AS raw_score, CAST(length(text) % 37 AS DOUBLE) AS lexical_score, doc_id % 13 = 0 AS error FROM documents WHERE text IS NOT NULL), f1 AS (SELECT *, avg(lexical_score) OVER (PARTITION BY query_id) AS mean, stddev_pop(lexical_score) OVER (PARTITION BY query_id) AS sd, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_idx) AS r FROM f0)"


@_register("fusion_scores", f"WITH {_FUSE} SELECT chunk_idx, CASE WHEN error THEN raw_score ELSE round(1 / (1 + exp(-({_logit('raw_score', '1e-4')} + greatest(-3.0, least(3.0, (lexical_score - mean) / greatest(sd, 3.0)))))), 4) END AS score FROM f1 WHERE r <= 16")
def fusion_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_idx"), F.col("lang").alias("query_id"), F.round(_unit("doc_id"), 4).alias("raw_score"), (F.length("text") % 37).cast("double").alias("lexical_score"), (F.col("doc_id") % 13 == 0).alias("error"))
    return ranking.fuse_lexical(rows, ["query_id"], head=16).select("chunk_idx", "score")


@_register("cache_lookup", f"WITH {_CHUNKS}, k AS (SELECT id, chunk_idx, file_idx, sha256('q:' || sha256(content) || ':lfm:v1:' || start_byte || '-' || end_byte || '::v0.3.2:') AS cache_key FROM chunks), cache AS (SELECT cache_key, max(CAST(file_idx AS DOUBLE) / 8) AS score FROM k WHERE file_idx % 3 = 0 GROUP BY 1) SELECT id, cache.cache_key IS NOT NULL AS cached, score AS cached_score FROM k LEFT JOIN cache USING (cache_key)")
def cache_lookup(spark, sf_dir):
    keyed = scoring.cache_keys(_chunks(spark, sf_dir), "q")
    cache = keyed.where("file_idx % 3 = 0").select("cache_key", "normalized_query", F.col("content_hash").alias("chunk_hash"), (F.col("file_idx").cast("double") / 8).alias("score"), F.lit(None).cast("double").alias("logprob_yes"), F.lit(None).cast("double").alias("logprob_no"), F.col("file_idx").cast("double").alias("created_at"))
    return ranking.lookup_scores(keyed, cache).select("id", "cached", "cached_score")


# --- metrics and calibration ------------------------------------------------------------------------

_BIN = "CASE WHEN p >= 0.9::DOUBLE THEN 9 " + " ".join(f"WHEN p >= {i / 10}::DOUBLE THEN {i}" for i in range(8, 0, -1)) + " ELSE 0 END"
_BINNED = f"{_OUTCOMES}, b AS (SELECT {_BIN} AS bin, count(*) AS n, CAST(sum(CAST(y AS DECIMAL(18,12))) AS DOUBLE) / count(*) AS rate, CAST(sum(CAST(p AS DECIMAL(18,12))) AS DOUBLE) / count(*) AS mean_p, abs(sum(CAST(y AS DECIMAL(18,12)) - CAST(p AS DECIMAL(18,12)))) AS gap FROM outcomes WHERE p BETWEEN 0 AND 1 GROUP BY 1)"
_PER = f"{_OUTCOMES}, s AS (SELECT l_linestatus AS g, p, sum(CAST(y AS INT)) AS pos, count(*) AS n FROM outcomes GROUP BY ALL)"


@_register("brier", f"WITH {_OUTCOMES} SELECT l_linestatus, round(avg((p - y) * (p - y)), 4) AS brier FROM outcomes GROUP BY 1")
def brier(spark, sf_dir):
    return metrics.brier(_outcomes(spark, sf_dir), ["l_linestatus"])


@_register("ece", f"WITH {_BINNED} SELECT round(CAST(sum(gap) AS DOUBLE) / sum(n), 4) AS ece FROM b")
def ece(spark, sf_dir):
    return metrics.ece(_outcomes(spark, sf_dir))


@_register("reliability", f"WITH {_BINNED} SELECT CAST(i AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS count, round(mean_p, 4) AS mean_predicted, round(rate, 4) AS observed_rate, round(abs(rate - mean_p), 4) AS error FROM range(10) t(i) LEFT JOIN b ON b.bin = i")
def reliability(spark, sf_dir):
    return metrics.reliability(_outcomes(spark, sf_dir)).drop("bin_range")


@_register("auroc", f"WITH {_PER}, w AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT g AS l_linestatus, CASE WHEN sum(pos) = 0 OR sum(n - pos) = 0 THEN 0.5 ELSE round(sum(pos * (below + (n - pos) / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(n - pos)), 4) END AS auroc FROM w GROUP BY 1")
def auroc(spark, sf_dir):
    return metrics.auroc(_outcomes(spark, sf_dir), ["l_linestatus"])


@_register("auprc", f"WITH {_PER}, w AS (SELECT *, CAST(sum(pos) OVER o AS DOUBLE) / sum(n) OVER o * pos AS part FROM s WINDOW o AS (PARTITION BY g ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT g AS l_linestatus, CASE WHEN sum(pos) = 0 THEN 0.0 ELSE round(sum(part) / sum(pos), 4) END AS auprc FROM w GROUP BY 1")
def auprc(spark, sf_dir):
    return metrics.auprc(_outcomes(spark, sf_dir), ["l_linestatus"])


@_register("histogram", f"WITH {_OUTCOMES}, h AS (SELECT CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n FROM outcomes GROUP BY 1) SELECT CAST(i AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS count FROM range(10) t(i) LEFT JOIN h ON h.bin = i")
def histogram(spark, sf_dir):
    return metrics.histogram(_outcomes(spark, sf_dir))


@_register("brier_skill", f"WITH {_OUTCOMES} SELECT round(1 - round(avg((p - y) * (p - y)), 4) / (avg(y) * (1 - avg(y))), 4) AS brier_skill FROM outcomes")
def brier_skill(spark, sf_dir):
    return metrics.brier_skill(_outcomes(spark, sf_dir))


@_register("sharpness", f"WITH {_OUTCOMES} SELECT round(min(p), 4) AS min, round(quantile_cont(p, 0.5), 4) AS median, round(quantile_cont(p, 0.75), 4) AS p75, round(max(p), 4) AS max, round(avg(CAST(p > 0.3 AS INT)) * 100, 2) AS pct_above_30, round(avg(CAST(p > 0.5 AS INT)) * 100, 2) AS pct_above_50, round(avg(CAST(p > 0.7 AS INT)) * 100, 2) AS pct_above_70 FROM outcomes")
def sharpness(spark, sf_dir):
    return metrics.sharpness(_outcomes(spark, sf_dir))


@_register("latency_percentile", "SELECT event_type, round(quantile_cont(value, 0.95), 3) AS value FROM events GROUP BY 1")
def latency_percentile(spark, sf_dir):
    return metrics.percentile(_table(spark, sf_dir, "events"), "value", 95.0, ["event_type"])


_NLL = "avg(-(y * ln(least(greatest(1 / (1 + exp(-(z / t))), 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(1 / (1 + exp(-(z / t))), 1e-12), 1 - 1e-12))))"
_GRID = "grid AS (SELECT 0.05::DOUBLE + i * (9.95::DOUBLE / 199) AS t FROM range(200) r(i))"


@_register("temperature_fit", f"WITH {_LABELLED}, {_GRID}, n AS (SELECT t, round({_NLL}, 12) AS nll FROM labelled, grid GROUP BY t) SELECT round(t, 4) AS temperature FROM n ORDER BY nll, t LIMIT 1")
def temperature_fit(spark, sf_dir):
    return calibration.fit_temperature(_labelled(spark, sf_dir))


@_register("temperature_cv", f"WITH {_LABELLED}, {_GRID}, f AS (SELECT *, ntile(5) OVER (ORDER BY doc_id) AS fold FROM labelled), n AS (SELECT k, t, round({_NLL}, 12) AS nll FROM f, grid, range(1, 6) r(k) WHERE fold <> k GROUP BY k, t), b AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY nll, t) AS r FROM n) SELECT round(quantile_cont(t, 0.5), 4) AS temperature FROM b WHERE r = 1")
def temperature_cv(spark, sf_dir):
    return calibration.fit_temperature_cv(_labelled(spark, sf_dir), "doc_id")


def _newton(source: str, keys: str, l2: str, steps: int = 14) -> str:
    """CTEs n0, n1, ...: Newton steps of the penalised logistic fit over `source` (keys, y, z, n), from (1, 0)."""
    out = [f"n0 AS MATERIALIZED (SELECT {keys}, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source} GROUP BY {keys})"]
    p = "least(greatest(1 / (1 + exp(-(m.a * s.z + m.b))), 1e-12), 1 - 1e-12)"
    for i in range(steps):
        sums = f"SELECT {keys}, any_value(m.a) AS a, any_value(m.b) AS b, sum(s.n * ({p} - s.y) * s.z) + {l2} * any_value(m.a) AS ga, sum(s.n * ({p} - s.y)) AS gb, sum(s.n * {p} * (1 - {p}) * s.z * s.z) + {l2} AS haa, sum(s.n * {p} * (1 - {p}) * s.z) AS hab, sum(s.n * {p} * (1 - {p})) AS hbb FROM {source} s JOIN n{i} m USING ({keys}) GROUP BY {keys}"
        out.append(f"n{i + 1} AS MATERIALIZED (SELECT {keys}, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM ({sums}))")
    return ", ".join(out) + f", fitted AS (SELECT {keys}, greatest(0.01, round(a, 4)) AS a, round(b, 4) AS b FROM n{steps})"


@_register("platt_fit", f"WITH {_LABELLED}, c AS (SELECT 1 AS k, y, z, count(*) AS n FROM labelled GROUP BY ALL), {_newton('c', 'k', '1e-3')} SELECT a, b FROM fitted")
def platt_fit(spark, sf_dir):
    m = calibration.fit_platt(_labelled(spark, sf_dir))
    return spark.range(1).select(F.lit(m.a).alias("a"), F.lit(m.b).alias("b"))


@_register("platt_cv", f"""WITH {_LABELLED}, f AS (SELECT *, ntile(5) OVER (ORDER BY doc_id) AS fold FROM labelled), g AS (SELECT l2, k FROM (VALUES (1e-4::DOUBLE), (1e-3), (1e-2), (1e-1), (1.0)) t(l2), range(1, 7) r(k)),
c AS (SELECT l2 * 10000 + k * 1000000 AS k, any_value(l2) AS l2, y, z, count(*) AS n FROM f, g WHERE fold <> g.k GROUP BY l2, g.k, y, z), {_newton('c', 'k', 'any_value(s.l2)')},
e AS (SELECT g.l2, g.k, round(avg(power(round(1 / (1 + exp(-(a * z + b))), 4) - y, 2)), 4) AS loss FROM g JOIN fitted ON fitted.k = g.l2 * 10000 + g.k * 1000000 JOIN f ON f.fold = g.k GROUP BY ALL), m AS (SELECT l2, avg(loss) AS loss FROM e GROUP BY 1), best AS (SELECT l2 FROM m ORDER BY round(loss, 12), l2 LIMIT 1)
SELECT best.l2, a, b FROM best JOIN fitted ON fitted.k = best.l2 * 10000 + 6 * 1000000""")
def platt_cv(spark, sf_dir):
    l2, m = calibration.fit_platt_cv(_labelled(spark, sf_dir), "doc_id")
    return spark.range(1).select(F.lit(l2).alias("l2"), F.lit(m.a).alias("a"), F.lit(m.b).alias("b"))


_FOLDED = f"{_LABELLED}, f AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096, doc_id) - 1) % 5 AS fold FROM labelled)"


@_register("out_of_fold", f"WITH {_FOLDED}, c AS (SELECT r.k, y, z, count(*) AS n FROM f, range(5) r(k) WHERE fold <> r.k GROUP BY ALL), {_newton('c', 'k', '1e-3')} SELECT doc_id, y, round(1 / (1 + exp(-(a * z + b))), 4) AS oof FROM f JOIN fitted ON fitted.k = f.fold")
def out_of_fold(spark, sf_dir):
    return calibration.out_of_fold(_labelled(spark, sf_dir), "doc_id").select("doc_id", "y", "oof")


@_register("held_out_tasks", f"WITH {_LABELLED}, t AS (SELECT doc_id, doc_id % 6 AS task_id, y, z FROM labelled), c AS (SELECT 1 AS k, y, z, count(*) AS n FROM t WHERE task_id IN (0, 1, 2, 3) GROUP BY ALL), {_newton('c', 'k', '1e-3')} SELECT doc_id, round(1 / (1 + exp(-(a * z + b))), 4) AS prediction FROM t, fitted WHERE task_id IN (4, 5)")
def held_out_tasks(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("task_id", F.col("doc_id") % 6)
    return calibration.held_out_tasks(rows, [0, 1, 2, 3], [4, 5]).select("doc_id", "prediction")


@_register("temperature_scaled", f"WITH {_LABELLED} SELECT doc_id, round(1 / (1 + exp(-(z / 1.7))), 4) AS scaled FROM labelled")
def temperature_scaled(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", calibration.Temperature(1.7).column(F.col("z")).alias("scaled"))


# --- evaluation -----------------------------------------------------------------------------------

_EVAL_CTES = f"{_MULTI}, ev AS (SELECT query_id AS task_id, CAST(rank AS INT) AS rank, multi.id, contains(c.file_path, '/src' || (query_id % 20) || '/') AS is_target, c.content FROM multi JOIN chunks c USING (chunk_idx) WHERE rank <= 5)"


def _evaluated(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    tasks = _tasks(spark, sf_dir).select(F.col("query_id").alias("task_id"), "terms", F.concat(F.lit("/src"), (F.col("query_id") % 20).cast("string"), F.lit("/")).alias("target_file_substr"), F.lit(None).cast("string").alias("target_symbol"))
    return chunks, tasks


def _eval_rows(spark, sf_dir, *columns):
    chunks, tasks = _evaluated(spark, sf_dir)
    ranked = lexical.rank_many(chunks, tasks.select(F.col("task_id").alias("query_id"), "terms"), 5, ("id", "file_path", "symbol", *columns))
    return metrics.label_targets(ranked.withColumnRenamed("query_id", "task_id"), tasks)


_FIRST = f"{_EVAL_CTES}, ft AS (SELECT task_id, min(rank) FILTER (WHERE is_target) AS rank FROM ev GROUP BY 1)"


@_register("first_target", f"WITH {_FIRST} SELECT task_id, CAST(rank AS INT) AS rank, round(coalesce(1.0::DOUBLE / rank, 0), 4) AS reciprocal_rank FROM ft")
def first_target(spark, sf_dir):
    return metrics.first_target(_eval_rows(spark, sf_dir))


_SUMMARY = "CAST(count(*) AS BIGINT) AS tasks, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr, round(avg(rank), 2) AS mean_rank"


@_register("recall_mrr", f"WITH {_FIRST} SELECT {_SUMMARY} FROM ft")
def recall_mrr(spark, sf_dir):
    return metrics.ranking_summary(metrics.first_target(_eval_rows(spark, sf_dir)))


@_register("intent_slice", f"WITH {_FIRST} SELECT CASE task_id % 4 WHEN 0 THEN 'IMPLEMENTATION' WHEN 1 THEN 'SPECIFICATION' WHEN 2 THEN 'BUG_DIAGNOSIS' ELSE 'REFACTOR' END AS intent, {_SUMMARY} FROM ft GROUP BY 1")
def intent_slice(spark, sf_dir):
    intent = F.get(F.array(*[F.lit(x) for x in ("IMPLEMENTATION", "SPECIFICATION", "BUG_DIAGNOSIS", "REFACTOR")]), (F.col("task_id") % 4).cast("int"))
    return metrics.ranking_summary(metrics.first_target(_eval_rows(spark, sf_dir)).withColumn("intent", intent), ["intent"])


@_register("failure_analysis", f"WITH {_FIRST}, comp AS (SELECT task_id, string_agg(id, ',' ORDER BY rank, id) AS c FROM ev WHERE rank <= 3 AND NOT is_target GROUP BY 1) SELECT task_id, CAST(rank AS INT) AS rank, coalesce(c, '') AS competitors, CASE WHEN rank IS NULL THEN 'target not retrieved' WHEN rank <= 5 THEN 'narrowly outranked' ELSE 'outranked' END AS cause FROM ft LEFT JOIN comp USING (task_id) WHERE rank IS NULL OR rank > 3")
def failure_analysis(spark, sf_dir):
    return metrics.failures(_eval_rows(spark, sf_dir))


_STAGE_U = f"least(greatest({_UNIT.format('CAST(task_id AS VARCHAR) || ' + chr(39) + ':' + chr(39) + ' || sha256(content)')}, 1e-6), 1 - 1e-6)"
_STAGED = f"""{_EVAL_CTES}, st0 AS (SELECT *, {_STAGE_U} AS u, CAST(is_target AS INT)::DOUBLE AS y FROM ev), st1 AS (SELECT task_id, y, round(1 / (1 + exp(-(ln(u) - ln(1 - u)))), 4) AS p_raw, round(1 / (1 + exp(-((ln(u) - ln(1 - u)) * power(120.0::DOUBLE / greatest(40.0, greatest(1, floor(length(content) / 3.6))), 0.15)))), 4) AS p_len FROM st0),
st2 AS (SELECT *, round(1 / (1 + exp(-({_logit('p_len')} + {V.PRIORS['SPECIFICATION']['doc']} * 0.5))), 4) AS p_intent FROM st1), st3 AS (SELECT *, round(1 / (1 + exp(-({V.PLATT_A} * {_logit('p_intent')} - 2.1))), 4) AS p_cal FROM st2),
long AS (SELECT 'p_raw' AS stage, y, p_raw AS p FROM st3 UNION ALL SELECT 'p_len', y, p_len FROM st3 UNION ALL SELECT 'p_intent', y, p_intent FROM st3 UNION ALL SELECT 'p_cal', y, p_cal FROM st3),
bb AS (SELECT stage, {_BIN} AS bin, count(*) AS n, abs(sum(CAST(y AS DECIMAL(18,12)) - CAST(p AS DECIMAL(18,12)))) AS gap FROM long GROUP BY 1, 2), ec AS (SELECT stage, round(CAST(sum(gap) AS DOUBLE) / sum(n), 4) AS ece FROM bb GROUP BY 1),
sp AS (SELECT stage, p, sum(CAST(y AS INT)) AS pos, count(*) AS n FROM long GROUP BY ALL),
ww AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY stage ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, CAST(sum(pos) OVER o AS DOUBLE) / sum(n) OVER o * pos AS part FROM sp WINDOW o AS (PARTITION BY stage ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
au AS (SELECT stage, CASE WHEN sum(pos) = 0 OR sum(n - pos) = 0 THEN 0.5 ELSE round(sum(pos * (below + (n - pos) / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(n - pos)), 4) END AS auroc, CASE WHEN sum(pos) = 0 THEN 0.0 ELSE round(sum(part) / sum(pos), 4) END AS auprc FROM ww GROUP BY 1),
br AS (SELECT stage, round(avg((p - y) * (p - y)), 4) AS brier FROM long GROUP BY 1)"""


@_register("stage_table", f"WITH {_STAGED} SELECT stage, brier, ece, auroc, auprc FROM br JOIN ec USING (stage) JOIN au USING (stage)")
def stage_table(spark, sf_dir):
    chunks, tasks = _evaluated(spark, sf_dir)
    return metrics.stage_table(plan.task_chunks(chunks, tasks))


_HASH32 = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_BOOT = f"""{_STAGED}, rk AS (SELECT task_id, min(rank) FILTER (WHERE is_target) AS rank FROM ev GROUP BY 1),
tk AS (SELECT task_id, any_value(rk.rank) AS rank, count(*) AS n, sum((p_intent - y) * (p_intent - y)) AS sq, sum((p_cal - y) * (p_cal - y)) AS sq_cal FROM st3 JOIN rk USING (task_id) GROUP BY 1),
pl AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {_HASH32.format("CAST(task_id AS VARCHAR)")} % 4096, task_id) - 1 AS place FROM tk),
dr AS MATERIALIZED (SELECT sample, {_HASH32.format("sample || ':' || pos")} % (SELECT count(*) FROM pl) AS place, count(*) AS times FROM range(1000) r(sample), (SELECT place AS pos FROM pl) GROUP BY ALL),
hd AS MATERIALIZED (SELECT sample, times, pl.* FROM dr JOIN pl USING (place)),
r1 AS (SELECT sample, {", ".join(f"sum(times * CASE WHEN rank <= {k} THEN 1 ELSE 0 END) / sum(times) AS recall_{k}" for k in (1, 3, 5))}, sum(times * round(coalesce(1.0::DOUBLE / rank, 0), 4)) / sum(times) AS mrr, round(sum(times * sq) / sum(times * n), 4) AS brier, round(sum(times * sq_cal) / sum(times * n), 4) AS cal_brier FROM hd GROUP BY 1),
bt AS (SELECT task_id, y, 'ece' AS metric, p_intent AS p FROM st3 UNION ALL SELECT task_id, y, 'cal_ece', p_cal FROM st3), bn AS (SELECT task_id, metric, {_BIN} AS bin, count(*) AS k, sum(y) AS sy, sum(p) AS sp FROM bt GROUP BY ALL),
cl AS (SELECT sample, metric, bin, sum(times * k) AS k, abs(sum(times * sy) - sum(times * sp)) AS gap FROM hd JOIN bn USING (task_id) GROUP BY ALL), er AS (SELECT sample, metric, round(sum(gap) / sum(k), 4) AS v FROM cl GROUP BY ALL),
vs AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM r1" for m in metrics.BOOTSTRAPPED if "ece" not in m)} UNION ALL SELECT metric, v FROM er)"""


@_register("bootstrap_ci", f"WITH {_BOOT} SELECT metric, round(round(quantile_cont(v, 0.025), 9), 4) AS low, round(round(avg(v), 9), 4) AS mean, round(round(quantile_cont(v, 0.975), 9), 4) AS high FROM vs GROUP BY 1")
def bootstrap_ci(spark, sf_dir):
    chunks, tasks = _evaluated(spark, sf_dir)
    rows = plan.task_chunks(chunks, tasks)
    first = rows.groupBy("task_id").agg(F.min(F.when(F.col("y_true") == 1, F.col("rank"))).alias("first"))
    held = rows.drop("rank").join(first.withColumnRenamed("first", "rank"), "task_id").select("task_id", "rank", F.col("y_true").alias("y"), F.col("p_intent").alias("p"), "p_cal")
    return metrics.bootstrap_ci(held)


# --- usage, review, structure ---------------------------------------------------------------------------


def _usage(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 4 == 1, "hook").otherwise(F.col("event_type")).alias("caller"), F.col("value").alias("latencyMs"), (F.col("event_id") % 5 != 0).alias("queried"), F.when(F.col("event_id") % 8 == 1, "machine-text").otherwise("ok").alias("outcome"))


_USAGE = "usage AS (SELECT CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'hook' ELSE event_type END AS caller, value AS latencyMs, event_id % 5 <> 0 AS queried, CASE WHEN event_id % 8 = 1 THEN 'machine-text' ELSE 'ok' END AS outcome FROM events)"


@_register("usage_latency", f"WITH {_USAGE} SELECT coalesce(caller, 'unknown') AS caller, CAST(count(*) AS BIGINT) AS count, round(median(latencyMs), 6) AS median_ms FROM usage WHERE queried GROUP BY 1")
def usage_latency(spark, sf_dir):
    return usage.latency_by_caller(_usage(spark, sf_dir)).withColumn("median_ms", F.round("median_ms", 6))


@_register("usage_share", f"WITH {_USAGE} SELECT CAST(count(*) AS BIGINT) AS prompts, CAST(sum(CAST(queried AS INT)) AS BIGINT) AS queried, round(sum(CAST(queried AS INT)) / count(*), 6) AS share FROM usage WHERE caller = 'hook' AND outcome <> 'machine-text'")
def usage_share(spark, sf_dir):
    return usage.hook_share(_usage(spark, sf_dir)).withColumn("share", F.round("share", 6))


_CLAIMS = f"{_FILES}, {_LINES}, cl AS (SELECT file_idx AS candidate_id, lines, CASE file_idx % 4 WHEN 0 THEN '' WHEN 1 THEN 'short' WHEN 2 THEN trim(regexp_replace(lines[1], '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) ELSE 'no such evidence anywhere' END AS e, CASE WHEN file_idx % 8 = 2 THEN 'calls `inventedName` here' ELSE 'plain words' END AS t FROM lined WHERE len(lines) > 0)"


@_register("review_gates", f"WITH {_CLAIMS} SELECT candidate_id, CASE WHEN e = '' THEN 'EMPTY_EVIDENCE' WHEN length(e) < {V.EVIDENCE_LEAST} THEN 'EVIDENCE_TOO_SHORT' WHEN candidate_id % 4 = 3 THEN 'EVIDENCE_NOT_FOUND' WHEN candidate_id % 8 = 2 THEN 'CLAIM_SYMBOL_NOT_IN_CHUNK' END AS reason, CASE WHEN candidate_id % 4 = 2 AND length(e) >= {V.EVIDENCE_LEAST} THEN 1 END::INT AS evidence_line FROM cl")
def review_gates(spark, sf_dir):
    f = _files(spark, sf_dir)
    lines = F.split("body", chunking.NEWLINE)
    lines = F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    base = f.select("file_idx", lines.alias("lines")).where(F.size("lines") > 0)
    evidence = F.when(F.col("file_idx") % 4 == 0, "").when(F.col("file_idx") % 4 == 1, "short").when(F.col("file_idx") % 4 == 2, T.normal_space(F.get("lines", F.lit(0)))).otherwise("no such evidence anywhere")
    claims = base.select(F.col("file_idx").alias("candidate_id"), F.when(F.col("file_idx") % 8 == 2, "calls `inventedName` here").otherwise("plain words").alias("text"), evidence.alias("evidence"), "lines", F.lit(1).alias("start_line"))
    return review.gate(claims).select("candidate_id", "reason", "evidence_line")


# more queries, registered by import
from . import queries_code, queries_more, queries_text  # noqa: E402, F401
