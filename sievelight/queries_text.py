"""Registered queries of query features, model replies, symbol roles and symbol matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import query as Q
from .functions import scores as S
from .functions import text as T
from .functions import vocab as V
from .operators import chunking, ranking
from .queries import _FILES, _chunks, _files, _list, _norm, _register, _sat, _table, _terms  # noqa: F401
from .queries_code import _CUT, _cut

# --- query features: benchmark items, with names and symptoms put before them ----------------------------

_ASKED = "asked AS (SELECT item_id AS query_id, 'why does `get_' || item_id || '` crash in parseToken2 and HTTP_ERR, filtered caching of stories ' || regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS q FROM benchmark WHERE text IS NOT NULL)"


def _asked(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.concat(F.lit("why does `get_"), F.col("item_id").cast("string"), F.lit("` crash in parseToken2 and HTTP_ERR, filtered caching of stories "), F.regexp_replace("text", r"[^\x00-\x7F]", " ")).alias("text"))


def _first_of(x: str) -> str:
    """A list without later repeats."""
    return f"[v for v, i in {x} if list_position({x}, v) = i]"


_SYM, _STOP = _list(V.SYMPTOMS), _list(V.STOPWORDS)
_KINDS = f"""terms AS (SELECT query_id, q, {_terms('q')} AS t FROM asked), kinds AS (SELECT *, [CASE WHEN length(x) < 2 OR regexp_full_match(x, '[0-9]+') OR (list_contains({_STOP}, x) AND NOT list_contains({_SYM}, x)) THEN '-' WHEN list_contains({_SYM}, x) THEN 's' ELSE 'd' END for x in t] AS k FROM terms),
listed AS (SELECT *, [x for x in t if length(x) > 1] AS long, [x for x, i in t if k[i] = 'd'] AS dom, [t[i] || ' ' || t[i + 1] for i in range(1, len(t)) if k[i] = 'd' AND k[i + 1] = 'd'] AS ph FROM kinds)"""


def _features(spark, sf_dir, *names):
    return Q.features(_asked(spark, sf_dir)).select("query_id", *[F.array_join(n, ",").alias(n) for n in names])


@_register("query_terms", f"WITH {_ASKED}, {_KINDS}, u AS (SELECT query_id, {_first_of('long')} AS x FROM listed) SELECT query_id, array_to_string([v for v in x if NOT list_contains({_SYM}, v) AND NOT list_contains({_STOP}, v)], ',') AS content, array_to_string([v for v in x if list_contains({_SYM}, v)], ',') AS symptoms FROM u")
def query_terms(spark, sf_dir):
    return _features(spark, sf_dir, "content", "symptoms")


@_register("query_decomposition", f"WITH {_ASKED}, {_KINDS} SELECT query_id, array_to_string({_first_of('dom')}, ',') AS domain, array_to_string({_first_of('ph')}, ',') AS phrases FROM listed")
def query_decomposition(spark, sf_dir):
    return _features(spark, sf_dir, "domain", "phrases")


_NAMES = r"\b([a-z]+(?:[A-Z0-9][a-z0-9]*)+|[A-Z][a-z0-9]+(?:[A-Z0-9][a-z0-9]*)+|[a-zA-Z0-9]+(?:_[a-zA-Z0-9]+)+|[A-Z0-9_]{3,})\b"


@_register("query_identifiers", f"WITH {_ASKED} SELECT query_id, array_to_string(list_sort(list_distinct(list_concat([x for x in regexp_extract_all(q, '[`''\"]([a-zA-Z0-9_]+)[`''\"]', 1) if length(x) > 1], regexp_extract_all(q, '{_NAMES}', 1)))), ',') AS identifiers FROM asked")
def query_identifiers(spark, sf_dir):
    return _features(spark, sf_dir, "identifiers")


_STEMS = """CASE WHEN length(w) >= 7 AND regexp_matches(w, 'ing$') THEN [w[:-4]] WHEN length(w) >= 7 AND regexp_matches(w, 'ion$') THEN [w[:-4], w[:-4] || 'e'] WHEN length(w) >= 6 AND regexp_matches(w, 'ate$') THEN [w[:-2]] WHEN length(w) >= 6 AND regexp_matches(w, 'ed$') THEN [w[:-3]]
 WHEN length(w) >= 5 AND regexp_matches(w, '(s|x|z|ch|sh)es$') THEN [w[:-3]] WHEN length(w) >= 5 AND regexp_matches(w, '[^s]s$') THEN [w[:-2]] ELSE []::VARCHAR[] END"""


@_register("query_search_terms", f"WITH {_ASKED}, w AS (SELECT query_id, [x for x in regexp_extract_all(lower(q), '\\b[a-z0-9_]{{2,}}\\b') if NOT list_contains({_list(V.DISCOVERY_STOPWORDS)}, x)] AS ws FROM asked), s AS (SELECT query_id, flatten([list_concat([w], [x for x in {_STEMS} if length(x) >= 4]) for w in ws]) AS ss FROM w) SELECT query_id, array_to_string({_first_of('ss')}, ',') AS search FROM s")
def query_search_terms(spark, sf_dir):
    return _features(spark, sf_dir, "search")


def _key_of(w: str) -> str:
    a = f"(CASE WHEN length({w}) > 4 AND ends_with({w}, 'ies') THEN {w}[:-4] || 'y' WHEN length({w}) > 4 AND regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN {w}[:-3] WHEN length({w}) > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN {w}[:-2] ELSE {w} END)"
    b = f"(CASE WHEN length({a}) > 5 AND ends_with({a}, 'ing') THEN {a}[:-4] ELSE {a} END)"
    return f"(CASE WHEN length({b}) > 3 AND ends_with({b}, 'e') THEN {b}[:-2] ELSE {b} END)"


_PLAIN = f"plain AS (SELECT query_id, [p for p in flatten([string_split(x, '_') for x in regexp_extract_all(lower(q), '\\b[a-z0-9_]+\\b')]) if length(p) > 1 AND NOT list_contains({_list(V.TERM_STOPWORDS)}, p)] AS p FROM asked)"
_BASE = "CASE WHEN length(w) > 4 AND ends_with(w, 'ed') THEN [w, w[:-3]] WHEN length(w) > 6 AND ends_with(w, 'ion') THEN [w, w[:-4]] ELSE [w] END"


@_register("query_keys", f"WITH {_ASKED}, {_PLAIN}, ks AS (SELECT query_id, p, flatten([[{_key_of('x')} for x in {_BASE}] for w in p]) AS k FROM plain) SELECT query_id, array_to_string(p, ',') AS plain, array_to_string({_first_of('k')}, ',') AS keys FROM ks")
def query_keys(spark, sf_dir):
    return _features(spark, sf_dir, "plain", "keys")


@_register("declared_names", f"""WITH {_CUT}, body AS (SELECT chunk_idx, array_to_string([(start_line + i - 1) || ': ' || x for x, i in own], chr(10)) AS content FROM chunks)
SELECT chunk_idx, array_to_string(list_concat(regexp_extract_all(content, '(?m)^(?:\\d+: )?[ \\t]*(?:(?:export|default|declare|abstract|async|public|private|protected|static|pub)\\s+)*(?:function\\*?|class|interface|type|enum|def|fn|func|struct|trait)\\s+([A-Za-z_$][\\w$]*)', 1), regexp_extract_all(content, '(?m)^(?:\\d+: )?(?:export\\s+)?(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)', 1)), ',') AS names FROM body""")
def declared_names(spark, sf_dir):
    chunks, _ = _cut(spark, sf_dir)
    return chunks.select("chunk_idx", F.array_join(T.declared_names(F.col("content")), ",").alias("names"))


# --- model replies: five shapes, made from hashes ---------------------------------------------------------

_TOKENS = ("Yes", " no", "Ġtrue", "maybe", "1", "irrelevant.")
_REPLIES = "rp AS (SELECT doc_id, doc_id % 5 AS shape, [{tokens}][doc_id % 6 + 1] AS t1, [{tokens}][doc_id // 6 % 6 + 1] AS t2, -(doc_id % 17) / 8.0::DOUBLE - 0.125 AS l1, -(doc_id % 23) / 4.0::DOUBLE - 0.25 AS l2 FROM documents)".format(tokens=", ".join(f"'{t}'" for t in _TOKENS))


def _replies(spark, sf_dir):
    i = F.col("doc_id")
    token = lambda n: F.get(F.array(*[F.lit(t) for t in _TOKENS]), n.cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", token(i % 6).alias("t1"), token(F.floor(i / 6) % 6).alias("t2"), (-(i % 17) / 8.0 - 0.125).alias("l1"), (-(i % 23) / 4.0 - 0.25).alias("l2"))
    listed = F.array(*[F.struct(F.col(t).alias("token"), F.lit(n).cast("bigint").alias("id"), F.col(p).alias("logprob")) for n, (t, p) in enumerate((("t1", "l1"), ("t2", "l2")))])
    shapes = [
        F.to_json(listed),
        F.to_json(F.struct(F.array(F.struct(listed.alias("top_logprobs"))).alias("completion_probabilities"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(listed.alias("top_logprobs"))).alias("content")).alias("logprobs"))).alias("choices"))),
        F.concat(F.lit('{"choices": [{"logprobs": {"top_logprobs": [{"'), "t1", F.lit('": '), F.col("l1").cast("string"), F.lit(', "'), F.concat("t2", F.lit(" ")), F.lit('": '), F.col("l2").cast("string"), F.lit("}]}}]}")),
        F.to_json(F.struct(F.array(F.struct(F.array(*[F.struct(F.col(t).alias("tok_str"), F.exp(p).alias("prob")) for t, p in (("t1", "l1"), ("t2", "l2"))]).alias("probs"))).alias("completion_probabilities"))),
    ]
    payload = F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        payload = F.when(i % 5 == n, shape).otherwise(payload)
    return docs.select("doc_id", payload.alias("payload"))


_CLEAN = "regexp_replace(regexp_replace(lower(replace(replace({0}, chr(288), ''), ' ', '')), '^[\\s\"''.,;:!?*`~()\\[\\]{{}}]+', ''), '[\\s\"''.,;:!?*`~()\\[\\]{{}}]+$', '')"


def _lse(words) -> str:
    own = _list(words)
    a, b = f"list_contains({own}, c1)", f"list_contains({own}, c2)"
    return f"CASE WHEN {a} AND {b} THEN greatest(l1, l2) + ln(exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2))) WHEN {a} THEN l1 WHEN {b} THEN l2 END"


_SIDES = f"""{_REPLIES}, cl AS (SELECT *, {_CLEAN.format('t1')} AS c1, {_CLEAN.format('t2')} AS c2 FROM rp), sd AS (SELECT *, {_lse(V.YES)} AS y, {_lse(V.NO)} AS n, list_contains({_list((*V.YES, *V.NO))}, c1) AS decided FROM cl),
am AS (SELECT *, (NOT decided AND NOT (coalesce(exp(y) >= 0.2, false) OR coalesce(exp(n) >= 0.2, false))) OR (y IS NULL AND n IS NULL) AS ambiguous FROM sd)"""


@_register("reply_sides", f"WITH {_SIDES} SELECT doc_id, round(y, 6) AS lp_yes, round(n, 6) AS lp_no, ambiguous FROM am")
def reply_sides(spark, sf_dir):
    yes, no, ambiguous = S.yes_no(S.log_probabilities(F.col("payload")))
    return _replies(spark, sf_dir).select("doc_id", F.round(yes, 6).alias("lp_yes"), F.round(no, 6).alias("lp_no"), ambiguous.alias("ambiguous"))


@_register("reply_scores", f"WITH {_SIDES} SELECT doc_id, CASE WHEN ambiguous OR (y IS NULL AND n IS NULL) THEN {V.AMBIGUOUS_SCORE} ELSE round(1 / (1 + exp(-(CASE WHEN n IS NULL THEN {V.ONE_SIDED} WHEN y IS NULL THEN -{V.ONE_SIDED} ELSE y - n END * power(120.0::DOUBLE / 60, 0.15)))), 4) END AS score FROM am")
def reply_scores(spark, sf_dir):
    yes, no, ambiguous = S.yes_no(S.log_probabilities(F.col("payload")))
    return _replies(spark, sf_dir).select("doc_id", S.length_score(yes, no, F.lit(60), V.LENGTH_EXPONENTS["lfm"], ambiguous).alias("score"))


@_register("raw_probability", f"WITH {_SIDES} SELECT doc_id, CASE WHEN ambiguous OR y IS NULL OR n IS NULL THEN CASE WHEN NOT ambiguous AND y IS NOT NULL THEN round(1 / (1 + exp(-{V.ONE_SIDED}::DOUBLE)), 4) WHEN NOT ambiguous AND n IS NOT NULL THEN round(1 / (1 + exp({V.ONE_SIDED}::DOUBLE)), 4) ELSE {V.AMBIGUOUS_SCORE} END ELSE round(1 / (1 + exp(-(y - n))), 4) END AS p_raw FROM am")
def raw_probability(spark, sf_dir):
    yes, no, ambiguous = S.yes_no(S.log_probabilities(F.col("payload")))
    return _replies(spark, sf_dir).select("doc_id", S.length_score(yes, no, F.lit(120), 0.0, ambiguous).alias("p_raw"))


@_register("reply_sides_max", f"WITH {_REPLIES}, c AS (SELECT *, lower(trim(t1)) AS c1, lower(trim(CASE WHEN shape = 3 THEN t2 || ' ' ELSE t2 END)) AS c2 FROM rp) SELECT doc_id, round(list_max([x for x in [CASE WHEN c1 IN ('yes', 'true', 'y') THEN l1 END, CASE WHEN c2 IN ('yes', 'true', 'y') THEN l2 END] if x IS NOT NULL]), 6) AS lp_yes, round(list_max([x for x in [CASE WHEN c1 IN ('no', 'false', 'n') THEN l1 END, CASE WHEN c2 IN ('no', 'false', 'n') THEN l2 END] if x IS NOT NULL]), 6) AS lp_no FROM c")
def reply_sides_max(spark, sf_dir):
    yes, no = S.yes_no_max(S.log_probabilities(F.col("payload")))
    return _replies(spark, sf_dir).select("doc_id", F.round(yes, 6).alias("lp_yes"), F.round(no, 6).alias("lp_no"))


@_register("ambiguity_events", f"WITH {_SIDES} SELECT doc_id, c1 AS token_text, round(l1, 4) AS logprob, 'prompt ' || doc_id AS prompt_suffix FROM am WHERE ambiguous")
def ambiguity_events(spark, sf_dir):
    rows = _replies(spark, sf_dir).withColumns({"entries": S.log_probabilities(F.col("payload")), "prompt": F.concat(F.lit("prompt "), F.col("doc_id").cast("string"))})
    return S.ambiguity_events(rows).select("doc_id", "token_text", F.round("logprob", 4).alias("logprob"), "prompt_suffix")


# --- symbols ----------------------------------------------------------------------------------------------


def _parts(x: str) -> str:
    return f"[{_norm('w')} for w in [lower(v) for v in string_split_regex(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+') if v <> '']]"


_MARKED = " OR ".join("contains(content, '" + m.replace("'", "''") + "')" for m in V.PUBLIC_MARKERS)
_ROLE = f"""body AS (SELECT *, array_to_string([(start_line + i - 1) || ': ' || x for x, i in own], chr(10)) AS content, end_line - start_line + 1 AS n FROM chunks), pt AS (SELECT *, {_parts('symbol')} AS parts, [c for c in {_parts("regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', '')")} if length(c) >= 3] AS stem FROM body)"""


@_register("symbol_roles", f"WITH {_CUT}, {_ROLE} SELECT chunk_idx, CASE WHEN symbol = '' OR symbol = 'module_scope' THEN 'UNKNOWN' WHEN starts_with(symbol, '_') OR (n <= {V.HELPER_MAX_LINES} AND regexp_matches(content, '(?m)^[ \\t]*static[ \\t]+')) THEN 'INTERNAL_HELPER' WHEN {_MARKED} THEN 'PUBLIC_API' WHEN n <= {V.HELPER_MAX_LINES} AND list_has_any(parts[1:3], {_list(V.HELPER_VERBS)}) THEN 'INTERNAL_HELPER' WHEN list_has_any(stem, parts) THEN 'PUBLIC_API' ELSE 'UNKNOWN' END AS role FROM pt")
def symbol_roles(spark, sf_dir):
    chunks, _ = _cut(spark, sf_dir)
    return chunks.select("chunk_idx", T.symbol_role(F.col("symbol"), F.col("content"), F.col("file_path"), F.col("end_line") - F.col("start_line") + 1).alias("role"))


_ASK = "rename none handling: why does `Cnone` fail in m1.ts"
_ASK_Q = Q.Query.of(_ASK)
_TOKENS_OF = ("rename", "none", "handling", "why", "does", "cnone", "fail", "in", "m1", "ts")
_FILL = _list(ranking.SYMBOL_FILLER)
_SYMBOL = f"""sy AS (SELECT chunk_idx, file_path, symbol, lower(trim(symbol)) AS name, [p for p in [lower(v) for v in string_split_regex(regexp_replace(trim(symbol), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\s]+')] if length(p) >= 2 AND NOT list_contains({_FILL}, p)] AS parts, array_to_string(own, chr(10)) AS content FROM chunks),
sh AS (SELECT *, [p for p in parts if len([w for w in {_list(_TOKENS_OF)} if starts_with(w, p)]) > 0] AS shared FROM sy), rt AS (SELECT *, CASE WHEN len(parts) >= 2 THEN len(shared) / len(parts) ELSE 0.0 END AS ratio, name NOT IN ('', 'module_scope') AND list_contains({_list(_TOKENS_OF)}, name) AS whole FROM sh),
bp AS (SELECT *, CASE WHEN ratio = 1 THEN 1.6 WHEN ratio >= 0.75 THEN 1.1 WHEN ratio >= 0.5 THEN 0.85 + CASE WHEN len([p for p in shared if contains(lower(file_path), p)]) > 0 THEN 0.35 ELSE 0 END ELSE 0.0 END AS parted FROM rt),
fb AS (SELECT *, CASE WHEN name = 'cnone' THEN 1.6 WHEN name <> '' AND (contains(name, 'cnone') OR contains('cnone', name)) THEN 1.1 WHEN contains(content, 'def Cnone') OR contains(content, 'function Cnone') OR contains(content, 'const Cnone') OR contains(content, 'let Cnone') OR contains(content, 'Cnone = ') OR contains(content, 'Cnone(') THEN 0.75 ELSE 0.0 END AS named, whole OR parted > 0 AS matched FROM bp)"""


@_register("symbol_matches", f"WITH {_CUT}, {_SYMBOL} SELECT chunk_idx, CAST(CASE WHEN NOT matched AND named > 0 THEN greatest(greatest(CASE WHEN whole THEN 1.4 ELSE 0 END, parted), named) ELSE greatest(CASE WHEN whole THEN 1.4 ELSE 0 END, parted) END AS DOUBLE) AS delta, matched OR named > 0 AS matched FROM fb")
def symbol_matches(spark, sf_dir):
    chunks, _ = _cut(spark, sf_dir)
    delta, matched = ranking.symbol_delta(Q.Query.of(_ASK, "BUG_DIAGNOSIS"), F.col("symbol"), F.col("file_path"), F.col("content"), F.lit(False))
    return chunks.select("chunk_idx", delta.alias("delta"), matched.alias("matched"))


@_register("path_is_doc", "SELECT page_id, regexp_matches(lower(url), '[.](md|rst|txt|doc)$') OR contains(lower(url), '/docs/') OR contains(lower(url), '/doc/') OR (page_id % 2 = 0 AND contains(lower(url), 'readme')) AS is_doc FROM pages WHERE url IS NOT NULL")
def path_is_doc(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where("url is not null").select("page_id", T.is_doc(F.col("url"), F.when(F.col("page_id") % 2 == 0, "module_scope").otherwise("f")).alias("is_doc"))


@_register("uncovered_blocks", f"""WITH {_FILES}, ln AS (SELECT file_path, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS no FROM files), free AS (SELECT file_path, no FROM ln WHERE NOT (no BETWEEN 4 AND 5 OR no BETWEEN 11 AND 30)), isl AS (SELECT *, no - row_number() OVER (PARTITION BY file_path ORDER BY no) AS g FROM free)
SELECT file_path, CAST(min(no) AS INT) AS start_line, CAST(max(no) AS INT) AS end_line FROM isl GROUP BY file_path, g HAVING count(*) >= 3""")
def uncovered_blocks(spark, sf_dir):
    lines = _files(spark, sf_dir).select("file_path", F.explode(F.sequence(F.lit(1), F.size(F.split("body", "\n")))).alias("line_no"))
    spans = lines.select("file_path").distinct().select("file_path", F.explode(F.array(*[F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for a, b in ((4, 5), (11, 30))])).alias("s")).select("file_path", "s.*")
    return chunking.uncovered_blocks(lines, spans)
