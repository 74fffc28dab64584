"""Registered queries on source code.

The tables hold no code, so files are made from `documents`: every line of a text gives one line of Python (even ids) or
TypeScript (odd ids) whose names are the text's words, so that definitions, calls and unclosed blocks occur at table
scale."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import vocab as V
from .operators import chunking, context
from .queries import OVERLAP, SIZE, _list, _register, _table

# W and V stand for a word of the line and of another one, T for the line
_PYTHON = ("'class C' || W || ':'", "'    def ' || W || '(self, x):'", "'        return ' || V || '(x)'", "''", "'def ' || W || '(x):'", "'\t y = ' || V || '(x) + sum(y)'", "'# ' || T")
_SCRIPT = ("'export class C' || W || ' {'", "'  int ' || W || '(x) {'", "'    return ' || V || '(x);'", "'  }'", "'}'", "'export function ' || W || '(x) {'", "'  if (' || V || '(x)) { return 1; }'", "'}'", "W || '(y) {'")


def _cases(templates, number: str, word: str, other: str, line: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(templates))
    for sign, value in (("W", word), ("V", other), ("T", line)):
        cases = re.sub(rf"(?<= ){sign}(?= |$)", value, cases)
    return f"CASE {number} % {len(templates)} {cases} END"


def _code_files(spark, sf_dir):
    """file_idx, file_path, body."""
    word = "lower(regexp_extract({0}, '[A-Za-z]{{3,8}}', 0))"
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    docs = docs.withColumn("words", F.expr(f"transform(l, t -> if({word.format('t')} = '', 'none', {word.format('t')}))"))
    lines = [f"transform(zip_with(l, words, (t, w) -> struct(t, w)), (p, i) -> {_cases(x, 'i', 'p.w', 'words[(i * 5) % size(l)]', 'p.t')})" for x in (_PYTHON, _SCRIPT)]
    even = F.col("doc_id") % 2 == 0
    return docs.select(
        F.col("doc_id").alias("file_idx"),
        F.concat(F.lit("/src/pkg"), (F.col("doc_id") % 20).cast("string"), F.lit("/m"), F.col("doc_id").cast("string"), F.when(even, ".py").otherwise(".ts")).alias("file_path"),
        F.array_join(F.when(even, F.expr(lines[0])).otherwise(F.expr(lines[1])), "\n").alias("body"),
    )


def _sql_lines(templates) -> str:
    return "[" + _cases(templates, "(i - 1)", "words[i]", "words[((i - 1) * 5) % len(l) + 1]", "t") + " for t, i in l]"


_QUOTED = {k: getattr(V, k).replace("'", "''") for k in ("DEFINITION_LED", "DEFINITION_HEAD", "DEFINITION_TAIL")}
# the bare pattern whole, as the engine behind this SQL matches in linear time
_BARE = _QUOTED["DEFINITION_HEAD"][:-1] + "\\([^;]*" + _QUOTED["DEFINITION_TAIL"][len("^[^;]*") :]
_BODY = f"""words AS (SELECT doc_id, l, [CASE WHEN x = '' THEN 'none' ELSE x END for x in [lower(regexp_extract(t, '[A-Za-z]{{3,8}}')) for t in l]] AS words FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
files AS (SELECT doc_id AS file_idx, '/src/pkg' || (doc_id % 20) || '/m' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END AS file_path, array_to_string(CASE WHEN doc_id % 2 = 0 THEN {_sql_lines(_PYTHON)} ELSE {_sql_lines(_SCRIPT)} END, chr(10)) AS body FROM words),
cut AS (SELECT file_idx, file_path, regexp_split_to_array(body, '\\r\\n|\\r|\\n') AS l FROM files), trimmed AS (SELECT file_idx, file_path, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM cut),
ln AS (SELECT file_idx, file_path, unnest(l) AS text, unnest(generate_series(1, len(l))) AS no FROM trimmed WHERE len(l) > 0),
lm AS (SELECT *, length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', '')) AS d, length(text) - length(regexp_replace(text, '^\\s+', '')) AS width, regexp_replace(text, '^\\s+', '') = '' AS blank FROM ln),
lw AS (SELECT *, sum(d) OVER (PARTITION BY file_idx ORDER BY no) AS s, max(no) OVER (PARTITION BY file_idx) AS final FROM lm),
cand AS (SELECT *, regexp_extract(text, '{_QUOTED["DEFINITION_LED"]}', 2) AS led, regexp_extract(text, '{_QUOTED["DEFINITION_LED"]}', 3) AS ledname, regexp_extract(text, '{_BARE}', 2) AS bare FROM lw WHERE NOT blank AND NOT regexp_matches(text, '^\\s*(//|#|\\*|/\\*)')),
dd AS (SELECT file_idx, file_path, no AS line, CASE WHEN led IN ('def', 'fn', 'func', 'function', '') THEN 'function' ELSE led END AS kind, CASE WHEN led <> '' THEN ledname ELSE bare END AS name,
  CASE WHEN starts_with(text, chr(9)) THEN 4 ELSE length(regexp_extract(text, '^ *')) END AS indent, regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[{{ ]+$', ''), '\\s+$', '') AS signature, final FROM cand WHERE led <> '' OR (bare <> '' AND NOT list_contains({_list(V.NO_CALLS)}, bare))),
op AS (SELECT dd.*, (SELECT min(o.no) FROM lw o WHERE o.file_idx = dd.file_idx AND o.no BETWEEN dd.line AND dd.line + 2 AND contains(o.text, '{{')) AS o FROM dd),
ba AS (SELECT op.*, (SELECT b.s - b.d FROM lw b WHERE b.file_idx = op.file_idx AND b.no = op.o) AS base FROM op),
defs AS (SELECT file_idx, file_path, CAST(line AS INT) AS line, CAST(coalesce(CASE WHEN o IS NOT NULL THEN (SELECT min(c.no) FROM lw c WHERE c.file_idx = ba.file_idx AND c.no >= o AND c.s <= base) ELSE (SELECT min(c.no) - 1 FROM lw c WHERE c.file_idx = ba.file_idx AND c.no > line AND NOT c.blank AND c.width <= indent) END, final) AS INT) AS end_line,
  CAST(indent AS INT) AS indent, kind, name, CASE WHEN length(signature) > 160 THEN rtrim(signature[1:157]) || '...' ELSE signature END AS signature FROM ba)"""


@_register("definitions", f"WITH {_BODY} SELECT * FROM defs")
def definitions(spark, sf_dir):
    return context.definitions(_code_files(spark, sf_dir))


_CUT = f"""{_BODY}, parts AS (SELECT file_idx, file_path, string_split(body, chr(10)) AS l FROM files),
begun AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((len(l) - {SIZE}) / {SIZE - OVERLAP}.0)) AS INT) * {SIZE - OVERLAP}, {SIZE - OVERLAP})) AS s FROM parts),
chunks AS (SELECT file_idx, file_path, CAST(s + 1 AS INT) AS start_line, CAST(least(len(l), s + {SIZE}) AS INT) AS end_line, (file_idx << 32) + s + 1 AS chunk_idx, l[s + 1:s + {SIZE}] AS own,
  coalesce([x for x in [regexp_extract(v, '^(?:export\\s+|public\\s+|static\\s+|async\\s+)*(?:class|interface|struct|function|def|fn|func|type)\\s+([A-Za-z0-9_]+)', 1) for v in l[s + 1:s + {SIZE}]] if x <> ''][1], regexp_extract(file_path, '[^/]*$')) AS symbol FROM begun)"""


def _cut(spark, sf_dir):
    files = _code_files(spark, sf_dir)
    return chunking.with_index(chunking.slices(files, SIZE, OVERLAP)), files


_TYPES = _list(context.TYPES)
_ENCLOSING = f"enclosing AS (SELECT chunk_idx, arg_max(signature, {{'a': indent, 'b': line}}) AS enclosing FROM chunks JOIN defs USING (file_path) WHERE list_contains({_TYPES}, kind) AND line < start_line AND start_line <= defs.end_line GROUP BY 1)".replace("chunks JOIN defs", "chunks c JOIN defs")


@_register("enclosing_types", f"WITH {_CUT}, {_ENCLOSING} SELECT * FROM enclosing")
def enclosing_types(spark, sf_dir):
    chunks, files = _cut(spark, sf_dir)
    return context.enclosing_types(chunks, context.definitions(files))


_CALLED = f"""named AS (SELECT chunk_idx, file_path, start_line, end_line, symbol, [x for x in regexp_extract_all(array_to_string(own, chr(10)), '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{{2,}})\\s*\\(', 1) if NOT list_contains({_list(V.NO_CALLS)}, x)] AS names FROM chunks),
each AS (SELECT chunk_idx, name, min(pos) AS pos FROM (SELECT chunk_idx, unnest(names) AS name, unnest(generate_series(1, len(names))) AS pos FROM named) u GROUP BY ALL)"""


@_register("called_names", f"WITH {_CUT}, {_CALLED} SELECT chunk_idx, string_agg(name, ',' ORDER BY pos) AS names FROM each GROUP BY 1")
def called_names(spark, sf_dir):
    chunks, _ = _cut(spark, sf_dir)
    return chunks.select("chunk_idx", F.array_join(context.called_names(F.col("content")), ",").alias("names")).where("names != ''")


_CALLEES = f"""{_CALLED}, hit AS (SELECT each.chunk_idx, pos, signature, row_number() OVER (PARTITION BY each.chunk_idx, pos ORDER BY CASE WHEN c.file_path = d.file_path THEN 0 ELSE 1 END, d.file_idx, d.line) AS k
  FROM each JOIN chunks c USING (chunk_idx) JOIN defs d ON d.name = each.name WHERE NOT (c.file_path = d.file_path AND d.line BETWEEN c.start_line AND c.end_line) AND d.name IS DISTINCT FROM c.symbol),
first4 AS (SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY pos) AS r FROM hit WHERE k = 1), callees AS (SELECT chunk_idx, list(signature ORDER BY pos) AS calls FROM first4 WHERE r <= {context.MOST_CALLEES} GROUP BY 1)"""


@_register("callees", f"WITH {_CUT}, {_CALLEES} SELECT chunk_idx, array_to_string(calls, ' | ') AS calls FROM callees")
def callees(spark, sf_dir):
    chunks, files = _cut(spark, sf_dir)
    return context.callees(chunks, context.definitions(files)).withColumn("calls", F.array_join("calls", " | "))


_CALLERS = f"""site AS (SELECT DISTINCT file_path, no, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS symbol FROM ln),
sited AS (SELECT c.chunk_idx, site.symbol, site.no, c.file_path FROM site JOIN chunks c USING (file_path, symbol) WHERE no < c.start_line OR no > c.end_line),
owner AS (SELECT chunk_idx, symbol, no, arg_max({{'n': name, 's': signature}}, {{'a': indent, 'b': line}}) AS o FROM sited JOIN defs USING (file_path) WHERE NOT list_contains({_TYPES}, kind) AND line <= no AND no <= end_line GROUP BY ALL),
one AS (SELECT chunk_idx, o.s AS s, min(no) AS no FROM owner WHERE o.n <> symbol GROUP BY chunk_idx, o.n, o.s), rr AS (SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY no) AS r FROM one),
callers AS (SELECT chunk_idx, list(s ORDER BY no) AS callers FROM rr WHERE r <= {context.MOST_CALLERS} GROUP BY 1)"""


@_register("callers", f"WITH {_CUT}, {_CALLERS} SELECT chunk_idx, array_to_string(callers, ' | ') AS callers FROM callers")
def callers(spark, sf_dir):
    chunks, files = _cut(spark, sf_dir)
    return context.callers(chunks, files, context.definitions(files)).withColumn("callers", F.array_join("callers", " | "))


def _budgeted() -> str:
    """Text t0, t1, ...: each step adds a line if its section is still open and the text stays within the budget."""
    steps, text, n = [], f"'{context.HEADER}'", 0
    for prefix, items, most in (("Enclosing type: ", "CASE WHEN enclosing IS NULL THEN []::VARCHAR[] ELSE [enclosing] END", 1), ("Calls: ", "coalesce(calls, []::VARCHAR[])", context.MOST_CALLEES), ("Called by: ", "coalesce(callers, []::VARCHAR[])", context.MOST_CALLERS)):
        before = "true"
        for k in range(1, most + 1):
            line = f"t{n} || chr(10) || '{prefix}' || ({items})[{k}]"
            fits = f"({before} AND len({items}) >= {k} AND floor(length({line}) / 3.6) <= {context.BUDGET_TOKENS})"
            steps.append(f"s{n + 1} AS MATERIALIZED (SELECT *, coalesce({fits}, false) AS f{n + 1}, CASE WHEN {fits} THEN {line} ELSE t{n} END AS t{n + 1} FROM s{n})")
            n += 1
            before = f"f{n}"
    return f"s0 AS MATERIALIZED (SELECT chunks.chunk_idx, enclosing, calls, callers, {text} AS t0 FROM chunks LEFT JOIN enclosing USING (chunk_idx) LEFT JOIN callees USING (chunk_idx) LEFT JOIN callers USING (chunk_idx)), " + ", ".join(steps) + f", done AS (SELECT chunk_idx, CASE WHEN t{n} <> t0 THEN t{n} END AS stitched_context FROM s{n})"


_STITCHED = f"{_CUT}, {_ENCLOSING}, {_CALLEES}, {_CALLERS}, {_budgeted()}"


@_register("stitched_context", f"WITH {_STITCHED} SELECT chunk_idx, stitched_context FROM done")
def stitched_context(spark, sf_dir):
    chunks, files = _cut(spark, sf_dir)
    return context.stitch(chunks, files).select("chunk_idx", "stitched_context")


@_register("stitch_counts", f"WITH {_STITCHED} SELECT CAST(count(stitched_context) AS BIGINT) AS stitched, CAST(coalesce(sum(CASE WHEN stitched_context IS NOT NULL THEN greatest(1, floor(length(stitched_context) / 3.6)) END), 0) AS BIGINT) AS context_tokens FROM done")
def stitch_counts(spark, sf_dir):
    chunks, files = _cut(spark, sf_dir)
    return context.stitch_counts(context.stitch(chunks, files))


@_register("previous_type", f"""WITH {_CUT}, tl AS (SELECT file_path, no, trim(text) AS t FROM (SELECT file_path, unnest(l) AS text, unnest(generate_series(1, len(l))) AS no FROM parts) WHERE regexp_matches(trim(text), '^(?:export\\s+|public\\s+)*(?:class|struct|interface|trait|enum)\\s+[A-Za-z0-9_]+')),
b AS (SELECT chunk_idx, '// [Stitched Context: Enclosing Type]' || chr(10) || '// ' || arg_max(t, no) || chr(10) AS x FROM chunks JOIN tl USING (file_path) WHERE no < start_line GROUP BY 1)
SELECT chunk_idx, CASE WHEN ceil(length(x) / 4) <= {context.BUDGET_TOKENS} THEN x END AS stitched_context FROM chunks LEFT JOIN b USING (chunk_idx)""")
def previous_type(spark, sf_dir):
    chunks, files = _cut(spark, sf_dir)
    return context.previous_type(chunks, files).select("chunk_idx", "stitched_context")


@_register("signatures", """WITH s AS (SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS x FROM pages WHERE html IS NOT NULL), t AS (SELECT page_id, regexp_replace(regexp_replace(x, '[{ ]+$', ''), '\\s+$', '') AS x FROM s)
SELECT page_id, CASE WHEN length(x) > 160 THEN rtrim(x[1:157]) || '...' ELSE x END AS signature FROM t""")
def signatures(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where("html is not null").select("page_id", context.signature_of(F.col("html")).alias("signature"))


_STUB = {k: getattr(V, k).replace("'", "''") for k in ("STUB_KEPT", "STUB_TYPE", "STUB_BRACED", "STUB_INDENTED")}
_FAR = 2**31 - 1
_GHOST = f"""WITH RECURSIVE {_CUT}, sl AS (SELECT file_path, unnest(l) AS text, unnest(generate_series(1, len(l))) AS no FROM parts),
sm AS (SELECT *, length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', '')) AS d, length(text) - length(regexp_replace(text, '^\\s+', '')) AS width, regexp_replace(text, '^\\s+', '') = '' AS blank, ends_with(file_path, '.py') AS py, regexp_matches(text, '{_STUB["STUB_KEPT"]}') AS imp, regexp_matches(text, '{_STUB["STUB_TYPE"]}') AS typ FROM sl),
sr AS (SELECT c.chunk_idx, c.start_line, sm.*, no > c.end_line AS late, no BETWEEN c.start_line AND c.end_line AS target, no < c.start_line AND imp AS kept FROM chunks c JOIN sm USING (file_path)),
ss AS MATERIALIZED (SELECT *, sum(CASE WHEN kept THEN 0 ELSE d END) OVER (PARTITION BY chunk_idx ORDER BY no) AS s FROM sr),
oq AS (SELECT * FROM ss WHERE NOT target AND NOT kept AND CASE WHEN py THEN regexp_matches(text, '{_STUB["STUB_INDENTED"]}') ELSE d > 0 AND regexp_matches(text, '{_STUB["STUB_BRACED"]}') END),
cb AS (SELECT o.chunk_idx, o.no AS first, o.late, o.py, o.text AS header, o.start_line, min(t.no) AS close FROM oq o LEFT JOIN ss t ON t.chunk_idx = o.chunk_idx AND t.no > o.no AND t.late = o.late AND NOT t.target AND NOT t.kept AND CASE WHEN o.py THEN NOT t.blank AND t.width <= o.width ELSE t.s <= o.s - o.d END GROUP BY ALL),
bn AS MATERIALIZED (SELECT *, coalesce(close, CASE WHEN late THEN {_FAR} ELSE start_line END) AS until FROM cb), bx AS MATERIALIZED (SELECT a.*, (SELECT min(b.first) FROM bn b WHERE b.chunk_idx = a.chunk_idx AND b.first > a.until) AS follow FROM bn a),
bk AS (SELECT * FROM bx WHERE first = (SELECT min(z.first) FROM bn z WHERE z.chunk_idx = bx.chunk_idx) UNION ALL SELECT bx.* FROM bk JOIN bx ON bx.chunk_idx = bk.chunk_idx AND bx.first = bk.follow),
tt AS MATERIALIZED (SELECT chunk_idx, max(no) AS total FROM ss GROUP BY 1), fd AS (SELECT chunk_idx, first, close, py, header, coalesce(close, total) - first AS k FROM bk JOIN tt USING (chunk_idx) WHERE close IS NOT NULL OR late),
fl AS (SELECT chunk_idx, coalesce(close, {_FAR}) AS no, 0 AS part, first || ': ' || CASE WHEN py THEN trim(header) ELSE trim(string_split(header, '{{')[1]) END || CASE WHEN py OR close IS NULL THEN ' ... [folded ' || k || ' lines]' ELSE ' {{ /* ... [folded ' || k || ' lines] ... */ }}' END AS line, false AS nil, k FROM fd),
mk AS (SELECT ss.*, EXISTS (SELECT 1 FROM bk WHERE bk.chunk_idx = ss.chunk_idx AND ss.no >= bk.first AND (ss.no < bk.until OR (NOT bk.py AND ss.no = bk.close))) AS hidden, EXISTS (SELECT 1 FROM bk WHERE bk.chunk_idx = ss.chunk_idx AND bk.py AND ss.no = bk.close) AS closing FROM ss),
sg AS (SELECT chunk_idx, no, 1 AS part, no || ': ' || CASE WHEN blank AND NOT target AND NOT kept THEN '' ELSE text END AS line, blank AND NOT target AND NOT kept AS nil, 0 AS k FROM mk WHERE target OR kept OR (NOT hidden AND (closing OR typ OR blank))),
al AS (SELECT *, last_value(CASE WHEN NOT nil THEN line END IGNORE NULLS) OVER w AS seen, sum(CAST(NOT nil AS INT)) OVER w AS run FROM (SELECT * FROM fl UNION ALL SELECT * FROM sg) WINDOW w AS (PARTITION BY chunk_idx ORDER BY no, part ROWS UNBOUNDED PRECEDING)),
nt AS (SELECT *, row_number() OVER (PARTITION BY chunk_idx, run, nil ORDER BY no, part) AS nth FROM al), jn AS (SELECT chunk_idx, string_agg(line, chr(10) ORDER BY no, part) AS stub, sum(k) AS k FROM nt WHERE NOT nil OR (nth = 1 AND seen IS NOT NULL AND NOT ends_with(seen, ': ')) GROUP BY 1)
SELECT chunk_idx, coalesce(stub, '') AS stub, CAST(coalesce(k, 0) AS INT) AS folded_lines, CAST(total AS INT) AS original_lines FROM tt LEFT JOIN jn USING (chunk_idx)"""


@_register("ghost_stubs", _GHOST)
def ghost_stubs(spark, sf_dir):
    return context.ghost_stubs(*_cut(spark, sf_dir))


@_register("syntax_chunks")
def syntax_chunks(spark, sf_dir):
    return chunking.syntax_chunks(_code_files(spark, sf_dir)).select("id", "symbol", "start_line", "end_line", "token_est", "content_hash")
