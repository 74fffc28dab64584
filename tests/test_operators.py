"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sievelight.functions import query as Q
from sievelight.functions import vocab as V
from sievelight.operators import calibration, chunking, context, discovery, lexical, metrics, ranking, review, usage
from sievelight.sources import files as source


def pairs(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")


def value(df):
    return df.first()[0]


def files(spark, rows):
    return spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(rows)], "file_idx bigint, file_path string, body string")


def test_windows_cover_every_line(spark):
    body = "\n".join(f"line {i}" for i in range(1, 301)) + "\n"
    rows = chunking.windows(files(spark, [("a.txt", body), ("empty.txt", "")])).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 120), (91, 210), (181, 300)]
    assert rows[0].content.startswith("1: line 1\n2: line 2") and rows[2].end_byte == len(body) - 1


def test_syntax_chunks(spark):
    py = "import os\n\n\ndef authenticate_user(x):\n    return x\n\n\nclass SessionManager:\n    pass\n"
    got = {r.symbol: (r.start_line, r.end_line) for r in chunking.syntax_chunks(files(spark, [("a.py", py)])).collect()}
    assert got["authenticate_user"] == (4, 5) and got["SessionManager"] == (8, 9)


def test_uncovered_blocks(spark):
    lines = spark.createDataFrame([("a", i) for i in range(1, 11)], "file_path string, line_no int")
    spans = spark.createDataFrame([("a", 4, 5)], "file_path string, start_line int, end_line int")
    got = sorted((r.start_line, r.end_line) for r in chunking.uncovered_blocks(lines, spans).collect())
    assert got == [(1, 3), (6, 10)]


def test_discovery_prefers_the_file_named_for_it(spark):
    tree = files(spark, [("src/interop/migrate-fixture.ts", "x"), *[(f"tests/unit-{i}.test.ts", "uses fixture") for i in range(5)]])
    assert discovery.discover(tree, "fixture").first().file_path == "src/interop/migrate-fixture.ts"
    assert discovery.discover(tree, "zzzunknown").count() == 6
    assert discovery.discover(tree, "").count() == 0


def test_tier_one(spark):
    body = "".join(f"word{i} alpha\n" for i in range(2000))
    chunks = chunking.with_index(chunking.windows(files(spark, [("a.txt", body)]), 20, 0))
    q = Q.Query.of("where is word777")
    got = lexical.tier_one(chunks, q)
    assert got.where("kept").count() == V.TIER1_KEEP
    assert got.where("kept and content like '%word777 %'").count() == 1
    assert lexical.tier_one(chunks.limit(50), q).where("kept and reason = 'small_candidate_set'").count() == 50


def test_policy_floor_and_margin(spark):
    def run(scores, **kw):
        df = spark.createDataFrame([(i, float(s), float(s), False, f"f{i}") for i, s in enumerate(scores)], "chunk_idx bigint, order_score double, decision_score double, is_test boolean, file_path string")
        return ranking.policy(df, 0.65, **kw).orderBy("rank").collect()

    rows = run([0.80, 0.50, 0.40, 0.20])
    assert [(r.chunk_idx, r.below_threshold) for r in rows] == [(0, False), (1, True), (2, True)]
    assert [r.chunk_idx for r in run([0.90, 0.80, 0.70, 0.50])] == [0, 1, 2]
    assert len(run([0.12, 0.12])) == 2 and run([0.12, 0.12], allow_empty=True) == []


def test_diversity_closed_form(spark):
    df = spark.createDataFrame([(0, "A", 0.85), (1, "A", 0.84), (2, "B", 0.83)], "chunk_idx bigint, file_path string, decision_score double")
    rows = ranking.diversify(df, penalty=0.20).orderBy(F.desc("order_score")).collect()
    assert [r.chunk_idx for r in rows] == [0, 2, 1]
    assert rows[2].decision_score == pytest.approx(0.8113) and rows[2].redundancy_penalized


def test_metrics(spark):
    assert value(metrics.brier(pairs(spark, [1, 0], [0.8, 0.2]))) == pytest.approx(0.04)
    assert value(metrics.ece(pairs(spark, [1, 1, 1, 1, 0, 1, 0, 0, 0, 0], [0.8] * 5 + [0.2] * 5))) == pytest.approx(0.0)
    assert value(metrics.ece(pairs(spark, [0] * 4, [0.95] * 4))) == pytest.approx(0.95)
    assert value(metrics.auroc(pairs(spark, [1, 0], [0.9, 0.1]))) == 1.0
    assert value(metrics.auroc(pairs(spark, [1, 0], [0.5, 0.5]))) == 0.5
    assert value(metrics.auprc(pairs(spark, [1, 0], [0.1, 0.9]))) == 0.5
    assert value(metrics.auprc(pairs(spark, [0, 0], [0.1, 0.9]))) == 0.0
    rows = metrics.reliability(pairs(spark, [1, 0, 1, 0], [0.15, 0.15, 0.85, 0.85])).orderBy("bin").collect()
    assert len(rows) == 10 and rows[1]["count"] == 2 and rows[1].error == pytest.approx(0.35) and rows[0].mean_predicted is None
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert value(metrics.percentile(df, "v", 95.0)) == pytest.approx(95.05)


def test_empty_metrics(spark):
    none = pairs(spark, [], [])
    assert [value(f(none)) for f in (metrics.brier, metrics.ece, metrics.auroc, metrics.auprc, metrics.brier_skill)] == [0.0] * 5


def test_calibration(spark):
    df = spark.createDataFrame([(float(z), float(y)) for z, y in zip(range(-3, 4), [0, 0, 0, 0, 1, 1, 1])], "z double, y double")
    m = calibration.fit_platt(df)
    assert m.a > 0
    assert value(calibration.fit_temperature(df)) > 0
    with pytest.raises(ValueError):
        calibration.Temperature(0.0)


def test_usage(spark):
    rows = [("cli", 6000.0, True, None), ("cli", 5000.0, True, None), ("cli", 7000.0, True, None), ("hook", 4000.0, True, "ok"), ("hook", 4000.0, True, "ok"), ("hook", None, False, "no"), ("hook", None, False, "no"), ("hook", None, False, "machine-text")]
    df = spark.createDataFrame(rows, "caller string, latencyMs double, queried boolean, outcome string")
    got = {r.caller: (r["count"], r.median_ms) for r in usage.latency_by_caller(df).collect()}
    assert got == {"cli": (3, 6000.0), "hook": (2, 4000.0)}
    share = usage.hook_share(df).first()
    assert (share.prompts, share.queried, share.share) == (4, 2, 0.5)
    assert usage.hook_share(df.limit(0)).first().share is None


def test_usage_log(spark, tmp_path):
    path = str(tmp_path / "log")
    source.append_usage(spark.createDataFrame([("t", "cli", "q" * 600)], "time string, caller string, query string"), path)
    (tmp_path / "log" / "torn.json").write_text('{"time": "t", "cal\n')
    rows = source.read_usage(spark, path).collect()
    assert len(rows) == 1 and len(rows[0].query) == 500


def test_review_gates(spark):
    lines = ["const x = 1;", "function run() {", "  return   x;", "}"]
    claims = [("a", "const x = 1;"), ("b", "fn"), ("c", "  "), ("d", "absent evidence text"), ("onSkip `missingName`", "const x = 1;"), ("e", "run() { return x; }")]
    df = spark.createDataFrame([(t, e, lines, 40) for t, e in claims], "text string, evidence string, lines array<string>, start_line int")
    got = [(r.reason, r.evidence_line) for r in review.gate(df).collect()]
    assert got == [(None, 40), ("EVIDENCE_TOO_SHORT", None), ("EMPTY_EVIDENCE", None), ("EVIDENCE_NOT_FOUND", None), ("CLAIM_SYMBOL_NOT_IN_CHUNK", 40), (None, 41)]


def test_context(spark):
    tree = files(spark, [("a.py", "class ChatProcessor:\n    def _render(self):\n        return helper_one(self)\n\ndef helper_one(x):\n    return x\n")])
    chunk = spark.createDataFrame([(1, "a.py", 2, 3, "_render", "2: def _render(self):\n3:     return helper_one(self)")], "chunk_idx bigint, file_path string, start_line int, end_line int, symbol string, content string")
    text = context.stitch(chunk, tree).first().stitched_context
    assert "Enclosing type: class ChatProcessor" in text and "Calls: def helper_one(x)" in text


def test_score_cache(spark):
    scores = spark.createDataFrame([("k", 0.5, False, False, 1.0), ("k", 0.6, False, False, 2.0), ("f", 0.05, False, True, 1.0)], "cache_key string, score double, ambiguous boolean, failed boolean, created_at double")
    empty = scores.limit(0)
    got = source.put_scores(scores, empty).collect()
    assert [(r.cache_key, r.score) for r in got] == [("k", 0.6)]


def shuffles(df):
    """The hash partitionings of a plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("),")[0] for x in plan.split("Exchange hashpartitioning(")[1:]]


def test_ranking_many_shuffles_pairs_of_numbers_only(spark):
    chunks = chunking.with_index(chunking.windows(files(spark, [("a.txt", "rare words, rare cats\nand the rest"), ("b.txt", "the cat"), ("c.txt", "")]), 2, 1))
    queries = spark.range(2).select(F.col("id").alias("query_id"), F.when(F.col("id") == 0, F.array(F.lit("rare"), F.lit("cat"), F.lit("cat"))).otherwise(F.array(F.lit("dog"))).alias("terms"))
    ranked = lexical.rank_many(chunks, queries, columns=("id", "file_path"))
    got = [(r.query_id, r.file_path, r.rank, r.score) for r in ranked.orderBy("rank").collect()]
    assert got == [(0, "a.txt", 1, 3.5), (0, "b.txt", 2, 1.75)]
    assert all("term" not in s and "id" not in s.replace("query_id", "").replace("chunk_idx", "") for s in shuffles(ranked)) and len(shuffles(ranked)) == 2


def test_definitions_shuffle_nothing(spark):
    code = "class A {\n  int f(x) {\n    return g(x);\n  }\n}\n" + "\n" * 200 + "function g(x) {\n  if (x) { return 1; }\n}\n"
    defs = context.definitions(files(spark, [("a.ts", code), ("b.ts", ""), ("c.py", "def h(x):\n    return x\n\ny = h(1)\ndef last(x):\n    return h(x)")]))
    assert "Exchange" not in defs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.file_path, r.name, r.line, r.end_line) for r in defs.collect())
    assert got == [("a.ts", "A", 1, 5), ("a.ts", "f", 2, 4), ("a.ts", "g", 206, 208), ("c.py", "h", 1, 3), ("c.py", "last", 5, 6)]


def most_joined(spark, df):
    """The most rows that a join of df makes; df must not have run before."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def below(node):
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        return max([own, *(below(node.children().apply(i)) for i in range(node.children().size()))])

    return below(plan)


def test_callees_do_not_pair_calls_with_all_definitions(spark):
    n = 60
    rows = [(f"m{i:02}.py", f"def common(x):\n    return own{i}(x)\n\n\ndef user{i}(x):\n    return common(x)\n") for i in range(n)]
    rows.append(("z.py", "def only(x):\n    return common(x)"))
    code = files(spark, rows)
    chunks = chunking.with_index(chunking.slices(code, 3, 0))
    calls = context.callees(chunks, context.definitions(code))
    got = {r.file_path + str(r.start_line): r.calls for r in chunks.join(calls, "chunk_idx", "left").collect()}
    # a chunk's own line is no callee; there the next file's stands in, for m00 the second file's
    assert got["z.py1"] == ["def common(x):"] and got["m03.py4"] == ["def common(x):"] and got["m03.py1"] is None
    assert most_joined(spark, calls) <= 3 * n


def test_stubs_do_not_join_lines_with_chunks(spark):
    body = "\n".join(["import os", "class A:", "    def f(self):", "        return 1", "", "def g(x):", "    return x", "", "type T"] * 10)
    code = files(spark, [("a.py", body), ("b.py", "x")])
    chunks = chunking.with_index(chunking.slices(code, 3, 0))
    stubs = context.ghost_stubs(chunks, code)
    # one row a file, not one a line of each chunk
    assert most_joined(spark, stubs) == 2
    rows = {r.chunk_idx: r for r in stubs.collect()}
    assert len(rows) == 31 and rows[1].original_lines == 90 and rows[1].stub.startswith("1: import os\n2: class A:\n3:     def f(self):\n5: \n6: def g(x): ... [folded 3 lines]\n9: type T\n")


def test_windows_split_a_text_once(spark):
    cut = chunking.windows(files(spark, [("a", "x\r\ny\rz\n\nlast\r"), ("b", ""), ("c", "\n"), ("d", "\r\n\n")]), 10, 5)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.file_path, r.content) for r in cut.collect()) == [("a", "1: x\n2: y\n3: z\n4: \n5: last"), ("c", "1: "), ("d", "1: \n2: ")]
