"""Sources, the usage stream and the whole plan on a small tree."""

from pyspark.sql import functions as F

from sievelight import schemas
from sievelight.operators import chunking, scoring
from sievelight.plans.rerank import rerank
from sievelight.sources import files as source
from sievelight.streaming.usage_stream import read_usage_stream, windowed_latency


def test_read_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.py").write_bytes(b"\x00\x01")
    (tmp_path / "src/c.py").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "src/d.txt").write_text("no code")
    (tmp_path / "node_modules/e.py").write_text("x")
    got = source.read_files(spark, str(tmp_path)).collect()
    assert [(r.file_path.rsplit("/", 1)[1], r.body) for r in got] == [("a.py", "x = 1\n")]


def test_resolve_paths(spark):
    paths = ["src/a.ts", "src/deep/b.ts", "src/c.py", "x/node_modules/d.ts", "lib/e.ts"]
    df = spark.createDataFrame([(i, p, "") for i, p in enumerate(paths)], "file_idx bigint, file_path string, body string")
    assert [r.file_path for r in source.resolve_paths(df, ["src/**/*.ts"]).collect()] == ["src/a.ts", "src/deep/b.ts"]
    assert [r.file_path for r in source.resolve_paths(df, ["lib", "src/?.py"]).collect()] == ["lib/e.ts", "src/c.py"]
    assert source.path_keyword_files(df, ["deep", "ts"]).first().file_path == "src/deep/b.ts"


def test_last_user_request(spark):
    lines = ['{"type":"USER_INPUT","content":"<USER_REQUEST> first </USER_REQUEST>"}', "torn {", '{"type":"USER_INPUT","content":"plain words"}', '{"type":"OTHER","content":"x"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert source.last_user_request(df).first().request == "plain words"
    assert source.last_user_request(df.limit(1)).first().request == "first"


def test_usage_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("2024-01-01T00:01:00Z", "cli", 10.0), ("2024-01-01T00:02:00Z", "cli", 30.0), ("2024-01-01T02:00:00Z", "hook", 5.0)]
    spark.createDataFrame(rows, "time string, caller string, latencyMs double").write.json(log)
    stream = windowed_latency(read_usage_stream(spark, log)).writeStream.outputMode("complete").format("memory").queryName("usage_windows").start()
    stream.processAllAvailable()
    stream.stop()
    got = {(r.caller, r["count"], r.mean_ms) for r in spark.table("usage_windows").collect()}
    assert got == {("cli", 2, 20.0), ("hook", 1, 5.0)}
    assert "caller string" in schemas.USAGE


def test_rerank_with_table_scores(spark):
    files = spark.createDataFrame([(0, "src/cache.py", "def load_cache():\n    return 1\n"), (1, "src/other.py", "x = 2\n")], "file_idx bigint, file_path string, body string")
    chunks = chunking.windows(files)
    yes = '[{"token":"yes","logprob":-0.05},{"token":"no","logprob":-3.0}]'
    payloads = chunks.where("file_path = 'src/cache.py'").select("content_hash", F.lit(yes).alias("payload"))
    answer = rerank(files, "where is the cache loaded", scorer=scoring.TableScorer(payloads))
    rows = answer.results.orderBy("rank").collect()
    assert rows[0].file_path == "src/cache.py" and rows[0].ground_truth_status == "VERIFIED" and rows[0].raw_score > 0.9
    assert {r.file_path: r.status for r in answer.manifest.collect()} == {"src/cache.py": "included", "src/other.py": "included"}
    assert answer.telemetry.first().failed == 1
