"""Settings, model servers, reports, the line protocol and the command line."""

import io
import json
from pathlib import Path

import pytest

from sievelight.operators import calibration, context, hooks, review
from sievelight.operators.scoring import HashScorer
from sievelight.plans import trials
from sievelight.service import cli, endpoints, reports, rpc, settings
from sievelight.sources import files as source


def test_settings_precedence(tmp_path):
    values = {"model": "lfm", "endpoints": {"lfm": "http://own/v1"}, "base_url": "http://file/v1"}
    assert settings.resolve("m", "http://arg", values, {}) == ("m", "http://arg")
    assert settings.resolve(None, None, values, {"SIEVELIGHT_ENDPOINT": " http://env "}) == ("lfm", "http://env")
    assert settings.resolve(None, None, values, {}) == ("lfm", "http://own/v1")
    assert settings.resolve("other", None, values, {}) == ("other", "http://file/v1")
    assert settings.resolve(None, None, {}, {"SIEVELIGHT_HOST": "box"}) == (None, "http://box:8034/v1")
    assert settings.resolve(None, None, {}, {"SIEVELIGHT_HOST": "127.0.0.1"}) == (None, None)
    path = settings.save({"model": "x"}, tmp_path / "a" / "config.json")
    assert settings.load(path) == {"model": "x"} and settings.load(tmp_path / "none") == {}
    path.write_text("# c\nmodel: 'y'\nbase_url: http://h:1\n")
    assert settings.load(path) == {"model": "y", "base_url": "http://h:1"}


def test_folders():
    home = Path("/home/u")
    assert settings.cache_dir({}, "linux", home) == home / ".cache/sievelight"
    assert settings.cache_dir({"XDG_CACHE_HOME": "/c"}, "linux", home) == Path("/c/sievelight")
    assert settings.cache_dir({}, "darwin", home) == home / "Library/Caches/sievelight"
    assert settings.cache_dir({"LOCALAPPDATA": "/l"}, "win32", home) == Path("/l/sievelight")
    assert settings.cache_dir({"SIEVELIGHT_CACHE_DIR": "/x"}, "win32", home) == Path("/x")
    assert settings.config_path({"XDG_CONFIG_HOME": "/g"}, home) == Path("/g/sievelight/config.json")
    assert settings.config_path({}, home) == home / ".config/sievelight/config.json"


@pytest.mark.parametrize("base", ["http://h:1", "http://h:1/", "http://h:1/v1", "http://h:1/v1/", "http://h:1/completion", "http://h:1/v1/chat/completions"])
def test_addresses(base):
    assert endpoints.addresses(base) == {"completion": "http://h:1/completion", "chat": "http://h:1/v1/chat/completions", "models": "http://h:1/v1/models", "tokenize": "http://h:1/tokenize"}


def test_replies_and_profiles():
    assert [endpoints.reply_text(x) for x in ({"content": "a"}, {"choices": [{"text": "b"}]}, {"choices": [{"message": {"content": "c"}}]}, {"choices": []}, None, [])] == ["a", "b", "c", "", "", ""]
    assert [endpoints.profile_name(x) for x in ("LFM2.5", "qwq", "vllm", "who")] == ["lfm", "qwen", "openai", "openai"]
    assert endpoints.detect_profile("http://h:1", lambda url: {"models": [{"name": "Gemma-3"}]}) == "gemma"
    assert [endpoints.detect_profile(f"http://h:{p}", lambda url: None) for p in (8033, 8000, 11434, 9)] == ["qwen", "rwkv", "openai", "lfm"]
    assert endpoints.token_ids("http://h", ["yes", "no way"], lambda url, body: {"tokens": [7] if body["content"] == "yes" else [1, 2]}) == {7}
    assert endpoints.token_ids("http://h", ["yes"], lambda url, body: None) == set()


def test_server_discovery():
    served = {8035: "qwen3", 8034: "lfm2", 8039: "big"}

    def get(url):
        port = int(url.split(":")[2].split("/")[0])
        return {"data": [{"id": served[port]}]} if port in served else None

    assert endpoints.discover("h", get=get)["port"] == 8034
    assert endpoints.discover("h", wanted="QWEN", get=get)["model"] == "qwen3"
    assert endpoints.discover("h", (8036, 8039), get=get)["url"] == "http://h:8039/v1"
    assert endpoints.discover("h", pinned="http://p", get=get)["url"] == "http://p"
    none = endpoints.discover("h", (1, 2), get=get)
    assert none["url"] is None and "h, ports 1 to 2" in none["reason"]


def test_line_protocol():
    def echo(text):
        if text == "none":
            raise rpc.ToolFailure("nothing")
        return text.upper()

    server = rpc.Server([rpc.Tool("echo", "says it", echo, ("text",), {"text": {"type": "string"}})])
    lines = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "echo", "arguments": {"text": "hi", "more": 1}}},
        {"id": 4, "method": "tools/call", "params": {"name": "echo", "arguments": {}}}, {"id": 5, "method": "tools/call", "params": {"name": "no"}}, {"id": 6, "method": "what"}, {"id": 7}, [{"id": 8, "method": "ping"}, {"method": "ping"}, 3],
        {"id": 9, "method": "tools/call", "params": {"name": "echo", "arguments": {"text": "none"}}},
    ]
    out = io.StringIO()
    server.serve([*(json.dumps(x) for x in lines), "", "{bad"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got if isinstance(x, dict)] == [1, 2, 3, 4, 5, 6, 7, 9, None]
    by = {x["id"]: x for x in got if isinstance(x, dict)}
    assert by[3]["result"]["content"][0]["text"] == "HI" and by[9]["result"]["isError"]
    assert [by[i]["error"]["code"] for i in (4, 5, 6, 7, None)] == [rpc.INVALID_PARAMS, rpc.METHOD_NOT_FOUND, rpc.METHOD_NOT_FOUND, rpc.INVALID_REQUEST, rpc.PARSE_ERROR]
    assert [x.get("id") for x in got[7]] == [8, None]


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "cache.py").write_text("def sort_cache(rows):\n    return sorted(rows)\n")
    (tmp_path / "other.py").write_text("def other():\n    pass\n")
    for name in (*settings.ENDPOINT_VARS, *settings.HOST_VARS):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    args = cli.parser().parse_args(["rerank", "where is the cache sorted", "--root", str(tmp_path)])
    lines = [r.line for r in cli.answer(spark, args).collect()]
    assert lines and lines[0].startswith("#1 | ") and "cache.py:1-2 | " in " ".join(lines)
    args = cli.parser().parse_args(["fast", "where is the cache sorted", "--root", str(tmp_path), "--json"])
    assert "cache.py" in json.loads(cli.answer(spark, args).first().line)["id"]
    reply = cli.server(spark).handle({"id": 1, "method": "tools/call", "params": {"name": "rerank", "arguments": {"query": "cache", "paths": [str(tmp_path / "nothing.py")], "root": str(tmp_path)}}})
    assert reply["result"]["isError"]
    assert cli.main(["fast"]) == 2


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c", None), (1, "a", 0.5)], "n int, t string, x double")
    lines = [r.line for r in reports.markdown_lines(rows, ["n"]).orderBy("place").collect()]
    assert lines == ["| n | t | x |", "|---|---|---|", "| 1 | a | 0.5 |", "| 2 | b\\|c | - |"]
    reports.write_text(reports.markdown_lines(rows, ["n"]), str(tmp_path / "out"), ["place"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == lines
    one = rows.limit(1).selectExpr("'s' as stage", "1.0 as v")
    report = reports.evaluation_report(one, one, one.withColumnRenamed("stage", "metric")).collect()
    assert {r.section for r in report} == {"stages", "ranking", "intervals"} and len(report) == 9


def test_score_cache_on_disk(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert source.open_score_cache(spark, path).count() == 0
    new = spark.createDataFrame([("k", 0.5, 1.0, False, False), ("k", 0.7, 2.0, False, False), ("f", 0.1, 1.0, False, True)], "cache_key string, score double, created_at double, ambiguous boolean, failed boolean")
    source.store_scores(new, path)
    source.store_scores(new, path)
    assert [(r.cache_key, r.score) for r in source.read_score_cache(spark, path).collect()] == [("k", 0.7)]


def test_default_calibrator():
    before = calibration.default_calibrator()
    assert (before.a, before.b) == (0.60, -2.10)
    calibration.set_default_calibrator(calibration.Temperature(2.0))
    assert calibration.default_calibrator().t == 2.0
    calibration.set_default_calibrator(before)


def test_trials(spark):
    tree = spark.createDataFrame([(0, "a.py", "def a():\n    return 1\n")], "file_idx bigint, file_path string, body string")
    rows = trials.trials(tree, "where is a", HashScorer(), (1, 2)).collect()
    assert [(r.trial, r.in_flight) for r in rows] == [("cold", 1), ("cold", 2), ("warm", 0)] and len({r.results for r in rows}) == 1


def stub(spark, path, body, start, end):
    chunk = spark.createDataFrame([(1, path, start, end)], "chunk_idx bigint, file_path string, start_line int, end_line int")
    files = spark.createDataFrame([(0, path, body)], "file_idx bigint, file_path string, body string")
    return context.ghost_stubs(chunk, files).first()


def test_stubs_fold_other_blocks(spark):
    py = "import os\n\nclass A:\n    x = 1\n\n    def f(self):\n        return 1\n\nz = 3\n\ndef target():\n    pass\n\ndef last():\n    a\n    b\n"
    r = stub(spark, "a.py", py, 11, 12)
    assert r.stub.split("\n") == ["1: import os", "2: ", "3: class A: ... [folded 6 lines]", "9: z = 3", "10: ", "11: def target():", "12:     pass", "13: ", "14: def last(): ... [folded 3 lines]"]
    assert (r.folded_lines, r.original_lines) == (9, 17)
    ts = 'import { a } from "a";\nexport interface P {\n}\nfunction one() {\n  if (x) {\n  }\n}\nlet y = 1;\nfunction two() {\n  return 2;\n}\nfunction three() {\n  open();\n'
    r = stub(spark, "a.ts", ts, 9, 11)
    assert r.stub.split("\n") == ['1: import { a } from "a";', "2: export interface P {", "4: function one() { /* ... [folded 3 lines] ... */ }", "9: function two() {", "10:   return 2;", "11: }", "12: function three() ... [folded 2 lines]"]


def test_stub_of_a_block_around_the_target(spark):
    py = "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n"
    # the class is open when the target begins, so nothing of it is written before
    assert stub(spark, "a.py", py, 5, 6).stub.split("\n") == ["5:     def g(self):", "6:         return 2", "7: "]


def test_long_lines_are_definitions(spark):
    long = "int " + "very_long_type_name<" * 40 + "x" + ">" * 40 + " make_it(const char * name) {"
    files = spark.createDataFrame([(0, "a.cpp", f"{long}\n}}\n" + "(" * 3000 + "{\n" + "a b " * 5000 + "{\n")], "file_idx bigint, file_path string, body string")
    rows = context.definitions(files).collect()
    assert [(r.name, r.line, r.end_line) for r in rows] == [("make_it", 1, 2)] and len(rows[0].signature) == 160 and rows[0].signature.endswith("...")


def test_hook_budget_stops_after_three(spark):
    rows = spark.createDataFrame([("q", i, 100.0 - i, 0.9 if i < 4 else 0.1, False) for i in range(20)], "query_id string, chunk_idx bigint, lexical_score double, raw_score double, error boolean")
    got = hooks.within_budget(rows, ["query_id"]).orderBy("rank").collect()
    assert [r.chunk_idx for r in got] == [0, 1, 2]


def test_review_without_judges(spark):
    files = spark.createDataFrame([("a.py", "def run(rows):\n    return sorted(rows)\n")], "file_path string, body string")
    cited = spark.createDataFrame([(1, "a.py", 1, 2), (2, "gone.py", 1, 1)], "candidate_id long, file_path string, start_line int, end_line int")
    replies = spark.createDataFrame([(1, "FINDING: sorts | EVIDENCE: return sorted(rows)\nnoise\nFINDING: `nope` | EVIDENCE: return sorted(rows)")], "candidate_id long, reply string")
    out = review.review(cited, files, replies)
    assert sorted((r.candidate_id, r.claim_no, r.evidence_line, r.reason) for r in out.collect()) == [(1, 1, 2, None), (1, 2, 2, "CLAIM_SYMBOL_NOT_IN_CHUNK"), (2, 0, None, "CHUNK_UNREADABLE")]
