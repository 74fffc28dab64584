"""Text, query and score functions against fixed expectations."""

import math

import pytest
from pyspark.sql import functions as F

from sievelight.functions import query as Q
from sievelight.functions import scores as S
from sievelight.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_search_terms():
    assert Q.search_terms("interop harness migration fixture") == ["interop", "harness", "migration", "migrat", "migrate", "fixture"]
    assert Q.search_terms("classes") == ["classes", "class"]
    assert Q.search_terms("chunking") == ["chunking", "chunk"]
    assert Q.search_terms("the and of") == ["the"]
    assert Q.search_terms("") == []


def test_decompose():
    d = Q.decompose("diagnose crash exception and syntax error in chat template formatting")
    assert d.domain == ("chat", "template", "formatting")
    assert d.phrases == ("chat template", "template formatting")
    assert d.symptoms == ("diagnose", "crash", "exception", "syntax", "error")


@pytest.mark.parametrize(
    "text, want",
    [("fix bug and crash error in handler", ("BUG_DIAGNOSIS", 1.0)), ("verify token", ("SPECIFICATION", 0.5)), ("xyz abc 123", ("IMPLEMENTATION", 0.0)), ("refactor and extract module helpers", ("REFACTOR", 1.0))],
)
def test_intent_twins(spark, text, want):
    assert Q.intent(text) == want
    df = spark.createDataFrame([(text,)], "v string")
    a, b = T.intent_of(F.col("v"))
    assert tuple(df.select(a, b).first()) == want


def test_terms_twins(spark):
    texts = ["Templates boxes policies is bus gas classes", "HTTPServer2 ies x", "", None]
    assert column(spark, texts, T.lexical_terms) == [Q.lexical_terms(t) for t in texts]


def test_test_paths(spark):
    yes = ["tests/unit-1.test.ts", "src/__tests__/thing.ts", "tests/test_client.py", "pkg/client_test.go"]
    no = ["src/interop/migrate-fixture.ts", "src/fixtures/rows.ts", "src/latest.ts"]
    assert column(spark, yes + no, T.is_test_path) == [True] * 4 + [False] * 3


def test_slices(spark):
    got = column(spark, ["features/billing/charge.ts", "modules/auth/tokens.py", "packages/qc-harness/index.mjs", "src/payment/service.ts", "a/b.ts", "x.ts", None], T.slice_of)
    assert got == ["billing", "auth", "qc-harness", "payment", "a", "root", "root"]


def test_token_keys(spark):
    keys = column(spark, ["createShare openIndexedDB", "<ToolBar />", "src/features/photos/shared/queries"], T.token_keys)
    assert set(Q.term_keys("share")) & set(keys[0]) and set(Q.term_keys("indexeddb")) & set(keys[0])
    assert set(Q.term_keys("toolbar")) & set(keys[1])
    assert not set(Q.term_keys("share")) & set(keys[2])


def test_symbol_roles(spark):
    df = spark.createDataFrame([("llm_chat_apply_template", "body", "llama-chat.cpp", 80), ("parse_token", "static uint32_t parse_token(x)", "g.cpp", 25), ("", "", "a", 1)], "s string, c string, p string, n int")
    assert [r[0] for r in df.select(T.symbol_role(F.col("s"), F.col("c"), F.col("p"), F.col("n"))).collect()] == ["PUBLIC_API", "INTERNAL_HELPER", "UNKNOWN"]


def test_priors(spark):
    df = spark.createDataFrame([(0.70, -0.606, 1.0), (0.60, 0.693, 1.0), (0.80, 0.50, 0.0)], "p double, d double, c double")
    got = [r[0] for r in df.select(S.with_prior(F.col("p"), F.col("d"), F.col("c"))).collect()]
    assert got == [pytest.approx(x, abs=0.01) for x in (0.56, 0.75, 0.80)]


def test_yes_no(spark):
    df = spark.createDataFrame([(0, [("Yes", 1, -0.338), (" no", 2, -1.495)]), (1, [("The", 3, -0.1)]), (2, [])], "i int, e array<struct<token:string,id:bigint,logprob:double>>")
    yes, no, ambiguous = S.yes_no(F.col("e"))
    rows = df.select(yes.alias("y"), no.alias("n"), ambiguous.alias("a")).orderBy("i").collect()
    assert rows[0].y == pytest.approx(-0.338) and not rows[0].a
    assert rows[1].a and rows[2].a
    scored = df.select(S.length_score(yes, no, F.lit(120), 0.15, ambiguous)).orderBy("i").collect()
    assert scored[0][0] == pytest.approx(0.7608) and scored[1][0] == 0.05


def test_payload_shapes(spark):
    shapes = [
        '{"completion_probabilities":[{"top_logprobs":[{"token":"yes","id":1,"logprob":-0.1},{"token":"no","id":2,"logprob":-2.0}]}]}',
        '{"choices":[{"logprobs":{"content":[{"top_logprobs":[{"token":"yes","logprob":-0.1},{"token":"no","logprob":-2.0}]}]}}]}',
        '{"choices":[{"logprobs":{"top_logprobs":[{"yes":-0.1,"no":-2.0}]}}]}',
        '[{"token":"yes","logprob":-0.1},{"token":"no","logprob":-2.0}]',
    ]
    got = column(spark, shapes, lambda c: F.size(S.log_probabilities(c)))
    assert got == [2, 2, 2, 2]


def test_saturation(spark):
    got = column(spark, [0, 1, 2, 5, 20], lambda c: F.round(T.saturate(c), 4), "int")
    assert got == [0.0, 0.4545, 0.625, 0.8065, 0.9434]
    assert math.isclose(got[1], 1 / 2.2, abs_tol=1e-4)


def test_code_questions(spark):
    yes = ["where is app.tenant_id set", "which function handles the upload", "how does the cache resolve routes", "fix the crash error in the exporter", "see src/main.rs please"]
    no = ["commit the work now please", "thanks!", "what is the status of the branch", "how should we write this", "<xml> parse_token", "does node.js run on macOS today"]
    assert column(spark, yes + no, T.is_code_question) == [True] * 5 + [False] * 6


def test_rerank_gate(spark):
    yes = ["where is the handler defined", "find the config loader"]
    no = ["ok", "commit this now", "lovely weather out there"]
    assert column(spark, yes + no, T.wants_rerank) == [True] * 2 + [False] * 3


def test_prompt_word_borders_are_ascii(spark):
    yes = ["éfind x yz", "findé it now", "fix the\u0085 bug"]
    no = ["commité find this", "find_it in code", "where\nis it"]
    assert column(spark, yes + no, T.wants_rerank) == [True] * 3 + [False] * 3


def test_terms_among_cuts_out_only_words_that_begin_like_a_key(spark):
    keys = ["query", "class", "box", "id"]
    texts = ["Queries, QUERY querying; boxes Box xbox classes class_ids ids idx id9", "", None, "nothing here", "éid id"]
    want = column(spark, texts, lambda c: F.array_join(F.filter(T.lexical_terms(c), lambda t: t.isin(*keys)), " "))
    assert column(spark, texts, lambda c: F.array_join(T.terms_among(c, keys), " ")) == want
    assert want[0] == "query query box box class class" and want[4] == "id id"


def test_may_hold_phrase_passes_every_text_that_holds_one(spark):
    texts = ["open Queries, classes", "queries  class", "subquery classify", "query\n3: class", "query the class", "class query", None]
    holds = column(spark, texts, lambda c: F.contains(F.array_join(T.lexical_terms(c), " "), F.lit("query class")))
    may = column(spark, texts, lambda c: T.may_hold_phrase(c, ["query class"]))
    assert [h for h, m in zip(holds, may) if not m] == [False] * may.count(False) and may[-3:] == [False] * 3 and holds[:3] == [True] * 3
