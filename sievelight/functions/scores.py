"""Probability and log-probability functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import clean_token, log_sum_exp, strings


def clip(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    x = clip(p, eps)
    return F.ln(x / (F.lit(1.0) - x))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_prior(p: Column, delta: Column, confidence: Column | float = 1.0) -> Column:
    """A prior added in log-odds space."""
    return sigmoid(logit(p) + delta * confidence)


def platt(p: Column, a: float = V.PLATT_A, b: float = V.PLATT_B) -> Column:
    return F.round(sigmoid(F.lit(a) * logit(p) + F.lit(b)), 4)


def length_score(lp_yes: Column, lp_no: Column, tokens: Column, exponent: float, ambiguous: Column | None = None) -> Column:
    """Length-normalised probability of yes."""
    raw = F.when(lp_yes.isNotNull() & lp_no.isNull(), V.ONE_SIDED).when(lp_no.isNotNull() & lp_yes.isNull(), -V.ONE_SIDED).otherwise(lp_yes - lp_no)
    scaled = raw * F.pow(F.lit(120.0) / F.greatest(F.lit(40.0), tokens.cast("double")), F.lit(exponent))
    unknown = raw.isNull() if ambiguous is None else raw.isNull() | ambiguous
    return F.when(unknown, V.AMBIGUOUS_SCORE).otherwise(F.round(sigmoid(scaled), 4))


def hash_log_probabilities(key: Column) -> tuple[Column, Column]:
    """A deterministic stand-in for a model: log-probabilities drawn from a hash of the key."""
    u = clip(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0), 1e-6)
    return F.ln(u), F.ln(F.lit(1.0) - u)


def yes_no(entries: Column) -> tuple[Column, Column, Column]:
    """(lp_yes, lp_no, ambiguous) from top log-probabilities, array<struct<token, id, logprob>>.

    The first entry decides, unless it is neither and both sides stay below a fifth."""
    clean = F.transform(entries, lambda e: F.struct(clean_token(e["token"]).alias("t"), e["logprob"].alias("lp")))

    def side(words):
        return log_sum_exp(F.transform(F.filter(clean, lambda e: F.array_contains(strings(words), e["t"]) & e["lp"].isNotNull()), lambda e: e["lp"]))

    lp_yes, lp_no = side(V.YES), side(V.NO)
    first = F.get(clean, F.lit(0))["t"]
    decided = F.coalesce(first.isin(*V.YES, *V.NO), F.lit(False))
    strong = F.coalesce(F.exp(lp_yes) >= 0.20, F.lit(False)) | F.coalesce(F.exp(lp_no) >= 0.20, F.lit(False))
    return lp_yes, lp_no, (~decided & ~strong) | (lp_yes.isNull() & lp_no.isNull())


def yes_no_max(entries: Column) -> tuple[Column, Column]:
    """The largest log-probability of each side, over the short variant lists."""

    def side(words):
        return F.array_max(F.transform(F.filter(entries, lambda e: F.array_contains(strings(words), F.lower(F.trim(e["token"])))), lambda e: e["logprob"]))

    return side(("yes", "true", "y")), side(("no", "false", "n"))


def log_probabilities(payload: Column) -> Column:
    """Top log-probabilities of the known reply shapes, as one array."""
    shape = "array<struct<token:string,id:bigint,logprob:double>>"
    completion = F.from_json(F.get_json_object(payload, "$.completion_probabilities[0].top_logprobs"), shape)
    chat = F.from_json(F.get_json_object(payload, "$.choices[0].logprobs.content[0].top_logprobs"), shape)
    legacy = F.from_json(F.get_json_object(payload, "$.choices[0].logprobs.top_logprobs[0]"), "map<string,double>")
    listed = F.transform(F.map_entries(legacy), lambda e: F.struct(e["key"].alias("token"), F.lit(None).cast("bigint").alias("id"), e["value"].alias("logprob")))
    probs = F.from_json(F.get_json_object(payload, "$.completion_probabilities[0].probs"), "array<struct<tok_str:string,prob:double>>")
    from_probs = F.transform(probs, lambda e: F.struct(e["tok_str"].alias("token"), F.lit(None).cast("bigint").alias("id"), F.ln(F.greatest(e["prob"], F.lit(1e-12))).alias("logprob")))
    raw = F.when(F.trim(payload).startswith("["), F.from_json(payload, shape))
    return F.coalesce(raw, completion, chat, F.when(F.size(listed) > 0, listed), from_probs, F.array().cast(shape))


def ambiguity_events(rows):
    """Rows (entries, prompt) whose first token decides nothing, with token_text, token_id, logprob, prompt_suffix (the last 150
    characters) and the first five entries as top_candidates."""
    _, _, ambiguous = yes_no(F.col("entries"))
    first = F.get("entries", F.lit(0))
    top = F.transform(F.slice("entries", 1, 5), lambda e: F.struct(clean_token(e["token"]).alias("token"), e["id"].alias("id"), F.round(e["logprob"], 4).alias("logprob")))
    return rows.where(ambiguous).withColumns({"token_text": clean_token(first["token"]), "token_id": first["id"], "logprob": F.round(first["logprob"], 4), "prompt_suffix": F.expr("right(coalesce(prompt, ''), 150)"), "top_candidates": top})
