"""Model scoring of chunks, behind one interface: score(chunks, query) adds lp_yes, lp_no, ambiguous, failed."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vocab as V


class Scorer(Protocol):
    def score(self, chunks: DataFrame, query: str) -> DataFrame: ...


@dataclass(frozen=True)
class HashScorer:
    """A deterministic stand-in for a model, for tests and offline runs: it knows nothing of relevance."""

    salt: str = "v1"

    def score(self, chunks: DataFrame, query: str) -> DataFrame:
        yes, no = S.hash_log_probabilities(F.concat_ws(":", F.lit(self.salt), F.lit(query), "content_hash"))
        return chunks.withColumns({"lp_yes": yes, "lp_no": no, "ambiguous": F.lit(False), "failed": F.lit(False)})


@dataclass(frozen=True)
class TableScorer:
    """Scores from a table of reply payloads (content_hash, payload)."""

    payloads: DataFrame

    def score(self, chunks: DataFrame, query: str) -> DataFrame:
        j = chunks.join(self.payloads.dropDuplicates(["content_hash"]), "content_hash", "left")
        yes, no, ambiguous = S.yes_no(S.log_probabilities(F.col("payload")))
        missing = F.col("payload").isNull()
        return j.withColumns({"lp_yes": yes, "lp_no": no, "ambiguous": F.when(missing, False).otherwise(ambiguous), "failed": missing}).drop("payload")


@dataclass(frozen=True)
class HttpScorer:
    """One-token completions of a model server; a failed call is marked, and never cached.

    At most `in_flight` partitions call the server at once."""

    endpoint: str
    model: str = "default"
    timeout: float = 30.0
    in_flight: int = 4

    def score(self, chunks: DataFrame, query: str) -> DataFrame:
        endpoint, model, timeout = self.endpoint, self.model, self.timeout

        def call(frames):
            from urllib.request import Request, urlopen

            for pdf in frames:
                replies = []
                for prompt in pdf["prompt"]:
                    body = json.dumps({"model": model, "prompt": prompt, "max_tokens": 1, "temperature": 0, "logprobs": 10}).encode()
                    try:
                        with urlopen(Request(endpoint, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                            replies.append(r.read().decode())
                    except OSError:
                        replies.append(None)
                yield pd.DataFrame({"chunk_idx": pdf["chunk_idx"], "payload": replies})

        asked = chunks.select("chunk_idx", prompt(query).alias("prompt")).repartition(self.in_flight)
        got = asked.mapInPandas(call, "chunk_idx bigint, payload string")
        yes, no, ambiguous = S.yes_no(S.log_probabilities(F.col("payload")))
        missing = F.col("payload").isNull()
        return chunks.join(got, "chunk_idx", "left").withColumns({"lp_yes": yes, "lp_no": no, "ambiguous": F.when(missing, False).otherwise(ambiguous), "failed": missing}).drop("payload")


def prompt(query: str, profile: str = "lfm"):
    """The yes/no question about one chunk, as a Column."""
    where = F.concat(F.coalesce("file_path", F.lit("raw text")), F.coalesce(F.concat(F.lit(" :: "), F.col("symbol")), F.lit("")))
    opening, closing = {"lfm": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), "qwen": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), "gemma": ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"), "rwkv": ("User: ", "\n\nAssistant:"), "openai": ("", "\nAnswer:")}[profile]
    return F.concat(F.lit(opening), F.lit(f"Question: {query}\nFile: "), where, F.lit("\n"), F.col("content"), F.lit("\nIs this relevant? yes or no" + closing))


def raw_scores(scored: DataFrame, exponent: float = V.LENGTH_EXPONENTS["lfm"]) -> DataFrame:
    """raw_score of scored chunks: failed and ambiguous rows get the low default."""
    return scored.withColumn("raw_score", S.length_score(F.col("lp_yes"), F.col("lp_no"), F.col("token_est"), exponent, F.col("ambiguous") | F.col("failed")))


def cache_keys(chunks: DataFrame, query: str, model: str = "lfm", prompt_version: str = "v1", intent: str | None = None, prior_version: str = "v0.3.2", exponent: float | None = None) -> DataFrame:
    lit = lambda v: F.lit(None if v is None else str(v)).cast("string")
    span = F.concat(F.col("start_byte").cast("string"), F.lit("-"), F.col("end_byte").cast("string"))
    return chunks.withColumns({"cache_key": T.cache_key(F.lit(query), F.col("content_hash"), lit(model), lit(prompt_version), span, lit(intent), lit(prior_version), lit(exponent)), "normalized_query": F.lower(T.normal_space(F.lit(query)))})
