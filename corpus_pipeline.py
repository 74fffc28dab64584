"""A training corpus from raw documents: language, lines, near copies, benchmark leaks, packing.

Every stage is written as Parquet and read again as the next one's input; all but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.decontam import contaminated
from sievelight.llm.langid import held_out, identify, train
from sievelight.llm.line_dedup import dedup_lines
from sievelight.llm.ngram_jaccard import jaccard_components
from sievelight.llm.packing import packing_digest
from sievelight.llm.scratch import Scratch


def _documents(df: DataFrame, columns) -> DataFrame:
    """df cut to the given columns, with n_chars brought up to date."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter (`und`) go, and lang becomes the prediction.

    Rows keep their order of columns; the prediction is made per row, so repeated ids do no harm."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    judged = identify(docs, model, docs.columns)
    return judged.where("lang_pred != 'und'").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays; a document that loses all its text goes."""
    cut = dedup_lines(docs)
    return _documents(cut.where("n_dropped = 0 or trim(text) != ''"), docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    Documents without a word are in no group and stay; of rows that share id and text one stays, also without a word.  The texts
    stay where they are: the few rows that go are joined to them."""
    tables = Scratch(spark)
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    groups = tables.keep(jaccard_components(keyed.select(F.struct("doc_id", F.col("__h").alias("h")).alias("doc_id"), "text"), 5, 80, 100))
    best = groups.where("component_key is not null").groupBy("component_key").agg(F.min("id").alias("best"))
    name = lambda df: df.select(F.col("id.doc_id").alias("__id"), F.col("id.h").alias("__k"))
    gone = tables.keep(name(groups.join(best, "component_key").where("id != best").select("id").distinct()))
    twice = tables.keep(name(groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__k"))
    kept = keyed.join(gone, same, "left_anti")
    once = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__h"]))
    return once.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of ten words (a shorter item: all its words).

    A text decides for all rows that hold it; null and empty texts have no passage and stay, repeated rows stay, and an
    empty benchmark keeps all."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.select(F.col("h").alias("__hit_h"), F.col("g").alias("__hit_g"))
    same = (F.xxhash64("text") == F.col("__hit_h")) & (F.xxhash64("text", F.lit(1)) == F.col("__hit_g"))
    return docs.join(hit, same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op8 gives them."""
    return packing_digest(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", packing)]

#: Classification, similarity components and the tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; a stage's table is deleted once the next one is written."""
    tables = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
        if before is not None:
            tables.release(before)
        before = docs
    return docs
