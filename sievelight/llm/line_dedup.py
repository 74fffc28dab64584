"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

Two lines are similar if the Jaccard similarity of their character shingles (all runs of SHINGLE characters; a shorter line
is one shingle) is 0.8 or more.

Signature: for each of BANDS * ROWS seeds, the least seeded hash of the shingles at anchors: those that begin a word,
and in words longer than a shingle those at each further character up to the one that ends with the word, so that unspaced
scripts, URLs and encoded data are covered character by character.  An edit changes both kinds of shingles in like proportion, and
anchors are a sixth of all positions.  ROWS lanes make one band key.  Candidates are the lines of a band key; what links is
decided on the sets of all shingles, each told by a hash of 64 bits, as whole lines are.  Links are joined by distributed contraction, equal lines being one vertex
from the start, and each component keeps its first line by (document id, line number).

Recall: bands of ROWS lanes find a pair whose anchored shingles have similarity s with probability 1 - (1 - s^ROWS)^BANDS: 0.985 at
0.8, 0.998 at 0.9.  Nothing else is lost (see families): pairs of a band key are verified, of one component already, or ruled out by a
bound on the symmetric difference of their shingle sets (sizes; in the last search sketches too).  tests/llm measure recall against all pairs.

Scale: equal lines meet in a grouped minimum that is combined before the shuffle, so a line that a third of
all documents hold costs one row per task.  That shuffle deals the distinct lines by key into a bucketed table; signatures,
sizes and the texts to verify are made from it where it lies; sketches only of the lines that stars and hubs leave open.  Occurrences of
repeated lines are found by a Bloom filter of fixed size and an exact join.

Edge cases: null and empty texts have no lines to drop; lines shorter than min_chars (after trimming; MIN_CHARS unless
given, 1 takes every line that is not blank) always stay, as they are no passage; a document whose lines are all dropped
keeps nothing; rows that share both id and text are one document; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .families import bucket_members, families, meet
from .scratch import Scratch

SHINGLE, BANDS, ROWS = 10, 8, 4
#: Shingles that one match of shingles() yields: a match costs many times what a short substring does.
PIECE = 16
NUM, DEN = 80, 100
MIN_CHARS = 24
#: 64-bit words of a sketch: bit x of it is set if the set has a shingle whose hash ends in x.  At 2,048 bits the sketches of lines of
#: some hundred characters differ in nearly as many bits as their sets in shingles.  At 48 words the join has more columns than
#: Spark generates code for.
WORDS = 32
_SEEDS = [int(x) for x in np.random.default_rng(5).integers(-(2**31), 2**31, BANDS * ROWS)]


def anchored(line: Column) -> Column:
    """Shingles at words' starts and within long words; an array of strings with repeats."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(\S.{{0,{SHINGLE - 1}}}))(?:\S{{1,{SHINGLE}}}+(?!\S)|\S)"), F.lit(1))


def shingles(line: Column) -> Column:
    """Hashes of all shingles of a line, with repeats.  They are cut from overlapping pieces, which keeps each cut short: a piece
    starts at each PIECE-th character and holds the shingles that start before the next one."""
    pieces = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE},{SHINGLE + PIECE - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    cut = lambda piece: F.transform(F.sequence(F.lit(1), F.length(piece) - (SHINGLE - 1)), lambda i: F.xxhash64(F.substring(piece, i, F.lit(SHINGLE))))
    return F.when(F.length(line) > SHINGLE, F.flatten(F.transform(pieces, cut))).otherwise(F.array(F.xxhash64(line)))


def exploded_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h, no, line, key): lines of min_chars or more; docs has id and text; h tells texts of one id apart."""
    rows = docs.select("id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    rows = rows.select("id", "h", "no", F.trim("line").alias("line")).where(F.length("line") >= max(1, min_chars))
    return rows.withColumn("key", F.xxhash64("line", F.length("line")))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(key, line, first, n) of every distinct line: its first occurrence, a struct of id, no and h, and how often it occurs.  Copies are
    combined before the shuffle, the only one that moves the texts of all lines."""
    return lines.groupBy("key").agg(F.min("line").alias("line"), F.min(F.struct("id", "no", "h")).alias("first"), F.count(F.lit(1)).alias("n"))


def _bands(distinct: DataFrame) -> DataFrame:
    """(key, band): the band keys of every distinct line.  distinct is dealt by key, so nothing moves."""
    shingled = distinct.select("key", F.explode(anchored(F.col("line"))).alias("s")).select("key", F.hash("s").alias("x"))
    lanes = shingled.groupBy("key").agg(*[F.min(F.col("x").bitwiseXOR(F.lit(seed))).alias(f"m{i}") for i, seed in enumerate(_SEEDS)])
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return lanes.select("key", F.explode(keys).alias("band"))


def _candidates(distinct: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, line, n) of the lines of keys: n is the size of a line's shingle set."""
    return distinct.select("key", "line").join(keys, "key", "left_semi").select("key", "line", F.size(F.array_distinct(shingles(F.col("line")))).cast("long").alias("n"))


def _allowed(differ: Column, sizes: Column) -> Column:
    """Whether sets that differ by so much may be similar: linked ones differ by (DEN - NUM) / (NUM + DEN) of their summed sizes at most."""
    return (NUM + DEN) * differ <= (DEN - NUM) * sizes


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (u, v) whose lines are similar: by their sizes first, then by all shingles."""
    sizes = F.col("a.n") + F.col("b.n")
    near = meet(pairs, texts, F.struct("line", "n")).where(_allowed(F.abs(F.col("a.n") - F.col("b.n")), sizes))
    common = F.size(F.array_intersect(shingles(F.col("a.line")), shingles(F.col("b.line")))).cast("long")
    return near.where((NUM + DEN) * common >= NUM * sizes).select("u", "v")


def _sketches(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, w0, w1, ...) of the lines of keys: the sizes of their shingle sets, and sketches of these."""
    spot = texts.join(keys, "key", "left_semi").select("key", "n", F.explode(shingles(F.col("line"))).alias("s")).select("key", "n", F.col("s").bitwiseAND(64 * WORDS - 1).cast("int").alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x") % 64)
    words = [F.coalesce(F.bit_or(F.when(F.shiftright("x", 6) == i, bit)), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)]
    return spot.groupBy("key").agg(F.first("n").alias("n"), *words)


def _possible(rows: DataFrame) -> DataFrame:
    """Distinct (u, v) of a line outside its band's most frequent label and one of another label, whose sizes and sketches differ by no
    more than those of similar lines.  rows: lines of unsettled bands with their sketches, a kept table, as both sides read it."""
    a, b = rows.where("label != lead").alias("a"), rows.alias("b")
    bits = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("a.w0").bitwiseXOR(F.col("b.w0"))))
    differ = F.greatest(bits.cast("long"), F.abs(F.col("a.n") - F.col("b.n")))
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") != F.col("b.label")) & _allowed(differ, F.col("a.n") + F.col("b.n")))
    return met.select(F.greatest("a.key", "b.key").alias("u"), F.least("a.key", "b.key").alias("v")).distinct()


def line_components(distinct: DataFrame, tables: Scratch) -> DataFrame:
    """(vertex, component): keys of distinct lines (dealt by key) that are similar to another one, directly or through others."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = bucket_members(_bands(distinct), "band", tables)
    tables.release()
    keys = tables.keep(members.select("key").distinct())
    texts = tables.keep_dealt(_candidates(distinct, keys), "key", parts)
    sketched = []

    def search(pending: DataFrame) -> DataFrame:
        sketched.append(tables.keep(pending.join(_sketches(texts, pending.select("key").distinct()), "key")))
        return _possible(sketched[-1])

    labels = families(members, lambda pairs: tables.keep(_verified(pairs, texts)), search, keys.count(), tables)
    tables.release(members, keys, texts, *sketched)
    return labels


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h, drop array<int>): line numbers, from 0, of the lines that documents (id, text) lose."""
    tables = Scratch(docs.sparkSession)
    lines = exploded_lines(docs, min_chars)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = tables.keep_dealt(distinct_lines(lines), "key", parts, moved=True)
    tables.release()
    component = line_components(distinct, tables)
    joined = distinct.select("key", "first", "n").join(component.withColumnRenamed("vertex", "key"), "key", "left").where("n > 1 or component is not null")
    groups = tables.keep(joined.select("key", "first", F.coalesce("component", "key").alias("component")))
    keeper = groups.groupBy("component").agg(F.min("first").alias("kept"))
    # kept as a table, so that the join below stands alone and its hot lines can be split
    repeated = tables.keep(groups.select("key", "component").join(keeper, "component").select("key", "kept"))
    tables.release(distinct, component, groups)
    words = bloom.words_for(repeated.count())
    filter_ = F.lit(np.array(bloom.build(repeated, "key", words).first()["filter"], np.int64))
    met = lines.select("id", "h", "no", "key").where(bloom.may_hold(filter_, F.col("key"), words)).join(repeated, "key")
    lost = met.where(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("no") == F.col("kept.no")) & (F.col("h") == F.col("kept.h"))))
    return lost.groupBy("id", "h").agg(F.array_sort(F.collect_set("no")).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text cut to its kept lines, plus n_lines and n_dropped (bigint).

    A text without dropped lines is returned unchanged."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drops = dropped_lines(base, min_chars).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("drop").alias("__drop"))
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left")
    parts = F.split(F.col(text_col), "\n")
    # array positions of kept lines, without a search per line: dropped ones become null
    gone = F.map_from_arrays(F.col("__drop"), F.col("__drop"))
    kept = F.filter(F.transform(parts, lambda line, i: F.when(~F.map_contains_key(gone, i), line)), lambda line: line.isNotNull())
    some = F.size("__drop") > 0
    return joined.withColumns(
        {
            text_col: F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text_col)),
            "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"),
            "n_dropped": F.when(some, F.size("__drop")).otherwise(0).cast("long"),
        }
    ).drop("__id", "__h", "__drop")


def line_digest(docs: DataFrame) -> DataFrame:
    """The op9 query's rows: per document its lines, and which of them are dropped."""
    base = docs.select(F.col("doc_id").alias("id"), "text")
    drops = dropped_lines(base).withColumnRenamed("id", "d_id").withColumnRenamed("h", "d_h")
    own = base.select("id", F.xxhash64("text").alias("h"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    joined = own.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h")), "left")
    return joined.select(F.col("id").alias("doc_id"), "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("drop", ","), F.lit("")).alias("dropped"))
