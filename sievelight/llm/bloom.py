"""A blocked Bloom filter in SQL expressions: each key sets bits of one 64-bit word only, so a test
reads one word.  Its size is a parameter and never grows with the keys; more keys only let more
through, which the exact join behind the filter removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set per key within its word.
PROBES = 4
#: Upper bound on words (64 bits each): a filter is 512 KiB at most.
MAX_WORDS = 1 << 16


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    h = F.hash(key, F.lit(97))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63))) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def words_for(n_keys: int) -> int:
    """Words for about 16 bits a key, a power of two of at most MAX_WORDS."""
    return min(MAX_WORDS, 1 << max(3, (max(1, n_keys) * 16 // 64).bit_length()))


def build(keys: DataFrame, column: str, words: int) -> DataFrame:
    """One row with the filter as an array of `words` longs."""
    k = F.col(column)
    filled = keys.where(k.isNotNull()).select(_word(k, words).alias("i"), _mask(k).alias("w")).groupBy("i").agg(F.bit_or("w").alias("w"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("w"))
    dense = filled.union(every).groupBy("i").agg(F.bit_or("w").alias("w"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("filter"))


def may_hold(filter_: Column, key: Column, words: int) -> Column:
    """False only if the key was not put in; null keys give false."""
    word = F.get(filter_, _word(key, words))
    return F.coalesce(word.bitwiseAND(_mask(key)) == _mask(key), F.lit(False))
