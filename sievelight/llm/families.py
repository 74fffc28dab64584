"""Components of similar items that share buckets (tiles of a tree, bands of a signature), without all pairs of a bucket.

Every member of a bucket meets the bucket's least member, its hub; verified links make components.  A bucket whose members
are then of one component is settled.  While the buckets that are not have very many pairs of different
components, rounds of further hubs follow; last, the pairs that are left are handed to a search that knows a bound.
So every pair of a bucket is either verified, ruled out by a bound, or within one component: nothing is lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Most rounds of hubs before the last search.  It begins sooner once it has at most so many pairs a key to rule out, or once
#: a round leaves more than this share of the pairs that it found.
HUB_ROUNDS, PAIRS_A_KEY, SLOW = 12, 16, 0.8
#: Hubs that a member meets in a round.
HUBS = 4
#: Partners of a hub that get one copy of its payload.
PART = 64


def shared_rows(rows: DataFrame, bucket: str) -> DataFrame:
    """Distinct (bucket, key) of the buckets that hold several keys.

    One shuffle by bucket serves two readers: the one that finds these buckets, and the one that takes their rows."""
    # the join infers this filter for one reader only, and a semi-join would go below the shuffle: either way there would be two
    dealt = rows.where(F.col(bucket).isNotNull()).repartition(bucket)
    several = dealt.groupBy(bucket).agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select(bucket)
    return dealt.join(several.hint("shuffle_hash"), bucket).select(bucket, "key").distinct()


def bucket_members(rows: DataFrame, bucket: str, tables: Scratch) -> DataFrame:
    """(bucket, hub, size, key) of buckets with several members, hub being the least, as a kept table; rows: (bucket, key), with repeats.

    Buckets with the same members count once: they are the same if their counts and 128 bits of hashes are."""
    shared = tables.keep(shared_rows(rows, bucket))
    stats = shared.groupBy(bucket).agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    # alike buckets have the same hub
    chosen = stats.groupBy("size", "x", "y").agg(F.min(bucket).alias(bucket), F.min("hub").alias("hub")).select(bucket, "hub", "size")
    members = tables.keep(shared.join(chosen, bucket).select(F.col(bucket).alias("bucket"), "hub", "size", "key"))
    tables.drop(shared)
    return members


def meet(pairs: DataFrame, items: DataFrame, payload: str | Column) -> DataFrame:
    """(u, v, a, b) of distinct pairs (u, v): payload of u and of v.

    A v with many partners is dealt in parts: its payload is copied once a part, not once a pair, and no task gets all
    of its partners.  items is dealt by key (Scratch.keep_dealt), so only pairs move to it."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = pairs.groupBy("v").agg(F.least(F.ceil(F.count(F.lit(1)) / PART), F.lit(4 * parts)).alias("parts"))
    dealt = pairs.join(counted, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    a, b = (items.select(F.col("key").alias(x), (F.col(payload) if isinstance(payload, str) else payload).alias(y)) for x, y in (("u", "a"), ("v", "b")))
    # every part that a v has, by its number of partners: no second join of all pairs
    copies = counted.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(a, "u").join(copies.join(b, "v"), ["v", "part"]).select("u", "v", "a", "b")


def _unsettled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, key, label, lead, leading, size) of buckets whose members have several labels; lead is the most frequent one,
    of `leading` members."""
    labelled = held.join(labels.withColumnRenamed("vertex", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("label"))
    counts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("lead"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return labelled.join(several.select("bucket", F.col("lead.label").alias("lead"), F.col("lead.n").alias("leading"), "size"), "bucket")


def families(members: DataFrame, verify: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], keys: int, tables: Scratch) -> DataFrame:
    """(vertex, component) of the keys that have a link.

    members: as bucket_members gives them, a kept table.  verify: distinct (u, v) -> those that link, as a kept table.
    search: unsettled buckets (bucket, key, label, lead, leading, size) -> distinct (u, v), u > v, holding every link between
    different labels of a bucket.  keys: their number."""
    # hubs have met all of their bucket, which settles buckets of two
    star = tables.keep(members.where("key != hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct())
    links = verify(star)
    labels = connected_components(links, tables)
    held = members.where("key != hub and size > 2").select("bucket", "key")
    tables.release(star)
    before = float("inf")
    for r in range(HUB_ROUNDS + 1):
        pending = tables.keep(_unsettled(held, labels))
        sizes = pending.groupBy("bucket").agg(F.max(F.col("size").cast("double") * (F.col("size") - F.col("leading"))).alias("pairs"))
        left = sizes.agg(F.sum("pairs")).first()[0]
        if not left:
            tables.drop(pending)
            break
        last = r == HUB_ROUNDS or left <= PAIRS_A_KEY * keys or left > SLOW * before
        before = left
        if last:
            pairs = search(pending)
        else:
            # HUBS members of each bucket's lead meet those of other labels, and each of these meets one for each hub's number
            number = F.array(*[F.min(F.struct(F.xxhash64("key", F.lit(r * HUBS + t)).alias("x"), "key")) for t in range(HUBS)])
            lead = pending.where("label = lead").groupBy("bucket").agg(number.alias("hubs"))
            tried = pending.where("label != lead").join(lead, "bucket").select("key", F.posexplode("hubs").alias("t", "hub")).groupBy("key", "t").agg(F.min("hub").alias("hub"))
            pairs = tried.select(F.greatest("key", "hub.key").alias("u"), F.least("key", "hub.key").alias("v")).distinct()
        pairs = tables.keep(pairs)
        found = verify(pairs)
        more = tables.keep(links.union(found))
        tables.drop(labels, links, found)
        links, labels = more, connected_components(more, tables)
        tables.release(pairs, pending)
        if last:
            break
    tables.drop(links)
    return labels
