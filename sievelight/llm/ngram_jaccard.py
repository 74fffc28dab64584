"""N-gram Jaccard join over a count-vector R-tree.

A document's set of word shingles is hashed into groups; the vector of its group counts is a point.
For two sets the overlap is at most the sum of coordinate minima, so the L1 distance of their points
is at most the size of their symmetric difference, which the similarity bounds: points further
apart cannot link.

Top of the tree (distributed).  Points of one size class are cut into m blocks of coordinates, with
m - spare above the greatest difference that linked sets of the class can have.  Each difference
touches one block, so linked points agree in all coordinates of more than `spare` blocks; the
coordinates of one block name a tile, and every link lies in some tile.  An empty block tells nothing, as unrelated points
share it.  Linked points that agree in empty blocks only have more than `spare` of them in common, the first of these
being among the first e - spare of a point's e empty blocks: no other empty block needs a tile.  A class has so many spare blocks
that few points need any.  Nothing is dropped, whatever a tile's size.

Links (per tile).  Equal sets are one point from the start, and tiles with the same members are one tile.  Every
member of a tile is verified against the tile's least member, which joins families along stars instead of all pairs
and settles tiles of two.  While the tiles that still hold several components have very many pairs, rounds of further hubs
follow.  Then the points of such a tile (split into chunk pairs when there are many) are bulk-loaded into an R-tree by
sort-tile-recursion; the descent keeps node pairs whose summed coordinate minima still allow a link, and only
leaf pairs of different components are verified on the whole sets (48-bit shingle hashes).  Verified links are joined by
distributed contraction.

Edge cases: null and empty texts, and texts without a word, have no shingle, link with nothing and are their
own component; a text of fewer words than a shingle is one shingle; repeated rows (same id or not)
with equal texts share a component; a null id counts as no id when the smallest is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import NOT_SPACE, bounded_batches, chunks, mix, pieces, sequence_hash, to_driver, utf8, words
from .families import bucket_members, families, meet
from .scratch import Scratch

#: Size classes grow by this factor; least number of blocks beyond the pigeonhole's need; groups within a block.
CLASS_RATIO, SPARE, BLOCK_GROUPS = 1.25, 2, 1 << 20
#: Coordinates of the points in the trees of tiles, entries per node, points per chunk.
TREE_GROUPS, NODE, CHUNK = 256, 16, 1024
#: Bytes of a shingle hash in a stored set.  Two sets of 600 shingles share a false one in 800 million pairs, of 20,000 in 700,000; it
#: matters only to a pair that is one shingle short of a link.  None is lost: see overlap().
SET_BYTES = 6
#: Sets whose tiles a task remembers.
SEEN = 100_000
#: Bits of the filter that spares documents outside all tiles the second reading: 1 MiB.
MEMBER_BITS = 23


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per document."""
    out = []
    for i, j in chunks(offsets):
        hashes, _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
        grams = sequence_hash(hashes, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif n:
                out.append(sequence_hash(hashes[a:b], n)[:1])
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def packed(s: np.ndarray) -> bytes:
    """The top SET_BYTES bytes of every hash of a sorted set, which keep its order."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = data.reshape(-1, SET_BYTES)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common hashes of two sorted lists, as multisets: hashes that packing made equal count as often as both hold them, so that no
    common shingle is lost."""
    at = np.searchsorted(y, x)
    # the place of a hash among its equals in x
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    there = at + nth
    return int((y[np.minimum(there, len(y) - 1)] == x)[there < len(y)].sum())


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))]))[0].astype(np.int64))


class Classes:
    """Size classes and what linked sets of a class can differ by; similarity = num/den."""

    def __init__(self, num: int, den: int, ratio: float = CLASS_RATIO):
        self.num, self.den, self.spares = num, den, {}
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * ratio)))

    def difference(self, a: int, b: int) -> int:
        """Bound on the symmetric difference of linked sets with sizes a and b, growing with both: the
        overlap is num/(num+den) (a+b) or more."""
        return (self.den - self.num) * (a + b) // (self.num + self.den)

    def spare(self, c: int, d: int) -> int:
        """Blocks of a class beyond d + 1: the empty blocks of its smallest sets, by mean and two deviations.  SPARE where that takes
        more than d."""
        if c not in self.spares:
            smallest = -(-self.num * self.lows[c] // self.den)
            some = np.arange(SPARE, max(d, SPARE) + 1)
            empty = (d + 1 + some) * np.exp(-smallest / (d + 1 + some))
            enough = some[empty + 2 * np.sqrt(empty) <= some]
            self.spares[c] = int(enough[0]) if len(enough) else SPARE
        return self.spares[c]

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, blocks, spare ones) of the classes that a set of n shingles takes part in: its own, and those of
        larger sets that it can link with."""
        own = int(np.searchsorted(self.lows, n, "right")) - 1
        out = []
        for c in range(own, len(self.lows) - 1):
            low, high = self.lows[c], self.lows[c + 1] - 1
            if c > own and self.num * low > self.den * n:
                break
            d = self.difference(high, high)
            if d > 0:
                spare = self.spare(c, d)
                out.append((c, d + 1 + spare, spare))
        return out


def tiles(s: np.ndarray, classes: Classes) -> np.ndarray:
    """Names of the tiles of one set: class, block and the block's group counts."""
    names = []
    with np.errstate(over="ignore"):
        spread = mix(s ^ np.uint64(0x2545F4914F6CDD1D))
        group = (spread >> np.uint64(8)) & np.uint64(BLOCK_GROUPS - 1)
        # a block's counts are the multiset of its members' groups, and a sum of mixed group names
        # names a multiset
        member = mix(group + np.uint64(0xD6E8FEB86659FD93))
        for c, m, spare in classes.of(len(s)):
            block = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, block, member)
            size = np.bincount(block, minlength=m)
            empty = np.flatnonzero(size == 0)
            where = np.concatenate([np.flatnonzero(size), empty[: max(0, len(empty) - spare)]])
            names.append(mix(mix(total[where] + np.uint64(c) * np.uint64(0x9E3779B97F4A7C15)) + where.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(m)))
    return np.concatenate(names).astype(np.int64) if names else np.zeros(0, np.int64)


def point(s: np.ndarray) -> np.ndarray:
    """Group counts of a set, for the trees, as uint16.  A set with a larger count is the greatest point
    instead: its bound rules nothing out."""
    counts = np.bincount((s & np.uint64(TREE_GROUPS - 1)).astype(np.int64), minlength=TREE_GROUPS)
    return np.minimum(counts, 65535).astype("<u2") if counts.max() <= 65535 else np.full(TREE_GROUPS, 65535, "<u2")


class RTree:
    """Sort-tile-recursive R-tree over count vectors."""

    def __init__(self, points: np.ndarray, node: int = NODE):
        order = self._tile(points, np.arange(len(points)), node)
        self.order, self.levels = order, []
        low = high = points[order]
        while True:
            starts = np.arange(0, len(low), node)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))
            if len(low) == 1:
                break

    @staticmethod
    def _tile(points, index, node):
        if len(index) <= node:
            return index
        axes = [points[index].sum(1), *points[index].T[:3]]
        slabs = max(1, round((len(index) / node) ** 0.5))
        index = index[np.argsort(axes[0], kind="stable")]
        parts = np.array_split(index, slabs)
        return np.concatenate([p[np.argsort(points[p, 0] * 1.0 + points[p, 1] - points[p, 2], kind="stable")] for p in parts])


def link_pairs(points: np.ndarray, num: int, den: int, label: np.ndarray, split: int | None = None) -> np.ndarray:
    """Pairs of rows (of different labels) whose summed coordinate minima allow a link.

    split: with it, only pairs of a row below split and one from split on."""
    n = len(points)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    tree = RTree(points)
    order, sizes = tree.order, points.sum(1)

    def possible(high_a, high_b, low_size_a, low_size_b):
        return (num + den) * np.minimum(high_a, high_b).sum(-1) >= num * (low_size_a + low_size_b)

    top = len(tree.levels) - 1
    pairs = np.array([[0, 0]])
    for level in range(top, -1, -1):
        low, high = tree.levels[level]
        least = low.sum(1)
        # smallest set below a node, for the needed overlap
        keep = np.concatenate([possible(high[p[:, 0]], high[p[:, 1]], least[p[:, 0]], least[p[:, 1]]) for p in np.array_split(pairs, max(1, len(pairs) // 4096))])
        pairs = pairs[keep]
        if not len(pairs):
            return np.zeros((0, 2), np.int64)
        count = len(tree.levels[level - 1][0]) if level else n
        left = pairs[:, :1] * NODE + np.arange(NODE)
        right = pairs[:, 1:] * NODE + np.arange(NODE)
        grown = np.stack(np.broadcast_arrays(left[:, :, None], right[:, None, :]), -1).reshape(-1, 2)
        pairs = grown[(grown < count).all(1) & (grown[:, 0] <= grown[:, 1])]
    pairs = order[pairs[pairs[:, 0] < pairs[:, 1]]]
    pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    if split is not None:
        pairs = pairs[(pairs[:, 0] < split) != (pairs[:, 1] < split)]
    out = []
    for p in np.array_split(pairs, max(1, len(pairs) // 4096)):
        out.append(p[possible(points[p[:, 0]], points[p[:, 1]], sizes[p[:, 0]], sizes[p[:, 1]])])
    return np.concatenate(out)


def _batch(columns: list, lists: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names)


def describe(docs: DataFrame, width: int, classes: Classes) -> DataFrame:
    """(id, h, n, key, tiles) per row of (id, h, text).  A task lists the tiles of a set once in so many sets, so copies
    hardly multiply them."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        nothing = np.zeros(0, np.int64)
        for batch in pieces(batches):
            sets = shingle_sets(*utf8(batch.column(2)), width)
            keys = [set_key(s) if len(s) else None for s in sets]
            names = []
            for s, key in zip(sets, keys):
                names.append(nothing if key is None or key in seen else tiles(s, classes))
                seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            yield _batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64())], names, ["id", "h", "n", "key", "tiles"])

    return bounded_batches(docs.select("id", "h", "text")).mapInArrow(run, f"id {kind}, h long, n long, key long, tiles array<long>")


def _member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(key, shingles, point) of documents (h, text) whose h may be in members; a bit filter of fixed size
    spares most others the shingling."""
    spot = F.pmod(F.xxhash64("h"), F.lit(1 << MEMBER_BITS))
    marks = members.select(spot.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("m"))
    table = np.zeros(1 << (MEMBER_BITS - 6), np.int64)
    for r in to_driver(marks):
        table[r["w"]] = r["m"]
    bits = np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)

    def run(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            keep = np.flatnonzero(bits[batch.column(0).to_numpy(zero_copy_only=False)])
            if not len(keep):
                continue
            new = {}
            for s in shingle_sets(*utf8(batch.column(1).take(pa.array(keep))), width):
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    new[key] = s
            if len(seen) > SEEN:
                seen.clear()
            if new:
                columns = [pa.array(list(new), pa.int64()), pa.array([packed(s) for s in new.values()], pa.binary()), pa.array([point(s).tobytes() for s in new.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "shingles", "point"])

    return bounded_batches(docs.select(spot.alias("b"), "text")).mapInArrow(run, "key long, shingles binary, point binary")


def _sets(column: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(column)
    return [unpacked(data[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, TREE_GROUPS)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, tables: Scratch) -> DataFrame:
    """Those (u, v) whose sets link: by summed coordinate minima first, then exactly."""

    def possible(a, b):
        a, b = _points(a), _points(b)
        return (num + den) * np.minimum(a, b).sum(1, dtype=np.int64) >= num * (a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64))

    def links(a, b):
        keep = []
        for x, y in zip(_sets(a), _sets(b)):
            keep.append((num + den) * overlap(x, y) >= num * (len(x) + len(y)))
        return keep

    def passing(pairs, payload, allow):
        def run(batches):
            for batch in pieces(batches):
                yield batch.select([0, 1]).filter(pa.array(allow(batch.column(2), batch.column(3)), pa.bool_()))

        return tables.keep(bounded_batches(meet(pairs, sets, payload)).mapInArrow(run, "u long, v long"))

    near = passing(pairs, "point", possible)
    found = passing(near, "shingles", links)
    tables.release(near)
    return found


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, key, component_key) per row: rows of one component_key are linked, directly or
    through others, by den * overlap >= num * union of their sets.  Empty sets have null keys."""
    spark = docs.sparkSession
    tables = Scratch(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a table, so that the texts are described once and the tiles have one shuffle that both of its readers share
    described = tables.keep(describe(narrow, width, Classes(num, den)))
    members = bucket_members(described.where(F.size("tiles") > 0).select(F.explode("tiles").alias("tile"), "key"), "tile", tables)
    # from here on a document is its id and key: the tiles of all documents are not kept
    rows = tables.keep(described.select("id", "h", "n", "key"))
    tables.release(described)

    keys = tables.keep(members.select("key").distinct())
    texts = tables.keep(rows.where("key is not null").groupBy("key").agg(F.min("h").alias("h")).join(keys, "key"))
    sets = tables.keep_dealt(_member_sets(narrow, texts, width).join(keys, "key", "left_semi").dropDuplicates(["key"]), "key", parts)
    tables.release(texts)
    labels = families(members, lambda pairs: _verify(pairs, sets, num, den, tables), lambda pending: _tree_pairs(pending, sets, num, den), keys.count(), tables)
    tables.release(members, keys, sets)
    return rows.join(labels.select(F.col("vertex").alias("key"), "component"), "key", "left").select("id", F.col("n").alias("n_shingles"), "key", F.coalesce("component", "key").alias("component_key"))


def _tree_pairs(pending: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (u, v) of different labels that some tile's tree cannot rule out.

    A tile of at most one leaf has no inner node to descend: its pairs go to the bound as they are."""
    leaf = pending.where(F.col("size") <= NODE).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "label"))).alias("m"))
    later = lambda x, i: F.transform(F.filter(F.slice(F.col("m"), i + 2, F.lit(NODE)), lambda y: y["label"] != x["label"]), lambda y: F.struct(y["key"].alias("u"), x["key"].alias("v")))
    small = leaf.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.u", "p.v")

    rows = pending.where(F.col("size") > NODE).withColumn("parts", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # a chunk meets every chunk: pair (i, j) with i <= j
    paired = rows.select("key", "label", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    paired = paired.select("key", "label", "bucket", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def search(group: pa.Table) -> pa.Table:
        part = group["part"].to_numpy()
        order = np.argsort(part, kind="stable")
        keys, label = group["key"].to_numpy()[order], group["label"].to_numpy()[order]
        at = _points(group["point"])[order].astype(np.int32)
        one = group["i"][0].as_py() == group["j"][0].as_py()
        pairs = link_pairs(at, num, den, label, None if one else int((part == part.min()).sum()))
        u, v = keys[pairs[:, 0]], keys[pairs[:, 1]]
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    large = paired.join(sets.select("key", "point"), "key").groupBy("bucket", "i", "j").applyInArrow(search, "u long, v long")
    return small.union(large).distinct()


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """The op3 query's rows: three-word shingles, similarity 0.9."""
    tables = Scratch(docs.sparkSession)
    rows = tables.keep(jaccard_components(docs, 3, 90, 100))
    # a table, so that the join below stands alone and a large component can be split
    least = tables.keep(rows.where("component_key is not null").groupBy("component_key").agg(F.min("id").alias("component_id")))
    return rows.join(least, "component_key", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


#: DuckDB SQL of the digest.
JACCARD_SQL = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL), e AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 190 * k >= 90 * (x.n + y.n)),
way AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT way.v, r.c FROM r JOIN way ON way.u = r.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1"""
