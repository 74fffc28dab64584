"""Benchmark decontamination over a distributed positional inverted index.

A benchmark item is split into windows of consecutive words.  Terms are counted over all documents; a window's lists are
then intersected from its rarest term on.

Index.  A posting says that a term stands at a position of a text; it carries the terms that stand up to `reach` places around
it.  Executors make the postings of the windows' rarest terms in one scan and write them as a table; other terms' lists
are in the postings' surroundings, where offsets are differences of places.

Intersection.  Postings are joined with the windows by the rarest term, which gives candidate starts; from the next rarest
term on, each must stand at its own offset.  A start that keeps all is an exact phrase match.  For proximity an item's
`terms` rarest terms must all stand within `within` words of the rarest, in any order.

Scale.  The benchmark stays distributed: the driver receives two bit filters of fixed size (FILTER_BITS), which spare
the scans most other terms and never decide a match.  Texts stay where they are.  A posting's text is named by 128 bits of
hashes, so copies give the same postings; a term with very many postings is split by AQE, as it is the large side of an
equi-join.  Windows with a term that no document has are out before the scan.

Words are compared by 64-bit hashes of their lower-cased bytes; a window must agree in all its
hashes, so a false match of a full window would need ten collisions in a row.

Edge cases: null and empty texts have no words and no hits; items without words are ignored; rows of
the benchmark that share an item_id count as one item with several texts; an item without an id marks words but is no named
item; an empty benchmark hits nothing; repeated documents and ids are judged row by row; ids may be of any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import ALNUM, LOWER, bounded_batches, chunks, pieces, to_driver, utf8, words
from .scratch import Scratch

WIDTH = 10
#: Proximity: how many of an item's rarest terms must stand how close to the rarest.
NEAR_TERMS, NEAR_WORDS = 5, 40
#: Bits of a filter of terms: 1 MiB.
FILTER_BITS = 23
#: Terms that a task counts before it hands its counts on.
COUNTED = 200_000


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(text_col).alias("h"), F.xxhash64(text_col, F.lit(1)).alias("g"), F.col(text_col).alias("text"))


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item, terms array<long>, words array<string>) of the benchmark's texts; texts without words are left out."""

    def run(batches):
        for batch in pieces(batches):
            data, offsets = utf8(batch.column(1))
            hashes, start, end, first = words(data, offsets, ALNUM)
            ends = pa.array(first.astype(np.int32))
            low = LOWER[data].tobytes()
            spelt = [low[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(hashes.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(spelt, pa.string()))], ["item", "terms", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return bounded_batches(rows).mapInArrow(run, "item string, terms array<long>, words array<string>").where(F.size("terms") > 0)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(w, item, terms): an item's runs of `width` words, or the whole of a shorter one; w names the terms in order."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - width + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("terms", i, F.lit(width)))).alias("terms"))
    return cut.select(F.xxhash64("terms", F.size("terms")).alias("w"), "item", "terms").distinct()


def bit_filter(terms: DataFrame) -> np.ndarray:
    """Bits of (term) rows; other terms may share them."""
    spot = terms.select(F.col("term").bitwiseAND((1 << FILTER_BITS) - 1).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("m"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in to_driver(spot):
        table[r["i"]] = r["m"]
    return table.view(np.uint8)


def _passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that a filter may hold."""
    low = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return np.flatnonzero((bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)


def count_terms(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(term, n): occurrences over all documents (text) of the terms that pass the filter."""

    def run(batches):
        total: dict[int, int] = {}

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
            total.clear()
            return out

        for batch in pieces(batches):
            data, offsets = utf8(batch.column(0))
            for i, j in chunks(offsets):
                hashes, _, _, _ = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                term, n = np.unique(hashes[_passing(bits, hashes)].astype(np.int64), return_counts=True)
                for t, c in zip(term.tolist(), n.tolist()):
                    total[t] = total.get(t, 0) + c
                if len(total) > COUNTED:
                    yield emit()
        yield emit()

    return bounded_batches(docs.select("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, bits: np.ndarray, reach: int) -> DataFrame:
    """(term, h, g, pos, around) of documents (h, g, text): around[reach + d] is the term d places on, 0 outside the text."""

    def run(batches):
        step = np.arange(-reach, reach + 1)
        for batch in pieces(batches):
            data, offsets = utf8(batch.column(2))
            h, g = (batch.column(k).to_numpy() for k in (0, 1))
            for i, j in chunks(offsets):
                hashes, _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                every = _passing(bits, hashes)
                for at in np.array_split(every, max(1, len(every) // 8192)):
                    if not len(at):
                        continue
                    doc = np.searchsorted(first, at, "right") - 1
                    place = at[:, None] + step
                    inside = (place >= first[doc][:, None]) & (place < first[doc + 1][:, None])
                    around = np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], 0).astype(np.int64)
                    ends = np.arange(len(at) + 1, dtype=np.int32) * (2 * reach + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at].astype(np.int64)), pa.array(h[i + doc]), pa.array(g[i + doc]), pa.array(at - first[doc]), pa.ListArray.from_arrays(pa.array(ends), pa.array(around.ravel()))], ["term", "h", "g", "pos", "around"])

    return bounded_batches(docs).mapInArrow(run, "term long, h long, g long, pos long, around array<long>")


def _by_rarity(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """(key, order): the terms of a key as structs (n, place, term) from the rarest on; keys with a term that no document has are
    left out.  rows: (key, terms)."""
    placed = rows.select(key, F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term")).join(counts, "term")
    return placed.groupBy(key, "length").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("order")).where("size(order) = length").drop("length")


class Benchmark:
    """A benchmark's terms, counted over documents: kept tables for the searches of one run."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, text_col: str = "text"):
        self.tables = Scratch(docs.sparkSession)
        self.docs = _named(docs, text_col)
        self.items = self.tables.keep(item_terms(benchmark))
        bits = bit_filter(self.items.select(F.explode("terms").alias("term")))
        # the filter lets other terms through: what is joined later is exact
        self.counts = self.tables.keep(count_terms(self.docs.where("text is not null"), bits))

    def _posted(self, ordered: DataFrame, reach: int) -> DataFrame:
        anchors = ordered.select(F.col("order")[0]["term"].alias("term")).distinct()
        found = postings(self.docs.where("text is not null"), bit_filter(anchors), reach)
        return self.tables.keep(found)

    def phrases(self, width: int = WIDTH) -> DataFrame:
        """(h, g, w, start, length): every occurrence of a window, once per text."""
        every = windows(self.items, width).select("w", "terms").dropDuplicates(["w"])
        ordered = self.tables.keep(_by_rarity(every, "w", self.counts))
        posted = self._posted(ordered, width - 1)
        asked = ordered.select("w", F.col("order")[0]["term"].alias("term"), F.col("order")[0]["place"].alias("first"), F.slice("order", 2, F.lit(width)).alias("others"), F.size("order").alias("length"))
        met = posted.join(asked, "term")
        agrees = F.forall("others", lambda x: F.get("around", F.lit(width - 1) + x["place"] - F.col("first")) == x["term"])
        return met.where(agrees).select("h", "g", "w", (F.col("pos") - F.col("first")).alias("start"), "length").distinct()

    def named_windows(self, width: int = WIDTH) -> DataFrame:
        return windows(self.items, width).where("item is not null").select("w", "item").distinct()

    def near(self, within: int = NEAR_WORDS, terms: int = NEAR_TERMS) -> DataFrame:
        """(h, g, item, start): places of an item's rarest term around which its `terms` rarest ones all stand."""
        placed = self.items.where("item is not null").select("item", F.explode(F.arrays_zip("terms", "words")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.words").alias("word")).distinct()
        known = placed.join(self.counts, "term", "left").select("item", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "term").alias("t"))
        # the item's own few rarest terms; words settle ties
        rare = known.groupBy("item").agg(F.slice(F.array_sort(F.collect_list("t")), 1, terms).alias("order")).where("order[0].n > 0")
        rare = self.tables.keep(rare)
        posted = self._posted(rare, within)
        met = posted.join(rare.select("item", F.col("order")[0]["term"].alias("term"), "order"), "term")
        stands = F.forall("order", lambda x: F.array_contains(F.col("around"), x["term"]))
        return met.where(stands).select("h", "g", "item", F.col("pos").alias("start")).distinct()


def _hit_texts(bench: Benchmark, width: int) -> DataFrame:
    """(h, g, hits, items) of texts with a window: merged word ranges, and item names in order."""
    found = bench.tables.keep(bench.phrases(width))
    spans = found.groupBy("h", "g", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    own = Window.partitionBy("h", "g").orderBy("start")
    # a range begins where no earlier window reaches
    opens = F.col("start") > F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = spans.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(own)).groupBy("h", "g", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ranges = runs.groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))).alias("hits"))
    named = found.select("h", "g", "w").distinct().join(bench.named_windows(width), "w").select("h", "g", "item").distinct().groupBy("h", "g").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return bench.tables.keep(ranges.join(named, ["h", "g"], "left"))


def with_word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, g, n_words) per row: words are counted at their first bytes, without being hashed."""
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(text_col, F.lit(1)).alias("g"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            data, offsets = utf8(batch.column(3))
            inside = ALNUM[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            # a text's first byte follows no byte of its own
            first = offsets[:-1][np.diff(offsets) > 0]
            begins[first] = inside[first]
            total = np.concatenate([[0], np.cumsum(begins)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(total[offsets]))], ["id", "h", "g", "n_words"])

    return bounded_batches(narrow).mapInArrow(run, f"id {kind}, h long, g long, n_words long")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, near: bool = False) -> DataFrame:
    """One row per document: id, n_words, hits array<struct<start, end>> (merged word ranges), items array<string>, and with near also
    near_items array<string>: items whose rarest terms stand close together in it."""
    bench = Benchmark(docs, benchmark, text_col)
    found = _hit_texts(bench, width)
    if near:
        close = bench.near().select("h", "g", "item").distinct().groupBy("h", "g").agg(F.array_sort(F.collect_list("item")).alias("near_items"))
        found = bench.tables.keep(found.join(close, ["h", "g"], "full"))
    out = with_word_counts(docs, id_col, text_col).join(found, ["h", "g"], "left")
    some = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    columns = ["id", "n_words", some("hits", "array<struct<start:bigint,end:bigint>>"), some("items", "array<string>")]
    return out.select(*columns, *([some("near_items", "array<string>")] if near else []))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(h, g): 64-bit hashes xxhash64(text) and xxhash64(text, 1) of the texts that hold a window of the benchmark."""
    bench = Benchmark(docs, benchmark, text_col)
    return bench.tables.keep(bench.phrases(width).select("h", "g").distinct())


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = NEAR_WORDS, terms: int = NEAR_TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item, start): places where the item's `terms` rarest terms all stand within `within`
    words of its rarest, in any order."""
    found = Benchmark(docs, benchmark, text_col).near(within, terms)
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(text_col, F.lit(1)).alias("g"))
    return named.join(found, ["h", "g"]).select("id", "item", "start")


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op4 query's rows."""
    found = phrase_matches(docs, benchmark, near=True)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))


_SPLIT = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: DuckDB SQL of the digest.
DECONTAMINATION_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents), b0 AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT.format("text")} AS w FROM benchmark), b AS MATERIALIZED (SELECT * FROM b0 WHERE len(w) > 0),
wi AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS n, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM wi), steps AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM steps, sizes WHERE i + n - 1 <= len(w)),
hit AS MATERIALIZED (SELECT doc_id, i, runs.n, item FROM runs JOIN wi ON runs.s = wi.s AND runs.n = wi.n), pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit), np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
vocab AS (SELECT DISTINCT item, unnest(w) AS word FROM b), tok AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d), cnt AS (SELECT word, count(*) AS c FROM tok GROUP BY 1),
rk AS MATERIALIZED (SELECT item, word, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY item ORDER BY coalesce(c, 0), word) AS r FROM vocab LEFT JOIN cnt USING (word)), rare AS MATERIALIZED (SELECT item, word, r, count(*) OVER (PARTITION BY item) AS k FROM rk WHERE r <= {NEAR_TERMS}),
lead AS (SELECT item, k, doc_id, p FROM rare JOIN tok USING (word) WHERE r = 1), also AS (SELECT l.item, l.k, l.doc_id, l.p, count(DISTINCT t.word) AS found FROM lead l JOIN rare USING (item) JOIN tok t ON t.doc_id = l.doc_id AND t.word = rare.word AND t.p BETWEEN l.p - {NEAR_WORDS} AND l.p + {NEAR_WORDS} GROUP BY ALL),
ne AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM also WHERE found = k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near FROM d LEFT JOIN np USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ne USING (doc_id)"""
