"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence, so that repeats differ, and hashed.  Each of SLOTS
sub-sketches owns the numbered k-mers that hash into it, selects the TUPLE of them with the smallest
hashes, puts these back into text order and hashes the sequence.  A slot agrees between two texts only if
they share the selected k-mers in the same order, so the share of agreeing slots follows edit
distance, not just the bag of k-mers.  A slot that owns nothing borrows from the next one.

The comparison with an edited neighbour needs the next document by id, whose order decides between all rows: texts meet by one
shuffle.  Documents are dealt by ranges of the id whose bounds are ids that exist, and the first document of a range is also
sent to the range before, so that every task finds its last document's successor; no task sees more than its ranges and no
other text is moved twice.  The bounds come from the SAMPLED ids per range with the least hashes, a sample that the ids
alone decide; as there are RANGES ranges per partition at any size, the driver holds as many bounds as the cluster has partitions, not the
table documents.  The sample only balances the ranges.

Edge cases: null and empty texts have the fingerprint of the empty text; texts shorter than a k-mer are one
k-mer; equal texts have equal fingerprints; ids may be of any type that sorts; null ids come first; rows that share an id follow one
another in text order and lie in one range; a table of one row is its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow_text import bounded_batches, mix, pieces

K, SLOTS, TUPLE = 12, 64, 2
#: Candidates kept per slot before sorting; slots left short fall back to all k-mers.
KEEP = 12
#: Ranges of ids per partition, and ids sampled per range.
RANGES, SAMPLED = 4, 16

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hash of every run of k code points (one run, if there are fewer): a polynomial put
    together from runs of doubling width, then mixed."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    width, factor, run = 1, np.array([_A]), points.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if k & width:
            out = run if out is None else out[: len(run) - done] * factor + run[done : done + len(out)]
            done += width
        if done == k:
            break
        run = run[:-width] * factor + run[width:]
        factor = factor * factor
        width *= 2
    return mix(out[: n - k + 1] + np.uint64(k))


def number_occurrences(hashes: np.ndarray) -> np.ndarray:
    """Hashes in which the second, third ... occurrence of a k-mer differ from the first."""
    ordered = np.sort(hashes)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return hashes
    bits = (1 << max(12, (4 * len(repeated)).bit_length())) - 1
    table = np.zeros(bits + 1, bool)
    table[repeated & np.uint64(bits)] = True
    maybe = np.flatnonzero(table[hashes & np.uint64(bits)])
    order = maybe[np.argsort(hashes[maybe], kind="stable")]
    h = hashes[order]
    new = np.append(True, h[1:] != h[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    number = (np.arange(len(h)) - start).astype(np.uint64)
    out = hashes.copy()
    again = number > 0
    out[order[again]] = mix(h[again] + number[again] * _B)
    return out


def fingerprint(text: str, k: int = K, slots: int = SLOTS) -> np.ndarray:
    """`slots` (a power of two) 32-bit values; a slot is the top bits of a hash, so one sort orders the
    k-mers by slot and rank."""
    if not text:
        return np.zeros(slots, np.uint32)
    h = number_occurrences(kmer_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), k))
    shift = np.uint64(64 - (slots.bit_length() - 1))
    edges = np.arange(slots, dtype=np.uint64) << shift
    at = None
    if len(h) > 2 * KEEP * slots:
        low = (np.uint64(1) << shift) - np.uint64(1)
        at = np.flatnonzero((h & low) < np.uint64(int(float(low) * (KEEP * slots / len(h)))))
    for _ in range(2):
        own = h if at is None else h[at]
        order = np.argsort(own)
        first = np.searchsorted(own[order], edges)
        count = np.diff(first, append=len(own))
        if at is None or count.min() >= TUPLE:
            break
        at = None
    a = order[np.minimum(first, len(own) - 1)]
    b = order[np.minimum(first + 1, len(own) - 1)]
    # TUPLE is two: the selected k-mers in text order are the lower and the higher position
    pair = mix(mix(own[np.minimum(a, b)]) * _A + own[np.maximum(a, b)])
    if count.min() >= TUPLE:
        value = pair
    else:
        value = np.where(count >= TUPLE, pair, mix(own[a] + _B))
        full = np.flatnonzero(count > 0)
        near = full[np.searchsorted(full, np.arange(slots)) % len(full)]
        away = ((near - np.arange(slots)) % slots).astype(np.uint64)
        value = np.where(count > 0, value, mix(value[near] + away * _B))
    return np.maximum((value >> np.uint64(32)).astype(np.uint32), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def spell(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) per row, without a shuffle."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([spell(fingerprint(t)) for t in texts])], ["id", "n_chars", "fingerprint"])

    return bounded_batches(narrow).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string")


def range_bounds(ids: DataFrame, ranges: int) -> list:
    """At most ranges - 1 ascending values of the column id, about as many rows between each two; nulls are not counted."""
    some = ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(ranges * SAMPLED)
    found = sorted(r["id"] for r in some.collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def with_successor(docs: DataFrame) -> DataFrame:
    """(range, tail, id, text) sorted within partitions: each row's successor by id is the next row of
    its range; tail rows are only there to be the last one's successor.  docs: doc_id of any type that sorts, text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").alias("id"), "text")
    kind = narrow.schema["id"].dataType.simpleString()
    ends = narrow.agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("none")).first()
    bounds = [b for b in range_bounds(narrow.select("id"), RANGES * parts) if b != ends["least"] or ends["none"]]
    # the first row of all is the last one's successor
    first, last, led = None if ends["none"] else ends["least"], len(bounds), set(bounds)

    def deal(batches):
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            own = [0 if x is None else bisect.bisect_right(bounds, x) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([0] * len(ids), pa.int32()), *batch.columns], ["range", "tail", "id", "text"])
            lead = [(i, last if x == first else own[i] - 1) for i, x in enumerate(ids) if x == first or x in led]
            if lead:
                at, before = zip(*lead)
                copies = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array([1] * len(at), pa.int32()), *copies.columns], ["range", "tail", "id", "text"])

    dealt = bounded_batches(narrow).mapInArrow(deal, f"range int, tail int, id {kind}, text string")
    return dealt.repartition(max(parts, 1), "range").sortWithinPartitions("range", "tail", F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())


def order_minhash_digest(docs: DataFrame) -> DataFrame:
    """The op10 query's rows."""
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches):
        def rows():
            for batch in pieces(batches):
                yield from zip(*(c.to_pylist() for c in batch.columns))

        before, out = None, []

        def finish(prior, text, own):
            _, id_, old, print_ = prior
            q = len(old) // 4
            edited = old[: len(old) - q] + text[:q]
            changed = print_ if edited == old else fingerprint(edited)
            out.append((id_, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spell(print_), spell(changed), likeness(print_, changed), likeness(print_, own)))

        def emit():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], [x.split()[0] for x in schema.split(", ")])
            out.clear()
            return done

        for range_, tail, id_, text in rows():
            text = text or ""
            own = before[3] if before is not None and before[2] == text else fingerprint(text)
            if before is not None and before[0] == range_:
                finish(before, text, own)
            # the first tail row ends its range; later ones (rows of the same id) add nothing
            before = None if tail else (range_, id_, text, own)
            if len(out) >= 512:
                yield emit()
        if out:
            yield emit()

    return bounded_batches(with_successor(docs)).mapInArrow(compare, schema)
