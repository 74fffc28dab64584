"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1; for each bit, a binary n-gram classifier (multinomial
log-odds over hashed byte trigrams) tells the languages with +1 from those with -1.  A text's margin
on a bit is its mean log-odds; decoding sums a logistic loss per bit, weighted by the bit's accuracy
on single training documents that its classifier was not fitted on, and takes the codeword with the least loss.  The result is ambiguous when
the second-best codeword comes within AMBIGUOUS of the best.

Training reads only text and language of the rows given, at most TRAIN_PER_LANGUAGE documents for each
language (those with the smallest hash of their id).  Counting runs on the executors; the driver receives BUCKETS counts at
most per language, which is the size of the model.  One in HELD_BACK of these documents is kept out of a first fit, on which the
bits' accuracies are measured; the final fit takes all.

Score: the softmax share of the best codeword, in which at most EVIDENCE trigrams count, so a long text of mixed languages
is no more certain than a short one.

Edge cases: a null text, or one without a letter, is `und` with score 0; no labelled row at all makes
every text `und`; one language only is a codeword of its own and always wins; repeated rows are judged
one by one; null languages are not learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import bounded_batches, chunks, pieces, to_driver, utf8

TRAIN_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
#: Codewords are exhaustive up to this many languages, random of CODE_BITS bits beyond.
EXHAUSTIVE, CODE_BITS = 5, 31
#: Trigrams that count in full; longer texts are no more certain than that.
EVIDENCE = 60
AMBIGUOUS = 0.8
#: One in so many training documents measures the bits.
HELD_BACK = 5

# Bytes: letters lower-cased; digits, marks and white space are one symbol, so format is no evidence.
_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


def symbols(data: np.ndarray) -> np.ndarray:
    """Normalised bytes: ASCII and Latin-1 capitals are lower-cased."""
    out = _SYMBOL[data]
    if len(out) > 1:
        second = np.flatnonzero(out[:-1] == 0xC3) + 1
        capital = second[(out[second] >= 0x80) & (out[second] <= 0x9E) & (out[second] != 0x97)]
        out[capital] += 32
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, trigram offsets per document); texts are padded by a space."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    lengths = np.diff(offsets)
    doc_of = np.repeat(np.arange(n), lengths)
    padded[np.arange(len(data)) + 2 * doc_of + 1] = symbols(data)
    p = padded.astype(np.uint32)
    code = p[:-2] | (p[1:-1] << np.uint32(8)) | (p[2:] << np.uint32(16)) if len(p) > 2 else np.zeros(0, np.uint32)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    starts = offsets[:-1] + 2 * np.arange(n)
    keep = np.ones(len(bucket), bool)
    ends = starts + lengths + 2  # a document of L bytes has L trigrams once padded
    bad = np.concatenate([ends - 2, ends - 1])
    keep[bad[(bad >= 0) & (bad < len(bucket))]] = False
    # two neighbouring breaks are one symbol run: they carry nothing
    blank = (p[:-2] == 32) & (p[1:-1] == 32) if len(p) > 2 else np.zeros(0, bool)
    keep &= ~blank
    running = np.concatenate([[0], np.cumsum(keep)])
    edges = np.append(starts, len(padded))
    return bucket[keep], running[np.minimum(edges, len(keep))]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # [languages, bits] of +1 and -1
    weights: np.ndarray  # [BUCKETS, bits] float32 log-odds
    trust: np.ndarray  # [bits], sums to 1
    slope: np.ndarray  # [bits], margin scale


def codewords(n: int, bits: int = CODE_BITS) -> np.ndarray:
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= EXHAUSTIVE:
        # one language is +1 throughout; the columns are all ways to part the others from it
        return np.array([[1 - 2 * ((c << 1 >> i) & 1) for c in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    rng, best = np.random.default_rng(7), (-1, None)
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, max(bits, 4 * int(np.ceil(np.log2(n))))))
        if (np.abs(c.astype(int).sum(0)) == n).any():
            continue
        gap = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        if gap > best[0]:
            best = (gap, c)
    return best[1]


def fit(counts: dict[str, np.ndarray], accuracy: np.ndarray | None = None) -> Model:
    """counts: trigram counts per language; accuracy: share of held-back documents on whose side each bit was."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    share = np.stack([(counts[x] + 0.2) / (counts[x].sum() + 0.2 * BUCKETS) for x in languages])
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        plus, minus = share[codes[:, b] > 0], share[codes[:, b] < 0]
        if len(plus) and len(minus):
            weights[:, b] = np.log(plus.mean(0)) - np.log(minus.mean(0))
    own = np.stack([share[i] @ weights for i in range(len(languages))]) if len(languages) > 1 else np.ones_like(codes, float)
    slope = 1.0 / np.maximum(np.abs(own).mean(0), 1e-6)
    # a bit that is right as often as a coin weighs next to nothing
    trust = np.ones(codes.shape[1]) if accuracy is None else np.maximum(accuracy - 0.5, 0.01) ** 2
    return Model(languages, codes, weights, trust / trust.sum(), slope)


def decode(model: Model, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) from summed log-odds and trigram counts."""
    mean = sums / np.maximum(n, 1)[:, None]
    margin = 3.0 * mean * model.slope
    loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * model.codes[None], -30, 30))) @ model.trust
    certainty = np.minimum(n, EVIDENCE)[:, None] / 4.0
    likely = np.exp(-(loss - loss.min(1, keepdims=True)) * certainty)
    likely /= likely.sum(1, keepdims=True)
    order = np.sort(loss, 1)
    best = loss.argmin(1)
    close = (order[:, 0] >= AMBIGUOUS * order[:, 1]) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, likely[np.arange(len(best)), best], close


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang.  Null texts and languages are left out."""
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.where("text is not null and lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit({})
    # a hash threshold per language passes a little more than its quota; the rank below is exact
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, int(1.2 * (1 << 20) * (per_language + 50) / n)))).otherwise(share)
    from pyspark.sql import Window

    some = rows.where(F.pmod("h", F.lit(1 << 20)) < share)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", F.xxhash64("text")))).where(F.col("r") <= per_language)

    some = some.select("lang", "text", (F.pmod(F.xxhash64("h"), F.lit(HELD_BACK)) == 0).alias("back"))

    def count(batches):
        for batch in pieces(batches):
            group = np.array([f"{b:d}{x}" for x, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], object)
            data, offsets = utf8(batch.column(1))
            total: dict[str, np.ndarray] = {}
            for i, j in chunks(offsets):
                bucket, first = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                owner = np.repeat(group[i:j], np.diff(first))
                for g in set(group[i:j].tolist()):
                    total[g] = total.get(g, 0) + np.bincount(bucket[owner == g], minlength=BUCKETS)
            for g, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([g[1:]] * len(at), pa.string()), pa.array([g[0] == "1"] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "back", "bucket", "n"])

    counts: dict[bool, dict[str, np.ndarray]] = {False: {}, True: {}}
    counted = bounded_batches(some).mapInArrow(count, "lang string, back boolean, bucket int, n long").groupBy("lang", "back", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang", "back").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    for r in to_driver(packed):
        c = np.zeros(BUCKETS)
        c[np.array(r["bucket"])] = r["n"]
        counts[r["back"]][r["lang"]] = c
    every = {x: counts[False].get(x, 0) + counts[True].get(x, 0) for x in {*counts[False], *counts[True]}}
    first = fit(counts[False])
    return fit(every, measure(some.where("back"), first) if set(counts[False]) == set(every) else None)


def measure(held_back: DataFrame, model: Model) -> np.ndarray | None:
    """Share of documents (lang, text) on the right side of every bit, one vote each; None without a document."""

    def judge(batches):
        number = {x: i for i, x in enumerate(model.languages)}
        for batch in pieces(batches):
            langs = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            right, n = np.zeros(model.codes.shape[1], np.int64), 0
            for i, j in chunks(offsets):
                bucket, first = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for d in np.flatnonzero(np.diff(first)).tolist():
                    if langs[i + d] in number:
                        right += np.sign(model.weights[bucket[first[d] : first[d + 1]]].sum(0)) == model.codes[number[langs[i + d]]]
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right), dtype=np.int32)), pa.array(right), pa.array(np.full(len(right), n))], ["bit", "right", "n"])

    rows = bounded_batches(held_back.select("lang", "text")).mapInArrow(judge, "bit int, right long, n long").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()
    if not rows or not rows[0]["n"]:
        return None
    return np.array([r["right"] / r["n"] for r in sorted(rows, key=lambda r: r["bit"])])


def identify(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols plus lang_pred, score, ambiguous; only the text decides."""
    narrow = docs.select(*id_cols, F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in id_cols)
    k = len(id_cols)

    def run(batches):
        names = np.array([*model.languages, "und"], object)
        for batch in pieces(batches):
            data, offsets = utf8(batch.column(k))
            n = batch.num_rows
            sums, size = np.zeros((n, model.weights.shape[1])), np.zeros(n, np.int64)
            for i, j in chunks(offsets, 1 << 18):
                bucket, first = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size[i:j] = np.diff(first)
                full = np.flatnonzero(size[i:j])
                if len(full):
                    sums[i + full] = np.add.reduceat(model.weights[bucket], first[:-1][full], axis=0)
            letter = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                best, score, close = decode(model, sums, size)
            else:
                best, score, close, letter = np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            known = letter & (size > 0)
            lang = names[np.where(known, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & close)], [*id_cols, "lang_pred", "score", "ambiguous"])

    return bounded_batches(narrow).mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def langid_digest(docs: DataFrame) -> DataFrame:
    """The op6 query's rows."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
