"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised word by word (the tokenizer never joins tokens across white space, so a word
seen before costs one dictionary lookup).  Full windows are cut off a document as sequences of
their own.  Its rest, cut into parts of at most a quarter window, goes to a group of consecutive
documents of the same task, whose parts are dealt to windows by differencing: every part starts as
a partial partition with one loaded window; the two partial partitions of the largest spread are
merged, the fullest windows of one on the emptiest of the other, until one is left.  The
window count starts at the least that can hold the group and rises whenever a window exceeds the
capacity.

There is no shuffle: group and window numbers carry the task's partition number, so a task that
runs again gives the same rows.  Memory is bounded by one group of parts.

Edge cases: a null or empty text is the end token alone; a very long text fills many windows; repeated
rows are packed one by one; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import bounded_batches, pieces

CAPACITY, END_ID = 2048, 1
#: Rests are cut into parts of at most capacity / PARTS tokens.
PARTS = 4
#: Documents whose rests are packed together.
GROUP = 512
#: Words kept in a task's cache, and the longest that is kept.
CACHE_WORDS, CACHE_CHARS = 600_000, 64

# White space of str.split() that the tokenizer takes for ordinary characters.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(i) if i in plain else chr(next(rest)) for i in range(256)]


class WordEncoder:
    """Token ids of texts, as little-endian uint32 bytes.

    Only pieces that the tokenizer's own rule cuts out of a text reach its model, so a piece seen
    before costs one dictionary lookup.  Latin-1 texts are lower-cased and cut here; other texts go
    word by word, as white space always parts tokens, and their words beyond Latin-1 through the
    whole tokenizer."""

    _L, _N = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
    _PIECE = re.compile(f"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_L}{_N}\\x09-\\x0d\\x20\\x85\\xa0]+")
    _LATIN = re.compile("[\\x00-\\xff]*")
    _LETTERS = {i: c for i, c in enumerate(_byte_letters())}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, cache: dict, key: str, ids: bytes) -> bytes:
        if len(key) <= CACHE_CHARS:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[key] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self._LETTERS)
        known = self.bytes
        return self._keep(self.pieces, piece, b"".join([known[t.id] for t in self.model.tokenize(spelt)]))

    def _latin(self, text: str) -> bytes:
        get, piece = self.pieces.get, self._piece
        return b"".join([get(p) or piece(p) for p in self._PIECE.findall(text.lower())])

    def __call__(self, text: str) -> bytes:
        if "<|" in text:  # special tokens are found in the text as it stands
            return self._ids(text)
        if self._LATIN.fullmatch(text):
            return self._latin(text)
        if _ODD_SPACE.search(text):
            return self._ids(text)
        get, out = self.words.get, []
        for w in text.split():
            out.append(get(w) or self._keep(self.words, w, self._latin(w) if self._LATIN.fullmatch(w) else self._ids(w)))
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One per worker process, so that later tasks find its words."""
    return WordEncoder(path)


def differencing(lengths: list[int], windows: int) -> list[int]:
    """The window of each part, by Karmarkar-Karp over `windows` windows."""
    if windows == 1:
        return [0] * len(lengths)
    heap = []
    for i, n in enumerate(lengths):
        # (-spread, tie, loads of the loaded windows in descending order, their parts)
        heap.append((-n, i, np.array([n], np.int64), [[i]]))
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        if len(a) < len(b):
            a, b, pa_, pb = b, a, pb, pa_
        # windows that neither has loaded stay empty; b's fullest meet a's emptiest
        free = windows - len(a)
        extra = min(free, len(b))
        loads = np.concatenate([a, np.zeros(extra, np.int64)])
        parts = pa_ + [[] for _ in range(extra)]
        at = np.arange(len(loads) - 1, len(loads) - 1 - len(b), -1)
        loads[at] += b
        for j, p in zip(at.tolist(), pb):
            parts[j] = parts[j] + p if parts[j] else p
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        parts = [parts[j] for j in order.tolist()]
        low = int(loads[-1]) if len(loads) == windows else 0
        heapq.heappush(heap, (low - int(loads[0]), tie, loads, parts))
        tie += 1
    out = [0] * len(lengths)
    for w, p in enumerate(heap[0][3]):
        for i in p:
            out[i] = w
    return out


def deal(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], int]:
    """(window of each part, number of windows): no window over capacity."""
    if not lengths:
        return [], 0
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        out = differencing(lengths, windows)
        if np.bincount(out, lengths, windows).max() <= capacity:
            return out, windows
        windows += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    kind = narrow.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        types = None
        state = {"next": None, "docs": 0}
        rests: list[tuple] = []
        rows: list[tuple] = []

        def flush():
            where, windows = deal([r[2] for r in rests], capacity)
            filled = [0] * windows
            for (doc, start, length, ids, total), w in zip(rests, where):
                rows.append((doc, start, length, ids, total, state["next"] + w, filled[w]))
                filled[w] += length
            state["next"] += windows
            rests.clear()
            state["docs"] = 0

        def emit():
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            rows.clear()
            return out

        for batch in pieces(batches):
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            if state["next"] is None and batch.num_rows:
                state["next"] = batch.column(2)[0].as_py() << 32
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                at = 0
                while total - at >= capacity:
                    rows.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], total, state["next"], 0))
                    state["next"] += 1
                    at += capacity
                    if len(rows) >= 2048:
                        yield emit()
                while at < total:
                    length = min(max(1, capacity // PARTS), total - at)
                    rests.append((doc, at, length, ids[4 * at : 4 * (at + length)], total))
                    at += length
                state["docs"] += 1
                if state["docs"] >= group:
                    flush()
                if len(rows) >= 2048:
                    yield emit()
        if rests:
            flush()
        if rows:
            yield emit()

    return bounded_batches(narrow).mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packing_digest(docs: DataFrame) -> DataFrame:
    """The op8 query's rows: pieces with the CRC-32 of their ids."""
    return pack(docs).select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def normal_text(text: str) -> str:
    """The tokenizer's own normal form, for readers of the pieces."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).lower()
