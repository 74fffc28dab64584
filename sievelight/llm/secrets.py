"""Secret scan: an Aho-Corasick pass over the ASCII-lowered text finds keywords; regular expressions
anchored at the hits read the secret; tokens that carry a checksum count only if it holds.

Kinds: assign, access and hex are the base kinds of the query contract.  Runs of hexadecimal digits
have no keyword; they are found by one pass for runs of the least length.  github and npm are added
kinds: 36 base-62 characters whose last six encode the CRC-32 of the first thirty.

Edge cases: a null text counts as empty; empty texts and texts without a hit give no span; repeated
rows are judged one by one; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import bounded_batches, pieces

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = 3

# Keywords, and the expression tried at a hit of each.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
SUMMED = {"github": re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), "npm": re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")}
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def checksum_holds(body: str) -> bool:
    """body: thirty characters and six that encode their CRC-32 in base 62."""
    value = 0
    for c in body[30:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:30].encode())


def scan(text: str, words) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, sorted."""
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    out, done = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - length + 1, kind) for end, (length, kind) in words.iter(lowered))
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            keep = m is not None and len(m[1]) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, start)
            keep = m is not None and m.end() - start >= ACCESS_LEAST
        else:
            m = SUMMED[kind].match(text, start)
            keep = m is not None and checksum_holds(m[1])
        if m is not None:
            done[kind] = m.end()
            if keep:
                out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, secret>>) per row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        words = automaton()
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        for batch in pieces(batches):
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found.append([{"kind": KINDS[k], "start": s, "end": e, "secret": text[s:e]} for s, k, e in scan(text, words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["id", "spans"])

    return bounded_batches(narrow).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,secret:string>>")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The op2 query's rows."""
    found = find_secrets(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:BASE_KINDS]))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_sha256(spans) -> str:
    return hashlib.sha256(spans_text([x for x in spans if x[1] < BASE_KINDS]).encode()).hexdigest()
