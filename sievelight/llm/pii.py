"""Personal data by gradient-boosted candidates, in DataFrame expressions only.

Generators propose spans: the four base patterns, whose checked matches are always redacted, and
looser forms of the same kinds (spelt-out addresses, national phone numbers, IPv6, dotted card
numbers).  A loose candidate is described by format and context features and scored by boosted
trees of depth two; candidates whose calibrated probability reaches a threshold compete where they overlap, the likelier one
first, and what touches no base span, as these are always kept, is added.  The trees are fitted here, on a fixed set of labelled examples made from a
format grammar, and compiled into one SQL expression; calibration maps tree margins to the
precision seen on a held-out part of those examples.

Edge cases: a null text counts as empty; texts without candidates give zero counts, the hash of the
empty string and an empty span list; repeated rows are judged one by one; extra columns are dropped
from the result and never clash, as the input is narrowed first.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Base patterns of the contract, with possessive repeats and start guards.  The guards name the one
# place where a leftmost match can begin (the start of a run, or the end of the match before), so a
# long run without a match costs one scan instead of one per start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}

# Loose generators, by the kind they propose.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[a-z0-9-]{1,63}+){1,4}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9.])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{2,7}(?![0-9.])",
    "phone": r"(?<![0-9+().-])(?<![0-9+] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9-])(?![ .][0-9])",
}
LOOSE_HINT = {"email": r"(?i)[\[(] ?at ?[\])]", "ip": r"(?i)(?:[0-9a-f]{1,4}:){7}[0-9a-f]", "card": r"[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{2}", "phone": r"[0-9]{2}[).]? ?[ .-]?[0-9]{3,4}[ .-][0-9]{3}"}

CONTEXT_CHARS = 32
#: Words that announce personal data, and words that announce other numbers.
ANNOUNCE = r"(?i)(?:call|phone|tel|mobile|cell|fax|contact|mail|write|reach|card|visa|ip|host|address|sms|whatsapp|dial)\W{0,12}(?:\w+\W+){0,2}$"
OTHERWISE = r"(?i)(?:order|invoice|version|isbn|page|ref|serial|part|no|number|id|build|sku|case|ticket|code|total|usd|eur|sum)\W{0,12}(?:\w+\W+){0,1}$"
FEATURES = ("digits", "separators", "length", "brackets", "distinct", "luhn", "announced", "other", "letters", "mixed", "is_email", "is_phone", "is_card", "is_ip")

#: Training examples, trees, learning rate and the precision asked of added spans.
EXAMPLES, TREES, RATE, PRECISION = 1600, 40, 0.3, 0.995


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _passes(kind: str, span: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= F.when(F.regexp_replace(part, "^0+", "") <= F.lit("255"), 3).otherwise(2))
    digits = _digits(span)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """Every match as (s, e, t): code points, end exclusive, and the matched text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))
    spans = F.aggregate(
        pairs,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + F.length(x["hit"])).alias("e"), x["hit"].alias("t"))))).alias("out"),
        ),
    )
    return spans["out"]


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,t:string>>")


def base_spans(text: Column, kind: str) -> Column:
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINT[kind])
    return F.when(hint, F.filter(_matches(text, BASE[kind]), lambda x: _passes(kind, x["t"]))).otherwise(_none())


def loose_spans(text: Column, kind: str) -> Column:
    return F.when(text.rlike(LOOSE_HINT[kind]), _matches(text, LOOSE[kind])).otherwise(_none())


def features(kind: str, span: Column, before: Column) -> dict[str, Column]:
    """Format of the candidate and the context before it, as doubles."""
    digits = _digits(span)
    n = lambda c: c.cast("double")
    return {
        "digits": n(F.length(digits)),
        "separators": n(F.length(F.regexp_replace(span, r"[^ ._/:-]", ""))),
        "length": n(F.length(span)),
        "brackets": n(F.length(F.regexp_replace(span, r"[^\[\]()]", ""))),
        "distinct": n(F.size(F.array_distinct(F.split(digits, "")))),
        "luhn": n(F.coalesce(F.call_function("luhn_check", digits), F.lit(False)).cast("int")),
        "announced": n(before.rlike(ANNOUNCE).cast("int")),
        "other": n(before.rlike(OTHERWISE).cast("int")),
        "letters": n(F.length(F.regexp_replace(span, "[^A-Za-z]", ""))),
        "mixed": n(F.size(F.array_distinct(F.split(F.regexp_replace(span, r"[^ ._/:-]", ""), "")))),
        **{f"is_{k}": F.lit(float(k == kind)) for k in KINDS},
    }


def _example(rng: np.random.Generator) -> tuple[str, str, str, int]:
    """(kind, span, text before, label) from the format grammar."""
    d = lambda n: "".join(rng.choice(list("0123456789"), n))
    w = lambda a=3, b=8: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(a, b)))
    pick = lambda xs: xs[rng.integers(len(xs))]
    good, kind = int(rng.random() < 0.5), pick(KINDS)
    calls = ("call me at ", "phone: ", "tel ", "contact ", "my mobile is ", "write to ", "reach me: ", "card ", "host ", "ip ")
    others = ("order ", "invoice no. ", "version ", "page ", "ref ", "serial ", "part number ", "total ", "code ", "ticket ")
    if kind == "phone":
        sep = pick((" ", "-", "."))
        span = pick((f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}")) if good else pick((f"{d(4)}{pick(' .-')}{d(4)}{pick(' .-')}{d(3)}", f"{d(2)}{pick(' .-')}{d(3)}{pick(' .-')}{d(3)}", f"{d(4)}-{d(4)}-{d(5)}", f"{d(3)} {d(3)}.{d(3)}"))
    elif kind == "card":
        s = pick("./_")
        digits = d(15)
        total = sum(sum(divmod(int(c) * (1 + (i % 2 == 0)), 10)) for i, c in enumerate(digits))
        check = (10 - total % 10) % 10
        digits += str(check if good else (check + int(rng.integers(1, 10))) % 10)
        span = s.join(digits[i : i + 4] for i in range(0, 16, 4))
    elif kind == "email":
        name = pick((w(), f"{w()}.{w()}", f"{w()}{d(2)}"))
        at, dot = pick((" [at] ", "(at)", " (at) ", "[at]")), pick((" [dot] ", ".", " (dot) "))
        span = f"{name}{at}{w()}{dot}{pick(('com', 'org', 'net', 'de'))}" if good else f"{w()} (at) {w()} . {w(5, 12)}"
    else:
        span = ":".join("".join(rng.choice(list("0123456789abcdef"), 4)) for _ in range(8)) if good else ":".join(d(2) for _ in range(8))
    lead = pick(calls) if rng.random() < (0.6 if good else 0.1) else pick(others) if rng.random() < (0.02 if good else 0.6) else f"{w()} {w()} "
    return kind, span, f"{w()} {w()} {lead}", good


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> list:
    """Newton-boosted trees of depth two for logistic loss: (f, t, left, right), a leaf a number."""
    margin, out = np.zeros(len(y)), []

    def leaf(g, h):
        return float(round(rate * g.sum() / (h.sum() + 1.0), 6))

    def split(rows, g, h):
        best = (1e-9, None, None)
        root = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for t in np.unique(v)[:-1][:32]:
                m = v <= t
                a, b = rows[m], rows[~m]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - root
                if gain > best[0]:
                    best = (gain, f, float(t))
        return best[1], best[2]

    def predict(node):
        if isinstance(node, float):
            return np.full(len(y), node)
        f, t, a, b = node
        return np.where(x[:, f] <= t, predict(a), predict(b))

    def grow(rows, g, h, depth):
        f, t = split(rows, g, h) if depth else (None, None)
        if f is None:
            return leaf(g[rows], h[rows])
        m = x[rows, f] <= t
        return (f, t, grow(rows[m], g, h, depth - 1), grow(rows[~m], g, h, depth - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 2)
        out.append(tree)
        margin += predict(tree)
    return out


def margin_of(trees: list, x: np.ndarray) -> np.ndarray:
    def one(node):
        if isinstance(node, float):
            return np.full(len(x), node)
        f, t, a, b = node
        return np.where(x[:, f] <= t, one(a), one(b))

    return sum((one(t) for t in trees), np.zeros(len(x)))


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """Least margin from which held-out candidates reach the precision; infinite if none does."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(np.diff(margin[order]) != 0, True)
    good = np.flatnonzero((hits >= precision) & last)
    return float(margin[order][good[-1]]) if len(good) else float("inf")


def plain_features(kind: str, span: str, before: str) -> list[float]:
    """The values of features() in plain Python, for the fit; a test holds the two against each other."""
    digits, seps, context = re.sub("[^0-9]", "", span), re.sub(r"[^ ._/:-]", "", span), before[-CONTEXT_CHARS:]
    luhn = bool(digits) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    own = [len(digits), len(seps), len(span), len(re.sub(r"[^\[\]()]", "", span)), len(set(digits)) or 1, luhn, bool(re.search(ANNOUNCE, context)), bool(re.search(OTHERWISE, context)), len(re.sub("[^A-Za-z]", "", span)), len(set(seps)) or 1]
    return [float(v) for v in (*own, *(k == kind for k in ("email", "phone", "card", "ip")))]


@lru_cache(maxsize=4)
def model(examples: int = EXAMPLES, seed: int = 11) -> tuple[list, float]:
    """(trees, margin threshold)."""
    rng = np.random.default_rng(seed)
    made = [_example(rng) for _ in range(examples)]
    x, y = np.array([plain_features(kind, span, before) for kind, span, before, _ in made]), np.array([float(good) for *_, good in made])
    cut = examples * 3 // 4
    trees = boost(x[:cut], y[:cut])
    return trees, calibrate(margin_of(trees, x[cut:]), y[cut:])


def margin_column(trees: list, values: dict[str, Column]) -> Column:
    def one(node):
        if isinstance(node, float):
            return F.lit(node)
        f, t, a, b = node
        return F.when(values[FEATURES[f]] <= F.lit(t), one(a)).otherwise(one(b))

    out = F.lit(0.0)
    for tree in trees:
        out = out + one(tree)
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, added): arrays of (kind, s, e) sorted by start, then kind as listed."""
    trees, threshold = model()
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = narrow.select("id", "text", *[base_spans(F.col("text"), k).alias(f"b_{k}") for k in KINDS], *[loose_spans(F.col("text"), k).alias(f"l_{k}") for k in KINDS])

    def tagged(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    def likely(k: int, kind: str) -> Column:
        """Candidates of a kind that reach the threshold, each behind its negative margin."""

        def ranked(x):
            # substring() of an int column start keeps the context short however long the text is
            before = F.substring(F.col("text"), F.greatest(x["s"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT_CHARS)))
            return F.struct((-margin_column(trees, features(kind, x["t"], before))).alias("m"), x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

        some = F.col(f"l_{kind}")
        return F.when(F.size(some) > 0, F.filter(F.transform(some, ranked), lambda x: x["m"] <= F.lit(-threshold))).otherwise(F.array().cast("array<struct<m:double,s:int,k:int,e:int>>"))

    def free(x, spans):
        return ~F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    based = found.withColumn("base", F.array_sort(F.concat(*[tagged(F.col(f"b_{k}"), i) for i, k in enumerate(KINDS)])))
    based = based.withColumn("likely", F.concat(*[likely(i, k) for i, k in enumerate(KINDS)]))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    won = F.aggregate(F.array_sort("likely"), none, lambda a, x: F.when(free(x, a) & free(x, F.col("base")), F.concat(a, F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))).otherwise(a))
    return based.withColumn("added", F.when(F.size("likely") > 0, F.array_sort(won)).otherwise(none)).select("id", "text", "base", "added")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """(id, text) with every span of find_pii() replaced by its kind in brackets."""
    spans = F.array_sort(F.concat("base", "added"))
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.get(names, x["k"]), F.lit("]"))).alias("out")),
    )
    rest = F.struct(step.alias("done"))
    return found.select("id", rest["done"].alias("done"), "text").select("id", F.concat(F.col("done.out"), F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("text"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The op1 query's rows: counts per kind over all spans' base part, hash of base, all spans."""
    found = find_pii(docs)

    def count(i, kind):
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{kind}")

    counts = [count(i, k) for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
