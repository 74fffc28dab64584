"""Features of a query, worked out once on the driver and passed to plans as literals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import vocab as V


def normal_term(term: str) -> str:
    t = term.strip().lower()
    if len(t) > 3:
        if len(t) > 4 and t[-3:] == "ies":
            return t[:-3] + "y"
        if re.search("(sses|shes|ches|xes)$", t):
            return t[:-2]
        if re.search("[^sui]s$", t):
            return t[:-1]
    return t


def lexical_terms(text: str) -> list[str]:
    return [normal_term(w) for w in re.findall("[a-zA-Z0-9]+", text or "")]


def split_terms(query: str) -> tuple[list[str], list[str]]:
    """(content terms, symptom terms), distinct, in order."""
    terms = [t for t in dict.fromkeys(lexical_terms(query)) if len(t) > 1]
    symptoms = [t for t in terms if t in V.SYMPTOMS]
    return [t for t in terms if t not in V.SYMPTOMS and t not in V.STOPWORDS], symptoms


_QUOTED = re.compile("[`'\"]([a-zA-Z0-9_]+)[`'\"]")
_CODE_NAME = re.compile(r"\b([a-z]+(?:[A-Z0-9][a-z0-9]*)+|[A-Z][a-z0-9]+(?:[A-Z0-9][a-z0-9]*)+|[a-zA-Z0-9]+(?:_[a-zA-Z0-9]+)+|[A-Z0-9_]{3,})\b")


def code_identifiers(query: str) -> list[str]:
    quoted = {q for q in _QUOTED.findall(query) if len(q) > 1}
    return sorted(quoted | set(_CODE_NAME.findall(query)))


@dataclass(frozen=True)
class Decomposition:
    """What a query is about, and what went wrong."""

    domain: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    symptoms: tuple[str, ...] = ()


def decompose(query: str) -> Decomposition:
    kind = []
    for t in lexical_terms(query):
        if len(t) < 2 or t.isdigit() or t in V.STOPWORDS and t not in V.SYMPTOMS:
            kind.append((None, t))
        else:
            kind.append(("symptom" if t in V.SYMPTOMS else "domain", t))
    pairs = [f"{a} {b}" for (ka, a), (kb, b) in zip(kind, kind[1:]) if ka == kb == "domain"]
    pick = lambda want: tuple(dict.fromkeys(t for k, t in kind if k == want))
    return Decomposition(pick("domain"), tuple(dict.fromkeys(pairs)), pick("symptom"))


_SUFFIXES = (
    # pattern, least length, (characters cut, characters added) ...
    ("ing$", 7, ((3, ""),)),
    ("ion$", 7, ((3, ""), (3, "e"))),
    ("ate$", 6, ((1, ""),)),
    ("ed$", 6, ((2, ""),)),
    ("(?:s|x|z|ch|sh)es$", 5, ((2, ""),)),
    ("[^s]s$", 5, ((1, ""),)),
)


def stems(word: str) -> list[str]:
    """Suffix stems of four letters or more, by the first suffix rule that applies."""
    for pattern, least, cuts in _SUFFIXES:
        if len(word) >= least and re.search(pattern, word):
            return [s for s in dict.fromkeys(word[: len(word) - n] + add for n, add in cuts) if len(s) >= 4]
    return []


def search_terms(query: str) -> list[str]:
    """Ordered terms for discovery, each followed by its stems."""
    words = [w for w in re.findall(r"\b[a-z0-9_]{2,}\b", (query or "").lower()) if w not in V.DISCOVERY_STOPWORDS]
    words = words or [w.lower() for w in (query or "").split()[:1]]
    return list(dict.fromkeys(t for w in words for t in (w, *stems(w))))


def token_key(token: str) -> str:
    w, n = token, len(token)
    if n > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif n > 4 and re.search("(s|x|z|ch|sh)es$", w):
        w = w[:-2]
    elif n > 3 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = w[:-3] if len(w) > 5 and w.endswith("ing") else w
    return w[:-1] if len(w) > 3 and w.endswith("e") else w


def term_keys(word: str) -> list[str]:
    """Every key that counts as the word: its own, and its base form's for -ed and -ion."""
    w = word.lower()
    base = w[:-2] if len(w) > 4 and w.endswith("ed") else w[:-3] if len(w) > 6 and w.endswith("ion") else None
    return list(dict.fromkeys(token_key(x) for x in (w, base) if x))


def plain_terms(query: str) -> list[str]:
    """Terms of the token-key scorer, with repeats."""
    words = [p for w in re.findall(r"\b[a-z0-9_]+\b", (query or "").lower()) for p in w.split("_")]
    return [w for w in words if len(w) > 1 and w not in V.TERM_STOPWORDS]


def intent(query: str) -> tuple[str, float]:
    q = query.lower()
    counts = [(sum(w in q for w in words), name) for name, words in (("BUG_DIAGNOSIS", V.BUG_WORDS), ("SPECIFICATION", V.SPEC_WORDS), ("REFACTOR", V.REFACTOR_WORDS), ("IMPLEMENTATION", V.IMPL_WORDS))]
    top = max(c for c, _ in counts)
    if not top:
        return "IMPLEMENTATION", 0.0
    leaders = [n for c, n in counts if c == top]
    return leaders[0], 0.5 if len(leaders) > 1 or top == 1 else 1.0


def expansion_terms(reply: str, query: str, most: int = 12) -> list[str]:
    """Terms a model suggested: three letters or more, none of the query's, no filler."""
    own = set(search_terms(query))
    found = re.findall(r"[a-z0-9_]{3,}", (reply or "").lower())
    return [t for t in dict.fromkeys(found) if t not in own and t not in V.DISCOVERY_STOPWORDS and t not in V.STOPWORDS][:most]


@dataclass(frozen=True)
class Query:
    """All features of one query."""

    text: str
    content: tuple[str, ...] = field(default=())
    symptoms: tuple[str, ...] = field(default=())
    identifiers: tuple[str, ...] = field(default=())
    decomposition: Decomposition = field(default=Decomposition())
    intent: str = "IMPLEMENTATION"
    confidence: float = 0.0

    @classmethod
    def of(cls, text: str, intent_name: str | None = None) -> Query:
        content, symptoms = split_terms(text)
        name, confidence = (intent_name, 1.0) if intent_name else intent(text)
        return cls(text, tuple(content), tuple(symptoms), tuple(code_identifiers(text)), decompose(text), name, confidence)

    @property
    def threshold(self) -> float:
        return V.THRESHOLDS[self.intent]


FEATURES = ("content", "symptoms", "identifiers", "domain", "phrases", "search", "plain", "keys")


def features(queries):
    """(query_id, content, symptoms, identifiers, domain, phrases, search, plain, keys) of a table of queries (query_id, text): every
    list that a single Query holds, for many queries at once, each list as a string array.  keys are the plain terms' keys."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = []
            for i, text in zip(pdf["query_id"], pdf["text"]):
                q = Query.of(text or "")
                plain = plain_terms(q.text)
                keys = list(dict.fromkeys(k for t in plain for k in term_keys(t)))
                rows.append((i, list(q.content), list(q.symptoms), list(q.identifiers), list(q.decomposition.domain), list(q.decomposition.phrases), search_terms(q.text), plain, keys))
            yield pd.DataFrame(rows, columns=["query_id", *FEATURES])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInPandas(run, f"query_id {kind}, " + ", ".join(f"{x} array<string>" for x in FEATURES))
