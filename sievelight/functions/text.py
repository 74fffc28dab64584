"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def strings(values) -> Column:
    """A literal array of strings, also for no values."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def cut_end(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def fold_plural(t: Column) -> Column:
    """A lower-case word without its regular plural ending."""
    n = F.length(t)
    return (
        F.when((n <= 3) | ~F.endswith(t, F.lit("s")), t)
        .when(t.endswith("ies") & (n > 4), F.concat(cut_end(t, 3), F.lit("y")))
        .when(t.rlike("(ss|sh|ch|x)es$"), cut_end(t, 2))
        .when(t.rlike("[^sui]s$"), cut_end(t, 1))
        .otherwise(t)
    )


def normal_terms(words: Column) -> Column:
    """Lower case, regular plurals folded.  Each step is a transform of its own, so that no step's input is
    worked out more than once per word."""
    return F.transform(F.transform(words, F.lower), fold_plural)


def lexical_terms(text: Column) -> Column:
    """Normalised words, in text order."""
    return normal_terms(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0)))


def symbol_components(symbol: Column) -> Column:
    """Normalised parts of an identifier (snake, camel, kebab, dotted)."""
    parts = F.split(F.coalesce(symbol, F.lit("")), "[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return normal_terms(F.filter(parts, lambda p: p != ""))


def saturate(count: Column, k: float = 1.2) -> Column:
    c = count.cast("double")
    return F.when(c <= 0, F.lit(0.0)).otherwise(c / (c + F.lit(max(1e-6, k))))


def occurrences(terms: Column, wanted: Column) -> Column:
    """How many of terms are among wanted."""
    return F.size(F.filter(terms, lambda t: F.array_contains(wanted, t)))


def held(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(values: Column, block: int = 64) -> Column:
    """The sums of an array's values up to each.  Sums are taken in blocks, as appending copies what there is."""

    def within(b):
        return F.aggregate(b, F.array().cast("array<int>"), lambda a, v: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + v))

    def moved(parts):
        last = F.transform(parts, lambda b: F.get(b, F.size(b) - 1))
        return F.flatten(F.transform(parts, lambda b, k: held(F.aggregate(F.slice(last, 1, k), F.lit(0), lambda a, v: a + v), lambda before: F.transform(b, lambda v: v + before))))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / F.lit(block)).cast("int") - 1)), lambda k: within(F.slice(values, k * block + 1, F.lit(block))))
    return held(blocks, moved)


def term_counts(terms: Column) -> Column:
    """Each distinct term once, as (term, tf), in order of terms: runs of the sorted list, so nothing is searched."""

    def counted(s):
        begins = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        one = lambda b: F.transform(b, lambda i, at: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, at + 1), F.size(s)) - i).alias("tf")))
        return held(begins, one)

    return held(F.sort_array(terms), counted)


def symbol_role(symbol: Column, content: Column, file_path: Column, lines: Column) -> Column:
    """PUBLIC_API, INTERNAL_HELPER or UNKNOWN."""
    name = F.trim(F.coalesce(symbol, F.lit("")))
    small = lines <= V.HELPER_MAX_LINES
    public = F.lit(False)
    for marker in V.PUBLIC_MARKERS:
        public = public | F.contains(content, F.lit(marker))
    parts = symbol_components(name)
    stem = F.regexp_replace(F.regexp_extract(F.translate(F.coalesce(file_path, F.lit("")), "\\", "/"), "[^/]*$", 0), r"\.[^.]*$", "")
    own = F.filter(symbol_components(stem), lambda c: F.length(c) >= 3)
    return (
        F.when((name == "") | (name == "module_scope"), "UNKNOWN")
        .when(name.startswith("_") | (small & content.rlike(r"(?m)^[ \t]*static[ \t]+")), "INTERNAL_HELPER")
        .when(public, "PUBLIC_API")
        .when(small & F.arrays_overlap(F.slice(parts, 1, 3), strings(V.HELPER_VERBS)), "INTERNAL_HELPER")
        .when(F.arrays_overlap(own, parts), "PUBLIC_API")
        .otherwise("UNKNOWN")
    )


def token_key_steps(tokens: Column) -> Column:
    """Number and gerund folded: shares, sharing -> shar; one transform per step."""

    def number(t):
        n = F.length(t)
        return F.when(~F.endswith(t, F.lit("s")) | (n <= 3), t).when((n > 4) & t.endswith("ies"), F.concat(cut_end(t, 3), F.lit("y"))).when((n > 4) & t.rlike("(s|x|z|ch|sh)es$"), cut_end(t, 2)).when(~t.endswith("ss"), cut_end(t, 1)).otherwise(t)

    gerund = lambda t: F.when((F.length(t) > 5) & t.endswith("ing"), cut_end(t, 3)).otherwise(t)
    final = lambda t: F.when((F.length(t) > 3) & t.endswith("e"), cut_end(t, 1)).otherwise(t)
    return F.transform(F.transform(F.transform(tokens, number), gerund), final)


def split_word(word: Column) -> Column:
    """openIndexedDB -> [open, indexed, db]; a word without capitals is one part."""
    spaced = F.regexp_replace(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.when(word == F.lower(word), F.array(word)).otherwise(F.filter(F.split(F.lower(spaced), " "), lambda p: p != ""))


def token_keys(text: Column) -> Column:
    """Keys of all words and of their adjacent parts joined, with repeats."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))

    def with_pairs(parts):
        pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.concat(a, b))
        return F.when(F.size(parts) == 1, parts).otherwise(F.concat(parts, pairs))

    return token_key_steps(F.flatten(F.transform(F.transform(words, split_word), with_pairs)))


def declared_names(content: Column) -> Column:
    """Functions, classes, types and top-level bindings that a chunk declares."""
    unit = r"(?m)^(?:\d+: )?[ \t]*(?:(?:export|default|declare|abstract|async|public|private|protected|static|pub)\s+)*(?:function\*?|class|interface|type|enum|def|fn|func|struct|trait)\s+([A-Za-z_$][\w$]*)"
    binding = r"(?m)^(?:\d+: )?(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"
    return F.concat(F.regexp_extract_all(content, F.lit(unit), F.lit(1)), F.regexp_extract_all(content, F.lit(binding), F.lit(1)))


def clean_token(token: Column) -> Column:
    bare = F.translate(F.coalesce(token, F.lit("")), "Ġ ", "")
    return F.lower(F.regexp_replace(bare, r"""^[\s"'.,;:!?*`~()\[\]{}]+|[\s"'.,;:!?*`~()\[\]{}]+$""", ""))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return F.when(F.size(values) > 0, top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def is_test_substring(path: Column) -> Column:
    """The chunker's rule: one of eight parts occurs in the path."""
    out = F.lit(False)
    for part in V.TEST_PARTS:
        out = out | F.contains(F.lower(path), F.lit(part))
    return out


def is_test_path(path: Column) -> Column:
    """Discovery's rule: a test folder, or a test file name."""
    p = F.lower(path)
    base = F.regexp_extract(p, "[^/]*$", 0)
    return p.rlike("(^|/)(tests?|__tests__|specs?)(/|$)") | base.rlike(r"\.(test|spec)\.[a-z0-9]+$") | base.startswith("test_") | base.rlike(r"_test\.[a-z0-9]+$")


def is_doc(path: Column, symbol: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    return p.rlike(r"\.(md|rst|txt|doc)$") | F.contains(p, F.lit("/docs/")) | F.contains(p, F.lit("/doc/")) | F.coalesce((symbol == "module_scope") & F.contains(p, F.lit("readme")), F.lit(False))


def slice_of(path: Column) -> Column:
    """The architectural slice a path belongs to."""
    parts = F.filter(F.split(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/"), lambda p: p != "")
    n = F.size(parts)
    head = F.transform(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda p: F.array_contains(strings(V.SLICE_ROOTS), F.lower(p)))
    root = F.array_position(head, True)
    src = F.array_position(parts, "src")
    return F.when(root > 0, F.get(parts, root.cast("int"))).when((src > 0) & (src < n - 1), F.get(parts, src.cast("int"))).when(n > 1, F.get(parts, F.lit(0))).otherwise("root")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.length(text) / F.lit(3.6)).cast("int"))


def strip_line_numbers(content: Column) -> Column:
    return F.regexp_replace(content, r"(?m)^[ \t\x0b\f]*\d+:[ \t\x0b\f]?", "")


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cache_key(query: Column, content_hash: Column, model: Column, prompt_version: Column, byte_range: Column, intent: Column, prior_version: Column, exponent: Column) -> Column:
    """sha256 over eight fields; absent ones count as empty."""
    fields = [F.lower(normal_space(query)), content_hash, model, prompt_version, byte_range, intent, prior_version, exponent]
    return F.sha2(F.concat_ws(":", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def intent_counts(query: Column) -> dict[str, Column]:
    q = F.lower(query)

    def hits(words):
        total = F.lit(0)
        for w in words:
            total = total + F.contains(q, F.lit(w)).cast("int")
        return total

    return {"BUG_DIAGNOSIS": hits(V.BUG_WORDS), "SPECIFICATION": hits(V.SPEC_WORDS), "REFACTOR": hits(V.REFACTOR_WORDS), "IMPLEMENTATION": hits(V.IMPL_WORDS)}


def intent_of(query: Column) -> tuple[Column, Column]:
    """(intent, confidence); earlier kinds win ties, which halve the confidence."""
    counts = intent_counts(query)
    top = F.greatest(*counts.values())
    intent = F.lit("IMPLEMENTATION")
    for name in ("IMPLEMENTATION", "REFACTOR", "SPECIFICATION", "BUG_DIAGNOSIS"):
        intent = F.when((counts[name] == top) & (top > 0), name).otherwise(intent)
    ties = sum(((c == top).cast("int") for c in counts.values()), F.lit(0))
    confidence = F.when(top == 0, 0.0).when((ties > 1) | (top == 1), 0.5).otherwise(1.0)
    return intent, confidence


def wants_rerank(prompt: Column) -> Column:
    """Whether a prompt looks like a search of code."""
    p = F.lower(F.trim(F.coalesce(prompt, F.lit(""))))
    # word borders are ASCII: a letter beyond it parts words, as a sign does; only \n ends a line, and only the text's end is one
    bare = F.regexp_replace(p, r"[^\x00-\x7F]", "~")
    meets = lambda r: bare.rlike("(?d)" + r.replace("$", r"\z"))
    no, yes = F.lit(False), F.lit(False)
    for r in V.PROMPT_IGNORE:
        no = no | meets(r)
    for r in V.PROMPT_SEARCH:
        yes = yes | meets(r)
    return (F.length(p) >= 8) & ~no & yes


def is_machine_text(prompt: Column) -> Column:
    return F.coalesce(prompt, F.lit("")).rlike(r"^\s*[</]")


def is_code_question(prompt: Column) -> Column:
    """Whether a prompt asks about code: signs that only code has decide alone, workflow words veto the rest."""
    text = F.regexp_replace(F.coalesce(prompt, F.lit("")), r"^\s+|\s+$", "")
    # the patterns' word borders are ASCII: a letter beyond it parts words, as a sign does
    text = F.regexp_replace(text, r"[^\x00-\x7F]", "~")
    low = F.lower(text)
    bare = text
    for r in V.NOT_CODE:
        bare = F.regexp_replace(bare, r, "")
    sign = F.lit(False)
    for r in V.CODE_SIGNS:
        sign = sign | bare.rlike(r)
    acts = low.rlike(V.CODE_VERB) | (low.rlike(V.SET_VERB) & ~low.rlike(V.NOT_SET_VERB))
    asks = low.rlike(V.LOCATOR_UNIT) | (low.rlike(V.LOCATOR) & (acts | low.rlike(V.PARTICIPLE))) | (low.rlike(V.MECHANISM) & acts) | low.rlike(V.DEBUGGING)
    return F.when((F.length(text) < 8) | is_machine_text(prompt) | low.rlike(V.PROCESS_LEAD), False).when(sign, True).when(low.rlike(V.PROCESS_NOUNS) | low.rlike(V.ASKS_US), False).otherwise(asks)


def _beginnings(keys) -> list[str]:
    """With what words that fold to one of the keys begin.  Folding cuts endings (and puts y for ies), so a word begins with its key,
    less a final y."""
    stems = sorted({k[:-1] if k.endswith("y") else k for k in keys if k}, key=lambda k: (len(k), k))
    # a stem that begins with another one adds nothing
    return [k for i, k in enumerate(stems) if not any(k.startswith(o) for o in stems[:i])]


def may_hold(text: Column, keys, within_words: bool = False) -> Column:
    """Whether a text may hold a word that folds to one of the keys: false only if it holds none.  within_words: words are also parted
    where a capital begins."""
    least = _beginnings(keys)
    if not least:
        return F.lit(False)
    pattern = "(?<![A-Za-z0-9])(?i:" + "|".join(least) + ")"
    if within_words:
        pattern += "|" + "|".join(f"{k[0].upper()}(?i:{k[1:]})" for k in least)
    return text.rlike(pattern)


def terms_among(text: Column, keys) -> Column:
    """Those of lexical_terms(text) that are among the keys, in text order: only words that begin like one are cut out and folded."""
    least = _beginnings(keys)
    if not least:
        return strings([])
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![A-Za-z0-9])(?i:" + "|".join(least) + ")[A-Za-z0-9]*"), F.lit(0))
    return F.filter(normal_terms(words), lambda t: F.array_contains(strings(keys), t))


def may_hold_phrase(text: Column, phrases) -> Column:
    """Whether the folded words of a text, joined by blanks, may hold one of the phrases of two words: false only if they hold
    none.  A folded word that ends with the first one is, in the text, at most three letters longer."""
    begin = lambda k: k[:-1] if k.endswith("y") else k
    pairs = [p.split(" ") for p in phrases]
    if not pairs:
        return F.lit(False)
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(f"{begin(a)}[A-Za-z]{{0,3}}[^A-Za-z0-9]+{begin(b)}" for a, b in pairs))
