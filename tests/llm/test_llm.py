"""Training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import arrow_text, decontam, families, html_extract, langid, line_dedup, ngram_jaccard, order_minhash, packing, pii, secrets, url_filter
from sievelight.llm.components import connected_components
from sievelight.llm.scratch import Scratch

ODD = [None, "", " ", "\n\n", "x", "e\u0301 \U0001f600 ß", "word " * 3000, "a" * 20000, "same text twice over and over again here", "same text twice over and over again here"]


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", "clash") for i, t in enumerate(texts)]
    # id, key, h and n are names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string").withColumns({"id": F.lit(1), "h": F.lit(2), "n": F.lit(3)})


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["Hello  wörld", None, "", "a-B c", "x" * 9000 + " y", "\x00 z\x0b9"]
    for table, pattern in ((arrow_text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (arrow_text.NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        data, offsets = arrow_text.utf8(pa.array(texts))
        hashes, start, end, first = arrow_text.words(data, offsets, table)
        names = {}
        for i, t in enumerate(texts):
            got = [bytes(data[s:e]).decode() for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
            assert [low(w) for w in got] == re.findall(pattern, low(t))
            for w, h in zip(got, hashes[first[i] : first[i + 1]]):
                assert names.setdefault(low(w), h) == h


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(900, 900 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(30)] + [(5, 5), (1, 2), (1, 2), (None, 3)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    tables = Scratch(spark)
    rows = connected_components(spark.createDataFrame(edges, "u long, v long"), tables).collect()
    got = {r.vertex: r.component for r in rows}
    assert set(got) == set(u.up) and len(rows) == len(got)
    # a component is named by one of its vertices
    named = {}
    for v in u.up:
        named.setdefault(u.find(v), set()).add(got[v])
    assert all(len(x) == 1 and u.find(next(iter(x))) == root for root, x in named.items())
    assert connected_components(spark.createDataFrame([], "u long, v long"), tables).count() == 0


def test_components_of_a_sorted_path_and_a_hot_hub(spark):
    """A third of all edges meet in one vertex; a path in its own order needs the seeded rounds."""
    edges = [(i, i + 1) for i in range(2000)] + [(10_000 + i, 5_000) for i in range(1000)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    assert len({r.component for r in rows}) == 2 and len(rows) == 2001 + 1001


# --- personal data ----------------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(text):
    out = []
    for k, (name, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": name != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 13 < len(d) < 20 and luhn(d), "phone": 9 < len(d) < 16}[name]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii(spark):
    texts = ODD + ["a@b.c.d_x@y.zz é\U0001f600 q@r.st", "1.2.3.4.5.6.7.8 300.1.1.1 0001.0.0.255", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (415) 555-2671 x +12", "a@b@c.de.. x@y.z-", "9" * 40 + " " + "1." * 20 + "3", "4929 1234 5678 9012 3456 78"]
    rows = pii.pii_digest(frame(spark, texts)).collect()
    for r in rows:
        want = base_pii(texts[r.doc_id])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r.spans.split(",")) or not want
    assert len(rows) == len(texts) and pii.pii_digest(frame(spark, texts).limit(0)).count() == 0


def test_pii_added_spans(spark):
    texts = ["call me at (415) 555-2671 now", "write to joe [at] mail [dot] com ok", "order 1234-5678-901 is late", "version 10.2.33 of part 555-1234-99999"]
    spans = {r.doc_id: r.spans for r in pii.pii_digest(frame(spark, texts)).collect()}
    assert spans == {0: "phone:11:25", 1: "email:9:32", 2: "", 3: ""}
    assert pii.redact(pii.find_pii(frame(spark, texts[:1]))).first().text == "call me at [PHONE] now"


# --- secrets -----------------------------------------------------------------------------------


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) > 5]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) > 19]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) > 23])


def test_features_in_sql_and_python(spark):
    rng = np.random.default_rng(2)
    made = [pii._example(rng)[:3] for _ in range(200)]
    for kind in pii.KINDS:
        rows = [(i, span, before) for i, (k, span, before) in enumerate(made) if k == kind]
        df = spark.createDataFrame(rows, "i long, span string, before string")
        values = pii.features(kind, F.col("span"), F.expr(f"right(before, {pii.CONTEXT_CHARS})"))
        got = {r.i: [r[n] for n in pii.FEATURES] for r in df.select("i", *[values[n].alias(n) for n in pii.FEATURES]).collect()}
        assert got == {i: pii.plain_features(kind, span, before) for i, span, before in rows}


def test_overlapping_candidates_compete(spark):
    text = "call me at (555) 123-4567 or john [at] mail [dot] org, card 4111.1111.1111.1111 and 4111 1111 1111 1111"
    r = pii.find_pii(frame(spark, [text])).first()
    spans = sorted((x.s, x.e) for x in [*r.base, *r.added])
    assert r.added and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_secrets(spark):
    texts = ODD + ["secretoken=abcdefg TOKEN : 'abc' token=abc token = token=abcdefgh", "AKIAAKIA" + "A" * 30, "İpassword='hunter22'", "apikey=api_key:abcdef..", "0123456789abcdef01234567 F"]
    for r in secrets.secrets_digest(frame(spark, texts)).collect():
        want = base_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == secrets.base_sha256(want) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]


def test_checksummed_tokens():
    body, value, tail = "a" * 30, zlib.crc32(b"a" * 30), ""
    for _ in range(6):
        tail, value = secrets.BASE62[value % 62] + tail, value // 62
    found = secrets.scan(f"x ghp_{body}{tail} ghp_{'b' * 36}", secrets.automaton())
    assert [x for x in found if x[1] == 3] == [(2, 3, 42)]


# --- joins ----------------------------------------------------------------------------------------


def shingle_set(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = list(ODD)
    for size in (4, 8, 12, 25, 60, 150, 400):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            out.append(" ".join(base))
            for edits in (0, 1, 2, 4, 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                out.append(" ".join(copy).upper() if edits == 1 else " ".join(copy))
    return out


def brute_components(texts, width, num, den):
    sets, u = [shingle_set(t, width) for t in texts], Union()
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                u.join(i, j)
    return {i: (len(s), u.find(i)) for i, s in enumerate(sets)}


def test_overlap_of_packed_sets():
    rng = np.random.default_rng(6)
    for n in (1, 2, 50, 700):
        x, y = (np.sort(rng.integers(0, 3 * n, n).astype(np.uint64) << np.uint64(16)) for _ in range(2))
        want = sum((collections.Counter(x.tolist()) & collections.Counter(y.tolist())).values())
        assert ngram_jaccard.overlap(*(ngram_jaccard.unpacked(np.frombuffer(ngram_jaccard.packed(s), np.uint8)) for s in (x, y))) == want


def test_a_third_of_all_rows_in_one_component(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    near = [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(120)]
    other = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(240)]
    texts = near + other
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_digest(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 3, 90, 100)
    assert ngram_jaccard.jaccard_digest(frame(spark, []).limit(0)).count() == 0


def test_jaccard_join(spark):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_digest(frame(spark, texts)).collect()}
    assert got == brute_components(texts, 3, 90, 100)


def test_tiles_hold_every_link():
    """The pigeonhole: linked sets share a tile, at every size and edit distance that still links."""
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100)):
        classes = ngram_jaccard.Classes(num, den)
        for n in [*range(1, 60), 75, 99, 124, 125, 126, 300, 777]:
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for cut in range(0, n // 4 + 1, max(1, n // 40)):
                for grown in (0, cut):
                    t = np.unique(np.concatenate([s[cut:], rng.integers(0, 2**63, grown).astype(np.uint64)]))
                    common = len(np.intersect1d(s, t))
                    if len(t) and den * common >= num * (len(s) + len(t) - common) and not np.array_equal(s, t):
                        assert len(np.intersect1d(ngram_jaccard.tiles(s, classes), ngram_jaccard.tiles(t, classes))), (num, n, cut, grown)


@pytest.mark.parametrize("n", [60, 250, 900, 7000])
def test_unrelated_sets_share_few_tiles(n):
    """Empty blocks bring hardly any unrelated sets together: pairs of tiles stay few however many texts there are."""
    rng = np.random.default_rng(n)
    classes = ngram_jaccard.Classes(80, 100)
    names = [ngram_jaccard.tiles(np.unique(rng.integers(0, 2**63, int(n * rng.uniform(1, 1.2))).astype(np.uint64)), classes) for _ in range(120)]
    met = sum(len(np.intersect1d(a, b)) > 0 for i, a in enumerate(names) for b in names[:i])
    assert met <= 0.01 * 120 * 119 / 2, met


def test_tiles_that_agree_in_empty_blocks_only():
    """Links whose sets have no full block in common are found by the first of their common empty blocks."""
    rng = np.random.default_rng(4)
    met = 0
    for num, den, n in ((1, 10, 2), (1, 10, 3), (1, 5, 6), (1, 3, 10)):
        classes = ngram_jaccard.Classes(num, den)
        for _ in range(300):
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            t = np.unique(np.concatenate([s[: max(1, n * num * 2 // (num + den) + 1)], rng.integers(0, 2**63, n).astype(np.uint64)])[:n])
            common = len(np.intersect1d(s, t))
            if den * common >= num * (len(s) + len(t) - common) and not np.array_equal(s, t):
                met += 1
                assert len(np.intersect1d(ngram_jaccard.tiles(s, classes), ngram_jaccard.tiles(t, classes))), (num, den, n)
    assert met > 600


def test_tree_keeps_every_possible_pair():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (300, ngram_jaccard.TREE_GROUPS)).astype(np.int32)
    points[150:] = points[:150]
    points[150:, :3] += 1
    label = np.arange(300)
    got = {tuple(sorted(p)) for p in ngram_jaccard.link_pairs(points, 90, 100, label).tolist()}
    n = points.sum(1)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 190 * np.minimum(points[i], points[j]).sum() >= 90 * (n[i] + n[j])}
    assert got == want and len(want) >= 150


def test_trees_join_what_hubs_miss(spark):
    """A chain of copies that drift: no hub reaches the ends, so tiles hold several components."""
    rng = random.Random(9)
    text = [f"t{i}" for i in range(120)]
    chain = []
    for step in range(40):
        chain.append(" ".join(text))
        text[(step * 7) % 120] = f"n{rng.randrange(10**6)}"
        text[(step * 7 + 50) % 120] = f"m{rng.randrange(10**6)}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_digest(frame(spark, chain)).collect()}
    assert got == brute_components(chain, 3, 90, 100)


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"b{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 5, 9, 10, 11, 30)] + [None, "", "..."]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(40)) for _ in range(5)] + [f"xx {items[5].upper()} yy {items[4]}", items[3] + "." + items[3], " ".join(items[5].split()[:9])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    windows = collections.defaultdict(set)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    for i, t in enumerate(items):
        w = split(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    for r in decontam.phrase_matches(frame(spark, texts), bench).collect():
        w, hit, found = split(texts[r.id]), set(), set()
        for j in range(len(w)):
            for n in range(1, 11):
                key = tuple(w[j : j + n])
                if key in windows and len(key) == n:
                    hit |= set(range(j, j + n))
                    found |= windows[key]
        assert (r.n_words, {k for h in r.hits for k in range(h.start, h.end)}, set(r["items"])) == (len(w), hit, found)
        assert all(a.end < b.start for a, b in zip(r.hits, r.hits[1:]))
    digest = decontam.decontamination_digest(frame(spark, texts), bench).collect()
    assert len(digest) == len(texts) and {r.contaminated for r in digest} == {True, False}
    assert decontam.decontamination_digest(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontamination_digest(frame(spark, texts).limit(0), bench).count() == 0
    # ids of any type, null ids, and an item without one: it marks words but has no name
    odd = spark.createDataFrame([(None, "zz " + items[4]), ("a", items[4]), ("a", items[4])], "doc_id string, text string")
    rows = decontam.decontamination_digest(odd, spark.createDataFrame([(None, items[4])], "item_id long, text string")).collect()
    assert sorted((r.doc_id or "", r.n_hit, r.n_items) for r in rows) == [("", 11, 0), ("a", 11, 0), ("a", 11, 0)]


def test_proximity(spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame(spark, ["alpha x x beta y delta gamma", "alpha " + "z " * 100 + "beta gamma delta", None])
    assert [(r.id, r.item) for r in decontam.proximity_matches(docs, bench, within=10).collect()] == [(0, "7")]


# --- urls, languages, pages --------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "x.com/en/7", "http://COM/en/1", "https://a.example.com/en/71?q", "https://a.example.com/en/8#x", "http://notcom/en/", "http://x.net/de/", "http://example.net/de/80", "http://x.ORG/es/1", "http://x.org/ES/1", "http://spam-farm.example.org/q", "a://b://c.com/en/", "http://"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("key", F.lit(1))
    con = duckdb.connect()
    con.sql("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, u) for i, u in enumerate(urls)] * 2)
    got = sorted(map(str, (tuple(r) for r in url_filter.url_digest(pages).collect())))
    assert got == sorted(map(str, con.sql(url_filter.URL_SQL).fetchall()))
    assert url_filter.url_digest(pages.limit(0)).count() == 0


def test_url_rules_of_the_contract(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"http://{a}{rule}{b}" for rule in want for a in ("", "a.b.") for b in ("", "x/y?q=1")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_digest(pages).collect()}
    assert got == {i: (rule, v) for i, (rule, v) in enumerate((rule, v) for rule, v in want.items() for _ in range(4))}


def test_languages(spark):
    rng = random.Random(8)
    parts = {"aa": ["tor", "min", "ul", "est"], "bb": ["kwa", "zu", "ngo", "ubi"], "cc": ["ché", "élo", "ôn", "ueil"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(25)), lang))
    rows += [(900, None, "aa"), (901, "12 .. 3", "aa"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.langid_digest(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 900]
    assert held and all(got[i].held_out for i, _, _ in held)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in langid.langid_digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 20])
def test_codewords_differ(n):
    codes = langid.codewords(n)
    assert len({tuple(c) for c in codes.tolist()}) == n


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav>"
        "<div class='ad'>Buy, now, cheap, things, here.</div><article><h1>Title &amp;&lt;</h1><p><b>One,\n two<br>three.<p>Four &copy; five.</p><div class=comments><p>First! A reader, with, commas.</p></div></article>"
        "<aside><p>Side, text, here, too.</p></aside><footer>&copy; x</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Title &<\nOne, two three.\nFour © five."
    for odd in (None, "", "<", "<<<>>>", "plain, text", "<p>" * 5000, "<div>" * 20000 + "deep", "<!-- never closed", "<a " * 3000, "</p></div>x"):
        html_extract.main_text(odd)
    assert html_extract.main_text("plain, text") == "plain, text"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.n_chars) for r in html_extract.extract(pages).collect()) == [(1, len('Title &<\nOne, two three.\nFour © five.'))] * 2 + [(2, 0)]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_of_uneven_sections(tag):
    text = "A sentence of some length, with a comma or two, to count. "
    long = "<section>" + f"<p>{text * 5}</p>" * 40 + "</section>"
    tail = "<section><h2>Short</h2><p>Only a short paragraph here.</p></section><ul><li>item</li></ul><table><tr><td>cell</td></tr></table>bare text"
    page = f"<body><nav><a href=/>Home</a></nav><{tag}><h1>Title</h1>{long}<div class=ad>Buy</div>{tail}</{tag}><footer>end</footer></body>"
    assert html_extract.main_text(page).split("\n") == ["Title", *[(text * 5).strip()] * 40, "Short", "Only a short paragraph here.", "item", "cell", "bare text"]


LONG = "A sentence of some length, with a comma or two, to count. " * 5
BODY = f"<p>{LONG}</p><p>{LONG}</p>"
TWICE = [LONG.strip()] * 2


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="content with-sidebar">{BODY}</div>', TWICE),
        (f'<div class="post has-comments">{BODY}</div><p>neighbour</p>', [*TWICE, "neighbour"]),
        (f'<article>{BODY}<div class="post-comments"><p>{LONG}</p></div></article>', TWICE),
        (f'<article>{BODY}<section id="comments"><p>{LONG}</p></section></article>', TWICE),
        (f'<article>{BODY}<div class="related-posts"><ul><li><a href=/>x, y, z</a></li></ul></div></article>', TWICE),
        (f'<div id="page-menu-left">{BODY}</div><footer>f</footer>', TWICE),
        (f'<div class="widget">{BODY}</div>', TWICE),
        (f"<article>{BODY}<p>E = <math><mi>m</mi><mi>c</mi></math> holds</p></article>", [*TWICE, "E = mc holds"]),
        (f"<article><section>{BODY}</section><h2>Short</h2><section><p>Tiny end.</p></section></article>", [*TWICE, "Short", "Tiny end."]),
        (f"<div><section>{BODY}</section><h2>Short</h2><section><p>Tiny end.</p></section></div>", [*TWICE, "Short", "Tiny end."]),
        (f"<main><header><h1>T</h1></header>{BODY}</main>", ["T", *TWICE]),
        (f"<header><h1>Site</h1></header><main>{BODY}</main>", TWICE),
        (f'<main>{BODY}<form>f<input></form><aside class="x">side</aside></main>', TWICE),
        (f"<article>{BODY}<ul><li>one<li>two<ul><li>inner</ul></ul></article>", [*TWICE, "one", "two", "inner"]),
        (f"<article>{BODY}<table><tr><td>a<td>b<tr><td>c</table></article>", [*TWICE, "a", "b", "c"]),
        (f"<article>{BODY}<nav>" + "<a><b><font>" * 400 + "menu</nav><p>after</p></article>", [*TWICE, "after"]),
        (f"<article>{BODY}<pre>x\n  y</pre>a &lt; b &#8212; c</article>", [*TWICE, "x y", "a < b \u2014 c"]),
        (f'<div role="navigation">n</div><div role="main">{BODY}</div>', TWICE),
        (f'<div class="cookie-notice"><p>We, use, cookies.</p></div><article>{BODY}</article>', TWICE),
        ('<div class="sidebar"><p>All there is.</p></div>', ["All there is."]),
    ],
)
def test_page_shapes(page, want):
    assert html_extract.main_text(f"<html><body>{page}</body></html>").split("\n") == want


def test_pages_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        for page in ("<span>" * n + "</p>" * n, "<span>" * n + "<p>" * n, "<b>" * n + "</i>" * n, "<ul>" * n + "<li>" * n, "<div class=ad>" * n):
            html_extract.main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(10_000), 0.05)


def test_decoding_by_brute_force():
    """Losses of every codeword, bit by bit, with weights that differ and matter."""
    rng = np.random.default_rng(4)
    counts = {x: rng.poisson(0.2, langid.BUCKETS).astype(float) for x in "abcd"}
    accuracy = np.linspace(0.55, 1.0, 7)
    model = langid.fit(counts, accuracy)
    assert len(set(np.round(model.trust, 6))) == 7 and (np.diff(model.trust) > 0).all()
    sums, n = rng.normal(0, 40, (200, 7)), np.full(200, 30)
    best, score, close = langid.decode(model, sums, n)
    flat = langid.decode(langid.fit(counts), sums, n)[0]
    assert (best != flat).any()
    for i in range(200):
        losses = []
        for code in model.codes.tolist():
            total = 0.0
            for b, sign in enumerate(code):
                total += model.trust[b] * np.log1p(np.exp(-np.clip(3.0 * sums[i, b] / n[i] * model.slope[b] * sign, -30, 30)))
            losses.append(total)
        assert best[i] == int(np.argmin(losses))
        assert close[i] == (sorted(losses)[0] >= langid.AMBIGUOUS * sorted(losses)[1]) and 0 <= score[i] <= 1


def test_bits_are_measured_on_held_back_documents(spark):
    """Two languages that are nearly alike make some bits err on single documents."""
    rng = random.Random(5)
    near = ["tor", "min", "ul", "est", "ka"]
    parts = {"aa": near, "ab": [*near[:-1], "ke"], "bb": ["kwa", "zu", "ngo"], "cc": ["xil", "oth", "yr"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(2)) for _ in range(4)), x) for i in range(800) for x in [sorted(parts)[i % 4]]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.trust.max() > 1.5 * model.trust.min()


# --- packing, lines, fingerprints ------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ODD + ["it's ISN'T µª²½ÀÿÞß×÷ \x1c\x85", "<|endoftext|>a", "ΑΣ İx ǅ 日本語"] + [f"doc {i} with some words " * (i * 9 % 70) for i in range(60)]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(frame(spark, texts)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(by_doc[i])
        assert b"".join(p[2] for p in pieces) == want and all(p[3] == len(want) // 4 for p in pieces)
        assert [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces)])[:-1].tolist()
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_differencing():
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    rng = random.Random(2)
    lengths = [rng.randrange(1, 513) for _ in range(900)]
    where, windows = packing.deal(lengths)
    assert np.bincount(where, lengths).max() <= packing.CAPACITY and windows <= 1.03 * sum(lengths) / packing.CAPACITY + 1
    assert packing.deal([]) == ([], 0) and packing.deal([2048] * 3)[1] == 3


def test_line_dedup(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    line = " ".join(word() for _ in range(60))
    near = " ".join([*line.split()[:-1], "changed"])
    other = " ".join(word() for _ in range(60))
    texts = [None, "", f"{line}\nshort\n{other}", f"{line}\nshort", f"{near}\nshort\n", f"{other} ", f"{line}\n{line}"]
    rows = {r.doc_id: r for r in line_dedup.line_digest(frame(spark, texts)).collect()}
    assert {i: r.dropped for i, r in rows.items()} == {0: "", 1: "", 2: "", 3: "0", 4: "0", 5: "0", 6: "0,1"}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert out == {0: None, 1: "", 2: texts[2], 3: "short", 4: "short\n", 5: "", 6: ""}
    assert line_dedup.line_digest(frame(spark, texts).limit(0)).count() == 0
    plan = line_dedup.line_digest(frame(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def line_shingles(t):
    n = line_dedup.SHINGLE
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))}


def similar_components(lines):
    """Lines joined by brute force: all character shingles, similarity of 0.8."""
    sets, union, at = [line_shingles(t) for t in lines], Union(), collections.defaultdict(list)
    for i, a in enumerate(sets):
        union.find(i)
        common = collections.Counter(j for x in a for j in at[x])
        for j, n in common.items():
            if 180 * n >= 80 * (len(a) + len(sets[j])):
                union.join(i, j)
        for x in a:
            at[x].append(i)
    return [union.find(i) for i in range(len(lines))]


def test_lines_of_long_words(spark):
    rng = random.Random(9)
    urls = [f"https://www.{''.join(rng.choice('abcdefghij') for _ in range(20))}.com/{i}" for i in range(4)]
    unspaced = ["\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u304b\u3089" + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30)) for _ in range(3)]
    tails = [f"one two {''.join(rng.choice('abcdefghij') for _ in range(40))}" for _ in range(2)]
    tails = [tails[0], tails[0][:20] + tails[1][20:]]
    long = "".join(rng.choice("abcdefghij") for _ in range(200))
    texts = [*urls, *unspaced, *tails, long, long[:-3] + "xyz"]
    rows = {r.doc_id: r.n_dropped for r in line_dedup.line_digest(frame(spark, texts)).collect()}
    assert rows == {i: int(i == len(texts) - 1) for i in range(len(texts))}
    got = spark.createDataFrame([("ab 123456789012 " + "x" * 10 + " y",)], "t string").select(line_dedup.anchored(F.col("t"))).first()[0]
    assert got == ["ab 1234567", "1234567890", "2345678901", "3456789012", "x" * 10, "y"]


def test_shingles_of_pieces(spark):
    # lengths around a shingle and around the ends of pieces; characters of one to four bytes, four being two units in Java
    rng = random.Random(12)
    sizes = [1, 9, 10, 11, 25, 26, 27, 41, 42, 43, 300]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in sizes for letters in ("ab", "ab \t\r", "x\u00e9\u4eca", "x\U0001f600\U0001f601\U0001f602")]
    want = [[t[i : i + 10] for i in range(max(1, len(t) - 9))] for t in texts]
    rows = spark.createDataFrame(list(zip(texts, want)), "t string, want array<string>")
    got = rows.select(line_dedup.shingles(F.col("t")).alias("got"), F.transform("want", lambda x: F.xxhash64(x)).alias("want")).collect()
    assert len(got) == len(texts) and all(r.got == r.want for r in got)


def test_bucket_members(spark, tmp_path):
    # keys 1 and 2 share two buckets that count once; bucket 4 holds one key twice; null is no bucket
    rows = [(1, [1, 2, 4]), (2, [1, 2]), (3, [3]), (1, [4, 5]), (5, [5, None]), (6, [5, None])]
    spark.createDataFrame(rows, "key long, tiles array<long>").write.parquet(str(tmp_path / "rows"))
    exploded = spark.read.parquet(str(tmp_path / "rows")).select(F.explode("tiles").alias("tile"), "key")
    got = families.bucket_members(exploded, "tile", Scratch(spark))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1), (1, 1, 2, 2), (5, 1, 3, 1), (5, 1, 3, 5), (5, 1, 3, 6)]
    # both readers of the exploded rows take one shuffle
    shared = families.shared_rows(exploded, "tile")
    shared.collect()
    final = shared._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count("Generate") == 1


@pytest.mark.parametrize("rounds", [0, 2])
def test_families_that_share_a_band_key(spark, monkeypatch, rounds):
    # every line in one bucket: families of near lines, and lines that are like no other
    monkeypatch.setattr(line_dedup, "_bands", lambda lines: lines.select("key").withColumn("band", F.lit(1).cast("long")))
    monkeypatch.setattr(families, "PAIRS_A_KEY", 0)
    monkeypatch.setattr(families, "HUB_ROUNDS", rounds)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    lines = []
    for size in (1, 1, 2, 2, 3, 4, 5, 9, 9, 12):
        base = [word() for _ in range(40)]
        for k in range(size):
            lines.append(" ".join([*base[:-1], f"end{k}"] if k % 2 else [f"start{k}", *base[1:]]))
    rng.shuffle(lines)
    want, seen = [], set()
    for i, c in enumerate(similar_components(lines)):
        want += [i] if c in seen else []
        seen.add(c)
    assert len(want) > 30
    rows = line_dedup.line_digest(frame(spark, lines)).collect()
    assert sorted(r.doc_id for r in rows if r.n_dropped) == want


def test_line_search_is_compiled(spark, tmp_path):
    # two bands: lines 1 and 2 differ in one shingle, 3 in all; 4 is of the most frequent label of its band
    texts = ["abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz012345678X", "9876543210zyxwvutsrqponmlkjihgfedcba", "abcdefghijklmnopqrstuvwxyz012345678Y"]
    lines = line_dedup._candidates(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "key long, line string"), spark.range(1, 5).withColumnRenamed("id", "key"))
    assert {r.n for r in lines.collect()} == {27}
    pending = spark.createDataFrame([(7, 1, 1, 3), (7, 2, 2, 3), (7, 3, 3, 3), (8, 4, 4, 4), (8, 1, 1, 4)], "bucket long, key long, label long, lead long")
    pending.join(line_dedup._sketches(lines, pending.select("key").distinct()), "key").write.parquet(str(tmp_path / "rows"))
    met = line_dedup._possible(spark.read.parquet(str(tmp_path / "rows")))
    assert sorted(map(tuple, met.collect())) == [(2, 1), (4, 1)]
    # Spark makes code for the join, and no method is longer (8,000 bytes) than the JVM compiles
    final = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.search(r"\*\(\d+\) (BroadcastHash|SortMerge)Join", final)
    made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(met._jdf.queryExecution().executedPlan())
    assert 0 < max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000


def test_line_recall(spark):
    """Against all pairs of the distinct lines of a table: nothing unlike is dropped, and of what is like 97 % at least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    first = {}
    for r in docs:
        for no, line in enumerate((r.text or "").split("\n")):
            if len(line.strip(" ")) >= line_dedup.MIN_CHARS:
                first.setdefault(line.strip(" "), (r.doc_id, no))
    lines = list(first)
    root, best = similar_components(lines), {}
    for line, c in zip(lines, root):
        best[c] = min(best.get(c, first[line]), first[line])
    want = {line for line, c in zip(lines, root) if first[line] != best[c]}
    got = set()
    text = {r.doc_id: r.text for r in docs}
    kept = set()
    for r in line_dedup.line_digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        gone = {int(x) for x in r.dropped.split(",") if x}
        for no, line in enumerate((text[r.doc_id] or "").split("\n")):
            (got if no in gone else kept).add(line.strip(" "))
    got -= kept
    assert not got - want and len(got & want) >= 0.97 * len(want), (len(got), len(want), len(got & want))
    print("lines to drop", len(want), "dropped", len(got))


def slow_fingerprint(text):
    """Order MinHash by its definition, k-mer by k-mer."""
    k, slots = order_minhash.K, order_minhash.SLOTS
    if not text:
        return [0] * slots
    one = lambda x: int(order_minhash.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    a, b = int(order_minhash._A), int(order_minhash._B)
    k = min(k, len(text))
    seen, numbered = collections.Counter(), []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * a + ord(c) + 1) & (2**64 - 1)
        h = one(h + k)
        numbered.append(one(h + seen[h] * b) if seen[h] else h)
        seen[h] += 1
    own = collections.defaultdict(list)
    for i, h in enumerate(numbered):
        own[h >> 58].append((h, i))
    out = []
    for s in range(slots):
        away = next(d for d in range(slots) if own.get((s + d) % slots))
        best = sorted(own[(s + away) % slots])[:2]
        if len(best) == 2:
            first, second = (h for _, h in sorted((i, h) for h, i in best))
            value = one(one(first) * a + second)
        else:
            value = one(best[0][0] + b)
        out.append(max((one(value + away * b) if away else value) >> 32, 1))
    return out


def test_fingerprints_by_brute_force():
    rng = random.Random(12)
    for n in (1, 5, 12, 13, 40, 300, 900, 4000):
        text = "".join(rng.choice("abc \u00e9\U0001f600") for _ in range(n))
        assert order_minhash.fingerprint(text).tolist() == slow_fingerprint(text), n


def test_fingerprints(spark):
    texts = ODD + ["abc " * 50, "The quick brown fox jumps over the lazy dog. " * 12]
    rows = sorted(order_minhash.order_minhash_digest(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    for i, r in enumerate(rows):
        t, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == order_minhash.spell(order_minhash.fingerprint(t)) and r.edited_fingerprint == order_minhash.spell(order_minhash.fingerprint(edited))
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1.0) >= (t == nxt)


def test_fingerprints_follow_edits():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    base = order_minhash.fingerprint(text)
    small = order_minhash.likeness(base, order_minhash.fingerprint(text[:2000] + "zz" + text[2002:]))
    large = order_minhash.likeness(base, order_minhash.fingerprint(text[:3000] + text[:1000]))
    moved = order_minhash.likeness(base, order_minhash.fingerprint(text[2000:] + text[:2000]))
    assert small > 0.9 > large > 0.2 and moved < small


def test_fingerprint_order_of_odd_ids(spark):
    rows = [(None, "x y"), (5, None), (5, ""), (7, "abc" * 50), (7, "abc" * 50), (9, "é\U0001f600")]
    got = order_minhash.order_minhash_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert order_minhash.order_minhash_digest(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().near_next == 1.0


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)"])
def test_successors_over_many_ranges(spark, kind):
    texts = [f"text number {i} " * (1 + i % 3) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string").select(F.lpad(F.col("n").cast("string"), 6, "0").cast(kind).alias("doc_id"), "text").repartition(7)
    rows = sorted(order_minhash.order_minhash_digest(docs).collect(), key=lambda r: r.doc_id)
    assert len(rows) == 300
    for i, r in enumerate(rows):
        q = len(texts[i]) // 4
        assert r.edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - q] + texts[(i + 1) % 300][:q]).encode()).hexdigest()
    assert order_minhash.order_minhash_digest(docs.limit(0)).count() == 0


def test_release_gives_native_memory_back(spark, monkeypatch):
    import os

    from sievelight.llm import scratch

    jvm = spark._jvm
    pid = int(jvm.java.lang.ProcessHandle.current().pid())

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024

    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    # about 270 KB each; one in twenty stays, so that the allocator cannot cut its arena by itself
    buffers = [jvm.java.util.zip.Deflater() for _ in range(500)]
    for i, b in enumerate(buffers):
        if i % 20:
            b.end()
    seen, trim = [], scratch.trim_native

    def watched(session):
        # around the call only: the collections before it change the heap
        seen.append((held(), trim(session), held()))

    monkeypatch.setattr(scratch, "trim_native", watched)
    monkeypatch.setattr(Scratch, "collected", float("-inf"))
    Scratch(spark).release()
    for b in buffers:
        b.end()
    assert len(seen) == 1 and seen[0][1] and seen[0][2] < seen[0][0] - 60


def test_driver_reads_small_tables_in_few_jobs(spark):
    conf, sc = spark.conf, spark.sparkContext
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: conf.get(k) for k in held}
    for k, v in held.items():
        conf.set(k, v)
    try:
        sc.setJobGroup("few-jobs", "few")
        bits = decontam.bit_filter(spark.range(5000).select(F.xxhash64("id").alias("term")))
        jobs = len(sc.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            conf.set(k, v)
    want = {int(r.x) & ((1 << decontam.FILTER_BITS) - 1) for r in spark.range(5000).select(F.xxhash64("id").alias("x")).collect()}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == want
    assert jobs <= 20


def test_pairs_meet_their_payloads_once(spark):
    tables = Scratch(spark)
    items = tables.keep_dealt(spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("p"), "id").alias("line")), "key", 4)
    # a hub with many parts, and pairs that stand alone
    want = {(u, 0) for u in range(1, 400)} | {(u, u - 1) for u in range(2, 100)}
    got = families.meet(spark.createDataFrame(sorted(want), "u long, v long"), items, "line")
    rows = got.collect()
    assert len(rows) == len(want) and {(r.u, r.v) for r in rows} == want
    assert all((r.a, r.b) == (f"p{r.u}", f"p{r.v}") for r in rows)
    # pairs are joined with their parts, with u's items and with v's: three joins, and a fourth of items with parts
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 4
    tables.drop(items)
