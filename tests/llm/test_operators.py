"""The operators against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import components, contamination, jaccard, repeats
from pyspark.sql import functions as F

from quillmeter.llm import _components, _text, decontaminate, html_density, jaccard_join, packing, pseudo_lm, repeat_bytes, toxicity, url_rules, vector_dedup, warc_zstd
from quillmeter.llm._store import Store

#: Names that operators give or use themselves, as extra columns of an input.
CLASH = "n_words n_hit items spans contaminated score held_out predicted n_bytes n_removed n_spans kept_sha256 kept rest h tid id cls label component component_id sequence_id offset host path rule verdict text_ _text _h _k grp log_likelihood n_links".split()


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):03d}{'.' if rng.random() < 0.1 else ''}" for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([3, 8, 40, 200, 700])) for _ in range(60)]
    texts += [None, "", " \n ", "one", "Zwei Wörter", "é" * 300, "a" * 1000, "\0" * 500, "x\0y " * 100]
    texts += texts[:6] + [texts[7].upper(), texts[8] + " tail", "lead " + texts[8], prose(rng, 30_000)]
    near = texts[12] if len(texts[12] or "") > 1500 else prose(rng, 400)
    for k in range(12):
        words = near.split()
        for _ in range(4 * k):
            words[rng.randrange(len(words))] = "zz" + str(rng.randrange(99))
        texts.append(" ".join(words))
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(4)] + [passage + passage]
    return list(enumerate(texts))


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5).cache()


EMPTY = "doc_id long, text string"


def test_word_hashes():
    texts = [b"Ab c\xc3\x89 ab", None, b"", b"ab"]
    h, first = _text.hashed_words(texts, _text.ALNUM)
    assert first.tolist() == [0, 3, 3, 3, 4] and h[0] == h[2] == h[3] != h[1]
    assert list(_text.chunks([b"a" * 10, None, b"b" * 10], 10)) == [(0, 1), (1, 3)]
    assert _text.hashed_words([], _text.ALNUM)[0].size == 0


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n], t[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 65, 512, 1024, 2048, 4096])
def test_words_that_polynomials_confuse(n):
    one, two = thue_morse(n)
    h, k, first = _text.hashed_words([one.encode(), two.encode(), one.upper().encode()], _text.NON_SPACE, (0, 1))
    assert h[0] == h[2] != h[1] and k[0] == k[2] != k[1] and h[0] != k[0] and first.tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_thue_morse_words(spark, n):
    """As words, in shingles and in windows, by brute force."""
    one, two = thue_morse(n)
    rows = [(1, one), (2, two), (3, f"{one} b c d e f"), (4, f"{two} b c d e f"), (5, " ".join([one] * 13)), (6, " ".join([two] * 13)), (7, one), (8, f"x {' '.join([two] * 14)}")]
    items = [(1, one), (2, " ".join([two] * 13)), (3, "b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == contamination(rows, items)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()} == jaccard(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 520)] + [(5, 5)]
    want = {n: c for n, c in components({x for e in edges for x in e}, edges).items() if n != c}
    got = _components.components(spark.createDataFrame(edges, "a long, b long").repartition(7), Store(spark, "t"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert _components.components(spark.createDataFrame([], "a long, b long"), Store(spark, "t")).count() == 0


# 1: URL rules

URLS = ["http://A.Org/x?q", "https://m.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://com/de/", "http://xcom/de/", None, "no scheme", "", "http://", "http://h#f://x/", "x://y://z/p"]


def test_url_parts_and_rules(spark):
    def plain(url):
        if not url or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]

    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.org/"), (3, URLS[3])], "page_id long, url string")
    out = url_rules.filter_urls(clashing(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), rules=url_rules.RULES).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        assert (r["host"], r["path"]) == plain(r["url"])
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r["rule"], r["verdict"]) == want


def test_url_mining(spark):
    pages = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}.example.net/{'ads' if i % 8 == 0 else 'news'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 8 == 0 else 1, None) for i in range(0, 400, 2)] + [(None, 0, 1), (2, None, None)]
    out = url_rules.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), min_confidence=0.6)
    assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == set(range(0, 400, 8))
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.filter_urls(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def naive_rules(rows, least, most, confidence, lift, accident, size=3):
    """All rules by counting every set of up to three tokens of every row; tokens in equal rows are one."""
    from itertools import combinations
    from statistics import NormalDist

    places = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            places.setdefault(t, set()).add(i)
    groups = {}
    for t, at in places.items():
        if least <= len(at) <= most:
            groups.setdefault(frozenset(at), []).append(t)
    bad = {i for i, (_, b) in enumerate(rows) if b}
    rate, counts = len(bad) / len(rows), {}
    for m in range(1, size + 1):
        for chosen in combinations(groups, m):
            at = frozenset.intersection(*chosen)
            if len(at) >= least:
                counts[frozenset(chosen)] = at
    z = NormalDist().inv_cdf(1 - accident / len(counts))
    good = {c: len(at & bad) / len(at) for c, at in counts.items() if len(at & bad) >= max(confidence, lift * rate) * len(at) and len(at & bad) - len(at) * rate > z * (len(at) * rate * (1 - rate)) ** 0.5}
    kept = {}
    for c in sorted(good, key=len):
        if all(kept[w] < good[c] for w in kept if w < c):
            kept[c] = good[c]
    return {(frozenset(t for g in c for t in groups[g]), round(p, 9), len(counts[c])) for c, p in kept.items()}


@pytest.mark.parametrize("seed", range(3))
def test_all_rules_by_counting(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        tokens = [f"a{rng.randrange(5)}", f"b{rng.randrange(4)}", *(["c", "c2"] if rng.random() < 0.3 else []), *(["d"] if rng.random() < 0.5 else []), "everywhere"]
        risk = 0.1 + 0.4 * ("a1" in tokens and "b2" in tokens) + 0.3 * ("c" in tokens and "d" in tokens) + 0.3 * ("a0" in tokens)
        rows.append((tokens, rng.random() < risk))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_count=10, min_support=0.0, min_confidence=0.3)
    want = naive_rules(rows, 10, 0.95 * 600, 0.3, url_rules.MIN_LIFT, url_rules.ACCIDENT)
    assert {(k, round(c, 9), n) for k, c, n in got} == want and len(want) >= 2 and any(len(k) > 1 for k, _, _ in want)


@pytest.mark.parametrize("share", [0.1, 0.6, 1.0])
def test_rules_of_long_pages(spark, share):
    """Pages with up to thirty frequent tokens, among which telling ones are many: all sets of all their tokens count, also
    those of two that only together tell."""
    rng, rows = random.Random(int(10 * share)), []
    for _ in range(900):
        bad, long = rng.random() < 0.3, rng.random() < share
        telling = [f"t{i}" for i in range(20) if rng.random() < (0.75 if bad else 0.55)] if long else [t for t in ("t0", "t1") if bad]
        pair = rng.choice([["x", "y"], []]) if bad else rng.choice([["x"], ["y"]])
        rows.append(([*telling, *pair, *(f"z{i}" for i in range(8) if long and rng.random() < 0.5)] or ["none"], bad))
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_count=30, min_support=0.0)
    want = naive_rules(rows, 30, 0.95 * 900, url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT, url_rules.ACCIDENT)
    assert {(k, round(c, 9), n) for k, c, n in got} == want and frozenset("xy") in {k for k, _, _ in want}


def test_many_shared_parameters(spark):
    """Sets of tokens that always come together, and of many that mostly do, end in seconds."""
    rng = random.Random(4)
    names = [f"q:{i}" for i in range(40)]
    same = [([*names, "h0:x"], i % 2 == 0) for i in range(300)] + [(["h0:y"], False) for _ in range(300)]
    found = url_rules.mine(spark.createDataFrame(same, "tokens array<string>, blocked boolean"))
    assert found == [(frozenset([*names, "h0:x"]), 0.5, 300)]
    mostly = [([*rng.sample(names, 30), "h0:x"], i % 2 == 0) for i in range(300)] + [(["h0:y"], False) for _ in range(300)]
    assert (frozenset(["h0:x"]), 0.5, 300) in url_rules.mine(spark.createDataFrame(mostly, "tokens array<string>, blocked boolean"))


def test_listed_verdicts_teach(spark):
    pages = [(i, f"http://{'a' if i % 3 else 'b'}.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(300)] + [(1000 + i, f"http://c.net/{'de' if i % 2 else 'fr'}/{i}") for i in range(10)]
    out = url_rules.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), rules=url_rules.RULES)
    assert {r["page_id"]: r["verdict"] for r in out.where("rule is null").collect()} == {1000 + i: "block" if i % 2 else "allow" for i in range(10)}


def test_url_rules_held_out(spark):
    """Rules from one half of planted pages find the blocked ones of the other half, and few others."""
    rng, rows = random.Random(5), []
    for i in range(4000):
        bad = rng.random() < 0.2
        both = bad or rng.random() < 0.02
        lone = rng.choice([["p0:shop"], ["p1:sale"], []])
        rows.append((i % 2, [f"h0:{rng.choice(['org', 'net'])}", *(["p0:shop", "p1:sale"] if both else lone), f"p2:{rng.randrange(50)}"], bad != (rng.random() < 0.03)))
    pages = spark.createDataFrame(rows, "half int, tokens array<string>, blocked boolean").cache()
    found = url_rules.measure(pages.where("half = 0"), pages.where("half = 1"))
    asked = [(t, b) for h, t, b in rows if h == 1]
    fired = [b for t, b in asked if {"p0:shop", "p1:sale"} <= set(t)]
    assert found["pages"] == len(asked) and found["blocked"] == sum(b for _, b in asked) and found["rules"] >= 1
    assert found["fired"] >= len(fired) and found["both"] >= 0.8 * found["blocked"] and found["both"] >= 0.8 * found["fired"]
    assert url_rules.measure(pages.where("half = 2"), pages.where("half = 1"))["fired"] == 0


# 2: text density

PAGES = {
    "<html><head><title>t</title></head><body><nav><a href=1>Menu</a></nav><article><h1>Head &amp; line</h1><p><b>First.<br><p>Second\n  one.</article><footer>&copy; x</footer></body></html>": "Head & line\n\nFirst.\n\nSecond one.",
    '<body><div id="header">Site</div><div class="cookie-notice">We use cookies</div><div class="content"><h2>Title</h2><p>Some words that make a paragraph, with a <a href="y">link</a> in it.</p><ul><li>one<li>two</ul></div><div class="sidebar"><ul><li><a>a</a></ul></div><div id="comments"><p>A reader says much more than the article itself does, on and on and on.</p></div></body>': "Title\n\nSome words that make a paragraph, with a link in it.\n\none\n\ntwo",
    "<main><p>Text<form>Name <input></form><script>var x = '</p>';</script><!-- note --><style>p{}</style><p>more &lt;b&gt; &#233; &nbsp;end</main>": "Text\n\nmore <b> é end",
    "<div><ul><li><a href=1>A</a><li><a href=2>B</a><li><a href=3>C</a></ul></div><div><p>Body of the page, in one sentence of some length.</p><p>And another one that follows it.</p></div>": "Body of the page, in one sentence of some length.\n\nAnd another one that follows it.",
    "": "", "<p></p>": "", "plain": "plain", "<div" * 50: "", "<b>" * 3000 + "deep": "deep",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_density.extract(page) == PAGES[page]


def naive_density(node, ratio):
    """(characters, tags, link characters, link tags, blocks' density sum, density) of a node, by plain recursion."""
    chars = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
    tags, links, link_tags, total = 1, 0, 0, 0.0
    for k in node.kids:
        if not isinstance(k, str) and not k.skip:
            c, n, lc, lt, inner, own = naive_density(k, ratio)
            chars, tags, links, link_tags = chars + c, tags + n, links + lc, link_tags + lt
            total += own if k.tag in html_density.BLOCK else inner
    if node.tag == "a":
        links, link_tags = chars, tags
    if not chars:
        return chars, tags, links, link_tags, total, 0.0
    base = np.log(chars / max(chars - links, 1) * max(links, 1) + ratio * chars + np.e)
    return chars, tags, links, link_tags, total, chars / tags * np.log(max(chars / max(links, 1) * tags / max(link_tags, 1), 1.0) + 1e-9) / np.log(base)


def made_up_page(rng):
    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{prose(rng, rng.randrange(1, 30))} <a href=x>{prose(rng, rng.randrange(3))}</a> <b>{prose(rng, 2)}</b></p>"
        return f"<{(t := rng.choice(['div', 'section', 'ul']))}>{''.join(block(depth - 1) for _ in range(rng.randrange(1, 5)))}</{t}>"

    return f"<body><nav>x</nav>{''.join(block(4) for _ in range(rng.randrange(1, 4)))}</body>"


@pytest.mark.parametrize("seed", range(20))
def test_density_sums(seed):
    root = html_density.parse(made_up_page(random.Random(seed)))
    order, ratio = html_density.measure(root)
    for x in order:
        want = naive_density(x, ratio)
        assert (x.chars, x.tags, x.link_chars, x.link_tags) == want[:4] and (x.total, x.density) == pytest.approx(want[4:])
    blocks = [x for x in order if x.tag in html_density.BLOCK and x.chars]
    best = max(blocks, key=lambda x: naive_density(x, ratio)[4])
    top, threshold = html_density.choose(order)
    assert top.total == pytest.approx(naive_density(best, ratio)[4])
    path = [x for x in order if x is top or top.depth > x.depth and x.tag == "body" or any(y is x for y in ancestors(top))]
    assert threshold == pytest.approx(min(naive_density(x, ratio)[5] for x in path if x.tag != "html"))


def ancestors(x):
    while x.parent is not None:
        x = x.parent
        yield x


def test_names_do_not_decide():
    """The same text without the article's tag and the advert's class, or with misleading names."""
    rng = random.Random(8)
    for words in (1, 4, 20, 300):
        body = "".join(f"<p>{prose(rng, words)}</p>" for _ in range(3))
        page = f'<body><nav><a href=1>Menu</a></nav><div class="ad">{prose(rng, 9)}</div><article><h1>{prose(rng, 5)}</h1>{body}</article><footer>x</footer></body>'
        want = html_density.extract(page)
        assert want.count("\n\n") == 3
        for old, new in (("article", "div"), ('class="ad"', ""), ("<article", '<article class="widget-content"'), ("<article", '<article id="discussion search"')):
            assert html_density.extract(page.replace(old, new)) == want
        assert html_density.extract(page.replace("article", "div").replace('class="ad"', "")) == want


def test_nothing_else_is_dropped():
    two = "<article><h1>A</h1><p>First text is here, quite long as it is.</p></article><article><h1>B</h1><p>Second.</p></article>"
    assert html_density.extract(f"<body>{two}</body>") == "A\n\nFirst text is here, quite long as it is.\n\nB\n\nSecond."
    inside = '<section class="social history"><p>A history of society, in words.</p></section><div class="alert"><p>An alert that is part of it.</p></div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul>'
    got = html_density.extract(f'<body><div class="widget-content"><h2>T</h2><p>Some text of the article, first.</p>{inside}</div></body>')
    assert got == "T\n\nSome text of the article, first.\n\nA history of society, in words.\n\nAn alert that is part of it.\n\none\n\ntwo\n\nthree"
    ad = '<article><p>Some text of the article, first.</p><div class="ad">Buy it</div><div class="related"><a>Other</a></div><p>Some text of the article, second.</p></article>'
    assert html_density.extract(ad) == "Some text of the article, first.\n\nSome text of the article, second."


DEEP = ["<b>" * 200_000, "<b>" * 5_000 + "</i>" * 200_000, "<div>" * 100_000 + "x" + "</span>" * 100_000, "<div" * 200_000, '<a "' * 100_000, "<i><table><tr><td>" + "<b>" * 100_000 + "</i>" * 100_000, "<div class='widget'><p>x</p>" * 20_000]


@pytest.mark.parametrize("page", DEEP, ids=range(len(DEEP)))
def test_deep_pages_take_linear_time(page):
    import time

    begin = time.process_time()
    html_density.extract(page)
    assert time.process_time() - begin < 8  # two seconds here when nothing else runs; quadratic time is minutes


def test_extract_pages(spark):
    rows = [(i, "u", p) for i, p in enumerate(PAGES)] + [(None, None, None), (0, "u", next(iter(PAGES))), (99, "u", "<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>")]
    out = html_density.extract_pages(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["page_id"]: r["text"] for r in out}[99] == "\n\n".join(["word & more"] * 50_000) and [r["text"] for r in out if r["page_id"] is None] == [""]
    assert html_density.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


# 3: packing


def test_first_fit_decreasing():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    got, room, want = packing.first_fit_decreasing(np.array(sizes), 100), [], {}
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        room[k:] = room[k:] or [100]
        room[k] -= sizes[i]
        want[i] = k
    assert got.tolist() == [want[i] for i in range(300)]
    assert packing.first_fit_decreasing(np.zeros(0, np.int64), 4).size == 0


def test_pack(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    extra = spark.createDataFrame([(None, "null id"), (None, "null id"), (2**60 + 1, "large id <|endoftext|>")], "doc_id long, text string")
    rows = packing.pack(clashing(docs.union(extra)), with_ids=True, group=40).collect()
    ids, used = {}, {}
    for r in rows:
        got = np.frombuffer(r["ids"], "<u4")
        assert len(got) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids.setdefault(r["doc_id"], []).append((r["start"], got, r["doc_tokens"]))
    for doc, text in [*corpus, (2**60 + 1, "large id <|endoftext|>")]:
        parts = sorted(ids.pop(doc), key=lambda p: p[0])
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.concatenate([p[1] for p in parts]).tolist() == want and all(p[2] == len(want) for p in parts)
        assert [p[0] for p in parts] == np.cumsum([0, *(len(p[1]) for p in parts[:-1])]).tolist()
    assert not ids and sum(r["doc_id"] is None for r in rows) == 2
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_packed_ids_are_those_of_the_plain_call(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quillmeter.llm import queries

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["large id <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n c", "<|endoftext |> <|EndOfText|>", "é <|endoftext|>" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op3_pack(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        rows = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out.collect()}
        for doc, text in enumerate(texts):
            ids = [*t.encode(text, add_special_tokens=False).ids, 0]
            for start in range(0, len(ids), 1024):
                piece = np.array(ids[start : start + 1024], "<u4")
                assert rows.pop((doc, start)) == (len(piece), zlib.crc32(piece.tobytes()), len(ids))
        assert not rows


# 4: decontamination


@pytest.mark.parametrize("seed", range(3))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 5, 400)
    text[50:90] = text[200:240]
    index = decontaminate.FMIndex(text, 6)
    for n in (1, 3, 13):
        patterns = np.stack([text[i : i + n] for i in range(0, 380, 7)] + [np.full(n, 5)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(400 - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [(1, "w001 w002 w003"), (2, None), (3, ""), (4, "..."), (5, "Zwei WÖRTER"), (5, "Zwei WÖRTER"), (10, "one")]


@pytest.mark.parametrize("blocks", [False, True])
def test_contamination(spark, docs, corpus, blocks):
    long = [t for _, t in corpus if t and len(t) > 1500]
    items = ITEMS + [(20 + i, " ".join(t.split()[3:40])) for i, t in enumerate(long[:5])] + [(None, "null item")]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    out = decontaminate.find_contamination(clashing(docs), bench, block_bytes=60 if blocks else 1 << 20, shard_symbols=300).collect()
    want = contamination(corpus, [("" if i is None else i, t) for i, t in items])
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out} == want
    texts = dict(corpus)
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and r["text"] == texts[r["doc_id"]]
        left = decontaminate._WORD.findall((decontaminate.cut(r["text"], r["spans"]) or "").translate(decontaminate._LOWER))
        assert len(left) == r["n_words"] - r["n_hit"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(spark.createDataFrame([], EMPTY), bench).count() == 0


# 5: vectors


def brute_vectors(rows):
    good = {}
    for i, (k, v) in enumerate(rows):
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= 0.95]
    group = components(range(len(rows)), links)
    count = Counter(x for e in links for x in e)
    low = {}
    for i in good:
        low[group[i]] = min(low.get(group[i], rows[i][0]), rows[i][0])
    return sorted(((k, count[i], low[group[i]] if i in good else k, i not in good and k is not None or i in good and low[group[i]] == k) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_dedup, "IN_CELL", 8)
    rng, rows = np.random.default_rng(2), []
    for k in range(150):
        v = rng.normal(size=24)
        rows += [(1000 * k + j, (v + rng.normal(size=24) * s).astype(np.float32 if kind == "float" else float).tolist()) for j, s in enumerate([0, 0, 0.05, 0.2, 0.3][: 1 + k % 5])]
    hot = rng.normal(size=24)
    rows += [(500_000 + j, (hot + rng.normal(size=24) * 0.02).tolist() if j % 2 else hot.tolist()) for j in range(200)]
    rows = [(k, np.float32(v).tolist() if kind == "float" else v) for k, v in rows]
    rows += [(7, None), (8, []), (9, [0.0] * 24), (11, [1.0, None] * 12), (12, [float("nan")] * 24), (13, [float("inf")] + [0.0] * 23), (None, rows[0][1]), (14, [1.0]), (15, [2.0]), (16, [1.0, 2.0]), (17, [-0.0, 1.0]), (18, [0.0, 1.0]), (18, [5.0, 0.0])]
    out = vector_dedup.near_duplicates(clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)), block=64)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_vectors(rows)
    assert vector_dedup.near_duplicates(spark.createDataFrame([], f"vec_id long, embedding array<{kind}>")).count() == 0


def test_recall_along_cluster_directions(spark, monkeypatch):
    """Large tables aren't searched as far as the threshold reaches; partners that differ towards the next cluster, which
    are the hardest to meet, are found all the same."""
    monkeypatch.setattr(vector_dedup, "IN_CELL", 40)
    rng = np.random.default_rng(12)
    centers = vector_dedup.unit(rng.normal(size=(12, 24)))
    rows = []
    for _ in range(1000):
        a, b = rng.choice(12, 2, replace=False)
        x = vector_dedup.unit((centers[a] + 0.25 * rng.normal(size=24))[None])[0]
        towards = centers[b] - (centers[b] @ x) * x
        y = 0.955 * x + np.sqrt(1 - 0.955**2) * towards / np.sqrt(towards @ towards)
        rows += [x.tolist(), y.tolist()]
    u = vector_dedup.unit(np.array(rows))
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert all(got[i] <= n for i, n in enumerate(want.tolist())) and sum(got.values()) >= 0.98 * want.sum() and want.sum() >= 2000


# 6: pseudo-likelihood


def test_pseudo_likelihood(spark, docs, corpus):
    out = {r["doc_id"]: r for r in pseudo_lm.score_documents(clashing(docs)).collect()}
    assert len(out) == len(corpus)
    for doc, text in corpus:
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))
        assert out[doc]["n_words"] == n and (out[doc]["score"] is None) == (n == 0) and (out[doc]["log_likelihood"] < 0) == (n > 0)
    assert out[0]["score"] == pytest.approx(out[69]["score"], rel=1e-5)  # a repeated text
    empty = spark.createDataFrame([], EMPTY)
    assert pseudo_lm.score_documents(empty).count() == 0
    assert pseudo_lm.score_documents(spark.createDataFrame([(1, None)], EMPTY)).first()["log_likelihood"] == 0


def naive_log_likelihood(net, voc, spelt, text):
    """The score of a text by loops over its words and the whole vocabulary."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    known = {h: i for h, i in zip(voc.hashes.tolist(), voc.order.tolist(), strict=True)}
    symbol = [known.get(int(_text.hashed_words([w], _text.ALNUM)[0][0]), voc.words) for w in words]
    p, total = net.p, 0.0
    for i, s in enumerate(symbol):
        h = p["bias"].astype(float)
        for j, k in enumerate([-3, -2, -1, 1, 2, 3]):
            h = h + p["rows"][symbol[i + k] if 0 <= i + k < len(symbol) else voc.words + 1].astype(float) @ p["mix"][j]
        h = np.tanh(h)
        for step in range(voc.tree.first[s], voc.tree.first[s + 1]):
            *w, bias = p["node"][voc.tree.node[step]].astype(float)
            z = h @ w + bias
            total -= np.log(1 + np.exp(-z if voc.tree.right[step] else z))
        if s == voc.words:
            marks = [256, *words[i], 256]
            total += sum(spelt[x * 257 + y] for x, y in zip(marks, marks[1:], strict=False))
    return total


def ordered_text(rng, words):
    """Words of which each of a few follows another one."""
    out, at = [], 0
    for _ in range(words):
        at = (at * 3 + rng.choice([1, 2])) % 97
        out.append(f"w{at}" if rng.random() > 0.02 else f"rare{rng.randrange(10**6)}")
    return " ".join(out)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, ordered_text(rng, 300)) for i in range(120)], EMPTY).repartition(2).cache()
    voc = pseudo_lm.vocabulary(docs, Store(spark, "lm"))
    return voc, *pseudo_lm.train(docs, voc, rounds=4, share=0.25), rng


def test_pseudo_likelihood_by_loops(trained):
    voc, net, spelt, rng = trained
    for text in (ordered_text(rng, 40), "w1", "unseen w5 Unseen", ordered_text(rng, 3)):
        words, got = pseudo_lm.score_texts(voc, net, spelt, net.tables(), [text.encode()])
        assert got[0] == pytest.approx(naive_log_likelihood(net, voc, spelt, text.encode()), rel=1e-4) and words[0] == len(text.split())


def test_pseudo_likelihood_is_a_distribution(trained):
    voc, net, spelt, _ = trained
    seq, at = np.random.default_rng(0).integers(0, voc.words + 1, 40), np.array([10, 20])
    total = np.zeros(2)
    for s in range(voc.words + 1):
        other = seq.copy()
        other[at] = s
        total += np.exp(net.log_likelihood(net.tables(), other, at))
    assert total == pytest.approx([1, 1], abs=1e-4)
    assert np.exp(spelt).reshape(257, 257).sum(axis=1) == pytest.approx(np.ones(257))


def test_pseudo_likelihood_walks(trained):
    """The tree is one of least cost, also for one symbol; an untrained network without context gives frequencies."""
    counts = np.array([50.0, 20, 10, 10, 5, 3, 1, 0.5])
    tree, heap = pseudo_lm.Tree(counts), counts.tolist()
    heapq.heapify(heap)
    cost = 0.0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (np.diff(tree.first) * counts).sum() == pytest.approx(cost)
    net = pseudo_lm.Network.fresh(tree)
    net.p["node"][:, :-1] = 0
    seq = np.concatenate([[8] * 3, np.arange(8), [8] * 3])
    assert np.exp(net.log_likelihood(net.tables(), seq, np.arange(3, 11))) == pytest.approx(counts / counts.sum(), rel=1e-4)
    one = pseudo_lm.Network.fresh(pseudo_lm.Tree(np.array([3.0])))
    one.step(np.array([1, 1, 1, 0, 1, 1, 1]), np.array([3]), {})
    assert one.log_likelihood(one.tables(), np.array([1, 1, 1, 0, 1, 1, 1]), np.array([3])).tolist() == [0]


def test_pseudo_likelihood_gradients():
    """One step moves every parameter against the gradient that finite differences give; others stay."""
    rng = np.random.default_rng(4)
    tree = pseudo_lm.Tree(1000 / np.arange(1, 301))
    seq, at = rng.integers(0, 300, 60), np.arange(10, 50)
    for name in ("rows", "node", "mix", "bias"):
        net = pseudo_lm.Network.fresh(tree)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        moved, state = net.copy(), {}
        moved.step(seq, at, state)
        change = moved.p[name] - net.p[name]
        assert name in ("mix", "bias") or ((np.abs(change).max(axis=1) > 0) == (state[name][1] > 0)).all()
        large = np.argwhere(np.abs(change) >= np.quantile(np.abs(change), 0.9))
        for place in map(tuple, large[rng.integers(len(large), size=12)]):
            both = []
            for e in (1e-3, -1e-3):
                other = net.copy()
                other.p[name][place] += e
                both.append(other.log_likelihood(other.tables(), seq, at).mean())
            assert np.sign(both[0] - both[1]) == np.sign(change[place])


def test_pseudo_likelihood_step_by_loops():
    """A step moves all rows as loops over positions and steps of their walks do."""
    rng = np.random.default_rng(8)
    tree, state = pseudo_lm.Tree(3000 / np.arange(1, 2001)), {}
    net = pseudo_lm.Network.fresh(tree)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq, at, p = np.minimum(rng.zipf(1.3, 400), 2000) - 1, np.arange(10, 390), net.copy().p
    net.step(seq, at, state)
    grad, seen = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros(len(p[k]), int) for k in net.BY_ROW}
    for i in at:
        near = [seq[i + k] for k in (-3, -2, -1, 1, 2, 3)]
        h = np.append(np.tanh(p["bias"] + sum(p["rows"][s] @ m for s, m in zip(near, p["mix"], strict=True))), 1)
        back = np.zeros(len(h))
        for k in range(tree.first[seq[i]], tree.first[seq[i] + 1]):
            v = tree.node[k]
            g = (1 / (1 + np.exp(-h @ p["node"][v])) - tree.right[k]) / len(at)
            grad["node"][v] += g * h
            back += g * p["node"][v]
            seen["node"][v] += 1
        back = back[:-1] * (1 - h[:-1] ** 2)
        for s, m in zip(near, p["mix"], strict=True):
            grad["rows"][s] += m @ back
            seen["rows"][s] += 1
    for name in net.BY_ROW:
        want = p[name] - 0.05 * grad[name] / np.sqrt(1e-8 + (grad[name] ** 2).mean(axis=1))[:, None]
        assert net.p[name] == pytest.approx(want, abs=1e-6) and state[name][1].tolist() == seen[name].tolist()


def test_pseudo_likelihood_work(monkeypatch):
    """A step and a score take one exponential for each step of the words' walks, none for other nodes."""

    class Counted:
        found = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x):
            self.found += np.size(x)
            return np.exp(x)

    tree, rng, counted = pseudo_lm.Tree(9000 / np.arange(1, 3001)), np.random.default_rng(5), Counted()
    net, seq, at = pseudo_lm.Network.fresh(tree), rng.integers(0, 3000, 600), np.arange(3, 597)
    walks = int((tree.first[seq[at] + 1] - tree.first[seq[at]]).sum())
    monkeypatch.setattr(pseudo_lm, "np", counted)
    net.step(seq, at, {})
    assert counted.found == walks
    net.log_likelihood(net.tables(), seq, at)
    assert counted.found == 2 * walks


def test_pseudo_likelihood_means():
    """Rows are averaged by how often tasks touched them, in groups as at once."""
    one = pseudo_lm._row("node", 2, 0, [1, 3], [1, 2], np.array([[1.0, 2], [3, 4]])).to_pandas()
    two = pseudo_lm._row("node", 2, 65, [3], [6], np.array([[7.0, 8]])).to_pandas()
    out = pseudo_lm._mean(pd.concat([pseudo_lm._mean(one), pseudo_lm._mean(two)]))
    at, n, p = pseudo_lm._unrow(out.to_dict("records")[0])
    assert at.tolist() == [1, 3] and n.tolist() == [1, 8] and p.tolist() == [[1, 2], [6, 7]]


def test_pseudo_likelihood_knows_order(trained):
    """On text of a known order: far above the words' frequencies, and natural order above a shuffled one."""
    voc, net, spelt, rng = trained
    score = lambda t: pseudo_lm.score_texts(voc, net, spelt, net.tables(), [t.encode()])[1][0] / len(t.split())
    alone = np.log(voc.counts / voc.counts.sum())
    better = 0
    for _ in range(40):
        text = ordered_text(rng, 60)
        shuffled = text.split()
        rng.shuffle(shuffled)
        better += score(text) > score(" ".join(shuffled))
    symbols = pseudo_lm.Text(voc, [text.encode()])
    plain = alone[symbols.seq[symbols.at]].mean()
    known = net.log_likelihood(net.tables(), symbols.seq, symbols.at).mean()
    assert better == 40 and known > plain + 1.5


def test_pseudo_likelihood_grows(spark):
    """Every word that occurs often enough is a symbol, however many there are; the others have probabilities of their own."""
    many = spark.range(3000).selectExpr("id as doc_id", "concat('w', id % 2500, ' w', (id + 1) % 2500, ' w', (id * 7) % 2500) as text")
    assert pseudo_lm.vocabulary(many, Store(spark, "lm"), least=2).words == 2500
    assert pseudo_lm.room(16e12) > 5 * pseudo_lm.room(10e9) > 25 * pseudo_lm.room(4e6)
    few = spark.createDataFrame([(1, "seen once"), (2, "only qqqqqqqq")], EMPTY)
    scores = {r["doc_id"]: r["score"] for r in pseudo_lm.score_documents(few).collect()}
    assert scores[1] != scores[2] and all(s < 0 for s in scores.values())


def test_pseudo_likelihood_room(spark, monkeypatch):
    """Beyond the room the frequency rises: words of one frequency are symbols together or not at all."""
    docs = spark.range(1, 200).selectExpr("id as doc_id", "array_join(array_repeat(concat('w', id div 2), cast(id div 2 as int)), ' ') as text")
    count = {k: 2 * k for k in range(1, 100)}
    for most in (0, 1, 7, 60, 98, 1000):
        monkeypatch.setattr(pseudo_lm, "room", lambda words, most=most: most)
        voc = pseudo_lm.vocabulary(docs, Store(spark, "lm"), least=5)
        assert sorted(voc.counts[:-1].tolist()) == sorted(sorted((n for n in count.values() if n >= 5), reverse=True)[:most])
        assert voc.counts.sum() == sum(count.values())


# 7: archives


def test_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}?ü \r\n", f"<p>page {i % 7} é</p>" * (30 if i % 3 else 1)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "u", rows[1][2]), (5, "u", rows[5][2]), (200, "u", "z" * 300_000), (102, "u", "a" * 99), (103, "u", "a" * 99), (104, "u", "b" * 100), (105, "u", "b" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc_zstd.write_archives(clashing(df), Store(spark, "t"), archive_bytes=4000)
    got = sorted(((r["record_key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_zstd.read_archives(archives).collect()), key=str)
    want, first = [], {}
    for k, _, body in rows:
        raw = (body or "").encode()
        if len(raw) >= 100 and k is not None:
            first[raw] = min(first.get(raw, k), k)
    for k, _, body in rows:
        raw = (body or "").encode()
        again = raw in first and first[raw] != k
        want.append((None if k is None else str(k), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(first[raw]) if again else None))
    assert got == sorted(want, key=str)
    assert {r["payload"].decode() for r in warc_zstd.read_archives(archives).where("record_type = 'response'").collect()} == {b or "" for _, _, b in rows}
    put = warc_zstd.export(archives, f"file://{tmp_path}/w").collect()
    assert len(put) > 5
    for name, size in put:
        content = (tmp_path / "w" / name).read_bytes()
        assert len(content) == size and content[:4] == b"\x5d\x2a\x4d\x18" and list(warc_zstd.parse_archive(content))
    broken = archives.withColumn("content", F.expr("overlay(content placing X'00000000' from 1)"))
    with pytest.raises(Exception, match="not a dictionary-compressed"):
        warc_zstd.read_archives(broken).count()
    assert warc_zstd.read_archives(warc_zstd.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), Store(spark, "t"))).count() == 0


# 8: toxicity


def test_gradients():
    rng, net = np.random.default_rng(1), toxicity.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k != "rows"}
    x, active, y, weight = rng.normal(size=(5, 3, toxicity.DIM)), [3, 3, 2, 1, 1], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = net.forward(x, active)
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).mean())

    grad, dx = net.gradients(x, active, y, weight)
    for name in ("wf", "ub", "cf", "att", "out", "bias"):
        p = net.p[name]
        for i in list(np.ndindex(p.shape))[:: max(1, p.size // 6)]:
            p[i] += 1e-4
            up = loss()
            p[i] -= 2e-4
            down = loss()
            p[i] += 1e-4
            assert grad[name][i] == pytest.approx((up - down) / 2e-4, abs=2e-4)
    x[1, 0, 2] += 1e-4
    up = loss()
    x[1, 0, 2] -= 2e-4
    assert dx[1, 0, 2] == pytest.approx((up - loss()) / 2e-4, abs=2e-4)


def test_windows():
    _, start, length = toxicity.windows(np.array([0, 0, 10, 74, 139, 400]))
    covered = [set(range(s, s + n)) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
    assert set().union(*covered) == set(range(400)) and all(0 < len(c) <= toxicity.WINDOW for c in covered)


def test_toxicity(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        words = prose(rng, rng.choice([5, 60, 300])).split()
        bad = i % 4 == 0
        for _ in range(2 + len(words) // 100 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vile", "hatefulism", "hatefuled", "nasty!!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (None, "vile nasty"), (9002, prose(rng, 40_000)), (9003, rows[0][1])]
    labels += [(None, 1), (3, None), (77777, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), clashing(spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score_documents(clashing(docs), marks).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, r in out.items())
    held = [i for i in range(600) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert out[9000]["score"] == out[9001]["score"] and out[9003]["score"] == pytest.approx(out[0]["score"], abs=1e-5) and out[9002]["predicted"] == 0
    assert toxicity.score_documents(docs, marks.limit(0)).where("score > 0").count() == 0
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0
    assert toxicity.held_out(F.col("x")) is not None


def test_toxicity_keeps_the_share_beyond_the_cap(spark, monkeypatch):
    """Where a class is capped, scores stand for the share among all labelled rows, as they do below the cap."""
    rng, rows, labels = random.Random(10), [], []
    for i in range(2400):
        # One word in each document; "odd" is toxic in one of ten.
        rows.append((i, "odd" if i % 2 else "plain"))
        labels.append((i, int(i % 2 == 1 and rng.random() < 0.1)))
    labels += [(100_000 + i, 1) for i in range(500)]  # of no document
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    known = [y for i, y in labels if i < 2400 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert toxicity.toxic_share(docs, marks, "doc_id", toxicity.held_out) == pytest.approx(sum(known) / len(known))
    marks = marks.where("doc_id < 100000")
    score = lambda: {r["text"]: r["score"] for r in toxicity.score_documents(docs, marks).select("text", "score").distinct().collect()}
    whole = score()
    monkeypatch.setattr(toxicity, "SAMPLE", sum(known))
    capped = score()
    assert whole["odd"] < 0.3 and capped["odd"] < 0.3 and abs(capped["odd"] - whole["odd"]) < 0.1


# 9: repeated bytes


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, docs, corpus, hot):
    rows = [(i, t) for i, t in corpus if len(t or "") < 100_000]
    out = repeat_bytes.remove_repeats(clashing(docs.where("length(text) < 100000 or text is null")), with_text=True, hot=2 if hot else 5000, piece=3000).collect()
    want = repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == want
    for r in out:
        text = dict(rows)[r["doc_id"]]
        assert r["kept"] == text if not r["n_removed"] else len(r["kept"].encode()) <= r["n_bytes"] - r["n_removed"]
    assert repeat_bytes.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    twins = spark.createDataFrame([(None, "q" * 199), (None, "q" * 199), (1, None)], EMPTY)
    assert repeat_bytes.remove_repeats(twins).agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_of_a_short_passage_everywhere(spark, monkeypatch):
    """One passage of 203 bytes between different texts: no task gets a group over the bound, and the result is the same."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklm ") for _ in range(n))
    passage = noise(203)
    rows = [(i, noise(150) + passage + noise(150)) for i in range(150)] + [(900, passage[2:] + passage), (901, noise(500))]
    whole, largest = repeat_bytes._resolved, []

    def watched(records):
        largest.append(records.groupBy("digit").count().agg(F.max("count")).first()[0] or 0)
        return whole(records)

    monkeypatch.setattr(repeat_bytes, "_resolved", watched)
    out = repeat_bytes.remove_repeats(spark.createDataFrame(rows, EMPTY).repartition(3), hot=20).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == repeats(rows)
    assert max(largest) <= 20


def test_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij \n") for _ in range(1_300_000))
    rows = [(1, long), (2, "x" + long[700_000:700_400] + "y"), (3, long[:150])]
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeat_bytes.remove_repeats(spark.createDataFrame(rows, EMPTY)).collect()}
    assert out == {1: (400, 1), 2: (400, 1), 3: (0, 0)}


# 10: Jaccard join


@pytest.mark.parametrize("tile", [20_000, 3])
def test_jaccard(spark, docs, corpus, tile, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    out = jaccard_join.near_duplicates(clashing(docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == jaccard(corpus) and len(out) == len(corpus)


def family(rng, size):
    """Different texts around one template, near the threshold on both sides, so that all meet in the same tiles; and some
    that belong to none."""
    base = [f"t{i}" for i in range(300)]
    out = []
    for k in range(size):
        words = list(base)
        for _ in range(k % 12):
            at = rng.randrange(300)
            words[at : at + 1 + k % 3] = [f"x{rng.randrange(10**6)}"]
        out.append((k, " ".join(words[: 300 - (k % 5) * 3])))
    return out + [(1000 + i, prose(rng, 50)) for i in range(10)]


@pytest.mark.parametrize("tile", [10, 40])
def test_jaccard_hot_tiles(spark, tile, monkeypatch):
    rows = family(random.Random(11), 150)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    sizes, whole = [], jaccard_join._blocks_of_components

    def watched(df, weight, limit, store, name):
        out = whole(df, weight, limit, store, name)
        sizes.append(max([r["w"] for r in out.groupBy("cell", "side").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).where("n > 1").collect()], default=0) / limit)
        return out

    monkeypatch.setattr(jaccard_join, "_blocks_of_components", watched)
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, EMPTY).repartition(3)).collect()
    want = jaccard(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert len({c for _, c in want.values()}) > 15 and len(sizes) == 3 and max(sizes) <= 3  # blocks are dealt out by hash


def test_jaccard_cases(spark):
    base = " ".join(f"v{i}" for i in range(24))  # 20 shingles
    cut = lambda n: " ".join(f"v{i}" for i in range(n))
    rows = [(5, base), (3, cut(19)), (8, cut(18)), (None, base), (None, None), (9, "a b"), (4, "A  b"), (6, "b a"), (5, "other words here"), (2, "other words here"), (7, ""), (1, "  ")]
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, EMPTY)).collect()), key=str)
    # 15 of 20 shingles link; rows of one key are one document.
    want = [(5, 20, 2), (3, 15, 2), (8, 14, 2), (None, 20, None), (None, 0, None), (9, 1, 4), (4, 1, 4), (6, 1, 6), (5, 1, 2), (2, 1, 2), (7, 0, 7), (1, 0, 1)]
    assert out == sorted(want, key=str)
    assert jaccard_join.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (10, 250, 300, 1000, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in (a, b))
        if len(x) == len(y):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def page_with(inside):
    text = "<p>" + "Patients were treated over several weeks in two groups of equal size. " * 4 + "</p>"
    return f"<body><article><h1>Study</h1>{text}{inside}{text}</article></body>"


CONSENT = "Patients gave informed consent before they took part in it, and all of them were told that they could leave at any time without giving reasons."


@pytest.mark.parametrize("inside, want", [
    (f'<section id="consent"><h2>Consent</h2><p>{CONSENT}</p></section>', ["Consent", CONSENT]),
    (f'<section class="notice"><h2>Notice</h2><p>{CONSENT}</p></section>', ["Notice", CONSENT]),
    (f'<p class="subscribe">{CONSENT}</p>', [CONSENT]),
    ('<div class="notice">We use cookies.</div>', []),
    (f'<div class="comments"><h2>Comments</h2><p>{CONSENT}</p></div>', []),
    (f"""<div data-x="{'a>b ' * 4000}"><p>{CONSENT}</p></div>""", [CONSENT]),
    ("<div " + " ".join(f"a{i}='x>{i}'" for i in range(80)) + f"><p>{CONSENT}</p></div>", [CONSENT]),
])
def test_names_and_long_attributes(inside, want):
    text = "Patients were treated over several weeks in two groups of equal size. " * 4
    assert html_density.extract(page_with(inside)) == "\n\n".join(["Study", text.strip(), *want, text.strip()])


@pytest.mark.parametrize("page", ['<a b="' * 10**6, "<a b='" * 10**5 + ">", '<a "' * 10**6, "= " * 10**6, "<a =" + " " * 10**6, """<p x="'>""" * 20_000, """<p x='">""" * 20_000])
def test_open_quotes_take_linear_time(page):
    began = time.process_time()
    html_density.extract(page)
    assert time.process_time() - began < 5


def test_many_hits_in_blocks(spark):
    """A document that is hit whole, by a test set in many blocks, as by one."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    items = [(f"i{k:03d}", " ".join(words[a : a + 700])) for k, a in enumerate(range(0, 50_000, 690))]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:40], *["x"] * 30, *words[100:130]])), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    began = time.time()
    found = [{r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["spans"], r["contaminated"]) for r in decontaminate.find_contamination(docs, bench, block_bytes=size).collect()} for size in (1 << 24, 40_000)]
    assert found[0] == found[1] and found[0][1][1] == 50_000 and len(found[0][2][3]) == 2
    assert time.time() - began < 90


def score_by_loops(net, text):
    """A text's score, word by word and step by step: gated units from both sides, attention, the most toxic window."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    p, hidden = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    inputs = [p["rows"][toxicity.words([w.encode()])[0][0]].mean(axis=0) for w in found]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    best, start = None, 0
    while found:
        window = inputs[start : start + toxicity.WINDOW]
        states = np.zeros((len(window), 2 * hidden))
        for d, at, order in (("f", 0, range(len(window))), ("b", hidden, reversed(range(len(window))))):
            h = np.zeros(hidden)
            for t in order:
                g, s = window[t] @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
                z, r = sigmoid(g[:hidden] + s[:hidden]), sigmoid(g[hidden : 2 * hidden] + s[hidden : 2 * hidden])
                c = np.tanh(g[2 * hidden :] + r * s[2 * hidden :])
                h = states[t, at : at + hidden] = (1 - z) * c + z * h
        weights = np.exp(states @ p["att"])
        logit = float((weights / weights.sum()) @ states @ p["out"] + p["bias"][0])
        best = logit if best is None else max(best, logit)
        if start + toxicity.WINDOW >= len(found):
            break
        start += toxicity.STRIDE
    return sigmoid(float(p["bias"][0]) if best is None else best)


def test_scores_by_loops():
    rng = random.Random(12)
    texts = [prose(rng, 30) + " vile thing" * (k % 2) for k in range(200)]
    net = toxicity.fit(texts, np.array([k % 2 == 1 for k in range(200)]))
    odd = [None, "", " ... ", "ÀÉ vile", "vile", prose(rng, toxicity.WINDOW), prose(rng, toxicity.WINDOW + 1), prose(rng, 500) + " vile thing", "x" * 5000, "日本 vile 日本", *texts[:6]]
    assert toxicity.score_texts(net, odd) == pytest.approx([score_by_loops(net, t) for t in odd], abs=1e-4)
