"""Brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def contamination(docs, items, window=13):
    """{doc: (n_words, n_hit, sorted items, contaminated)}"""
    patterns = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            patterns[tuple(w[i : i + n])].add(str(item))
    sizes = {len(p) for p in patterns}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := patterns.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out[doc] = len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)
    return out


def jaccard(docs):
    """{doc: (shingles, component)}"""
    sets = {}
    for doc, text in docs:
        w = NON_SPACE.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    held, both = defaultdict(list), defaultdict(int)
    for doc, s in sets.items():
        for g in s:
            held[g].append(doc)
    for group in held.values():
        for pair in itertools.combinations(sorted(group), 2):
            both[pair] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def repeats(docs, window=200):
    """{doc: (bytes, removed, spans, sha256 of the rest)}"""
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen, twice = set(), set()
    for _, b in raw:
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            (twice if s in seen else seen).add(s)
    out = {}
    for d, b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if b[p : p + window] in twice:
                cover[p : p + window] = b"\1" * window
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[d] = len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()
    return out
