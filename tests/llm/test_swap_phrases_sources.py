"""Swap packing, collocations and source divergence against brute force, and on odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER

from quillmeter.llm import collocations, source_divergence, swap_packing

TABLE = "doc_id long, text string, lang string, source string"
#: Names that the operators give or use themselves, as extra columns.
CLASH = "n docs term counts sizes size v p q value rank part item words phrase a l r score cut side block cells bits grp piece start length ids whole copy key offset salt".split()


def prose(rng, words, vocabulary=60):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}{rng.choice(['', '', '', '', ',', '.', ' '])}" for _ in range(words))


def corpus(seed=5):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 5, 30, 120])), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "é3", None, ""])) for i in range(400)]
    rows += [(1000 + i, t, "en", "s1") for i, t in enumerate([None, "", " \t ", "ÀB ab́ ÀB, ÀB", "A\0b A\0b", "a\x0bb a\x85b", "...", "x" * 3000, rows[7][1], rows[7][1]])]
    rows += [(2000, "long word. " * 120_000, "long", "s"), (2001, None, "none", "s"), (2002, "", "none", "t"), (None, "w1 w2", "en", "s1"), (None, "w1 w2", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TABLE).repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)) if clash else df


def phrases(rows, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, found in f.items():
        cands = {g: a for g, a in found.items() if len(g) > 1 and a >= least}
        longest = Counter()
        for g, a in cands.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    longest[part] = max(longest[part], a)
        scored = []
        for g, a in cands.items():
            if longest[g] and 100 * longest[g] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (found[g[:k]] * found[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), found[g[:k]], found[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(scored)[:top], 1):
            out[lang, rank] = g.decode(), -a, left, right, n[lang], -s
    return out


@pytest.mark.parametrize("width, least, top", [(20, 10, 2000), (6, 10, 7), (3, 2, 2000)])
def test_collocations(spark, rows, width, least, top):
    """Any sketch gives the same, also one that lets everything through."""
    got = collocations.mine(frame(spark, rows), width=width, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()} == phrases(rows, least, 50, top)


def test_sketch_only_overestimates(rows):
    """Bits of every phrase that is frequent are set, however few cells there are, and rare ones go when there are many."""
    import pyarrow as pa

    docs = [pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * 50), "text": pa.array([r[1] for r in rows[50 * k : 50 * k + 50]])}) for k in range(6)]
    true = Counter()
    for batch in docs:
        for _, grams in collocations._grams(iter([batch])):
            for k in range(3):
                true.update(dict(zip(grams.phrases(k, np.arange(len(grams.counts[k]))).to_pylist(), grams.counts[k].tolist(), strict=True)))
    for width in (4, 18):
        blocks = [b for part in (docs[:2], docs[2:]) for b in collocations._sketch(width)(iter(part))]
        rows_ = sorted((n, c) for b in blocks for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        size = min(collocations.BLOCK, 1 << width)
        batch = pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows_], pa.int32()), "cells": pa.array([r[1] for r in rows_], pa.binary())})
        bits = np.zeros((2 << width) // 8, np.uint8)
        for b in collocations._merge(10, size)(iter([batch])):
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits[n * size // 8 :][: size // 8] = np.frombuffer(raw, np.uint8)
        left = set()
        for out in collocations._exact(width, type("Bits", (), {"value": bits.reshape(2, -1)}))(iter(docs)):
            left |= set(out.column(2).to_pylist())
        frequent = {p for p, n in true.items() if n >= 10}
        assert frequent <= left and (width < 18 or len(left) < len(frequent) + 20)


def test_collocations_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, by the score's own expression."""
    a, left, right = 9_000_000_000_000, 9_100_000_000_001, 9_000_000_000_003
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score("l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


def test_collocations_without_rows(spark, rows):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, None, None, None), (2, "a b", "x", "y")])).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(frame(spark, rows), least=300)


def divergence(rows, min_docs=30, top=50):
    langs = defaultdict(lambda: defaultdict(Counter))
    held = defaultdict(Counter)
    for _, text, lang, source in rows:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        langs[lang or ""][source or ""].update(w)
        held[lang or ""].update(set(w))
    out = set()
    for lang, by in langs.items():
        kept = [t for t, d in held[lang].items() if d >= min_docs]
        v = len(kept)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * v) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in by.items()}
        q = share(sum(by.values(), Counter()))
        for s in by:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in by if o != s], "term": [(p[s][t] - q[t], t) for t in kept if by[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("min_docs, top", [(30, 50), (3, 4), (1000, 50)])
@pytest.mark.parametrize("few", [True, False])
def test_divergence(spark, rows, min_docs, top, few, monkeypatch):
    monkeypatch.setattr(source_divergence, "SEGMENT", 1000)
    if not few:
        monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 1)
    got = source_divergence.audit(frame(spark, rows), min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == divergence(rows, min_docs, top)


def test_divergence_counts_in_parts(rows, monkeypatch):
    """What tasks hand on early adds up to the same."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"lang": pa.array([r[2] for r in part]), "source": pa.array([r[3] for r in part]), "text": pa.array([r[1] for r in part], pa.string())}) for part in (rows[:100], rows[100:300], rows[300:410])]

    def counted():
        out = Counter()
        for b in source_divergence._count(iter(batches)):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[lang, source, term, "n"] += n
                out[lang, source, term, "docs"] += docs
        return out

    whole = counted()
    monkeypatch.setattr(source_divergence, "HELD", 5)
    assert counted() == whole and len(whole) > 50


def test_divergence_of_large_counts(spark):
    for count, size in ((9_000_000_000_000, 9_000_000_000_007), (0, 10), (10**15, 10**15 + 10)):
        df = spark.createDataFrame([(count, size)], "c long, s long")
        assert df.selectExpr(source_divergence._share("c", "s").format(prior=5)).first()[0] == 1 + 1_000_000_000 * (count + 5) // size


def test_divergence_without_rows(spark):
    assert source_divergence.audit(frame(spark, [])).count() == 0
    got = source_divergence.audit(frame(spark, [(1, None, None, None), (2, None, "", "s"), (3, "a", "x", "y")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def exchange_by_hand(bins, lengths, size):
    """Any exchange of the three kinds that still raises the sum of squared fills, over all pairs of bins."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, x in enumerate(bins):
        for b, y in enumerate(bins):
            if a == b or fill[a] == size or fill[b] == size:
                continue
            one, two = lambda s: {(i,) for i in s}, lambda s: {(i, j) for i in s for j in s if i < j}
            for give in one(x) | two(x):
                for back in {()} | one(y) | two(y):
                    if len(give) + len(back) > 3 or (len(give) == 2 and len(back) != 1):
                        continue
                    d = sum(lengths[i] for i in give) - sum(lengths[i] for i in back)
                    if d > 0 and fill[b] + d <= size and fill[b] + d > fill[a]:
                        return a, b, give, back
    return None


@pytest.mark.parametrize("seed", range(12))
def test_exchanges_end_where_none_helps(seed):
    rng = random.Random(seed)
    size = rng.choice([20, 100])
    lengths = np.array([rng.randrange(1, size) if seed % 2 else rng.randrange(size // 4, size // 2) for _ in range(rng.randrange(2, 40))])
    start = swap_packing.best_fit_decreasing(lengths, size)
    before = sorted(sum(lengths[i] for i in b) for b in start)
    bins = swap_packing.exchange([list(b) for b in start], lengths, size, 10_000)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = [int(sum(lengths[i] for i in b)) for b in bins]
    assert max(fills) <= size and len(bins) <= len(start) and sum(f * f for f in fills) >= sum(int(f) ** 2 for f in before)
    assert len(bins) == -(-int(lengths.sum()) // size) or exchange_by_hand(bins, lengths, size) is None


def test_exchanges_save_bins():
    """Best fit takes three bins for 6+5, 5+4, 4: exchanges find two of twelve."""
    lengths = np.array([4, 4, 4, 6, 3, 3])
    start = [[3, 0], [1, 2], [4, 5]]
    bins = swap_packing.exchange([list(b) for b in start], lengths, 12, 100)
    assert len(bins) == 2
    rng = random.Random(1)
    saved = 0
    for _ in range(60):
        lengths = np.array([rng.randrange(200, 900) for _ in range(60)])
        start = swap_packing.best_fit_decreasing(lengths, 2048)
        saved += len(start) - len(swap_packing.exchange([list(b) for b in start], lengths, 2048, 240))
    assert saved > 0


def test_best_fit():
    rng = random.Random(4)
    for _ in range(50):
        size, lengths = 50, np.array([rng.randrange(1, 50) for _ in range(rng.randrange(0, 60))])
        rooms, want = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [b for b, r in enumerate(rooms) if r >= lengths[i]]
            if fits:
                b = min(fits, key=lambda b: rooms[b])
                room = rooms[b]
            else:
                b, room = len(rooms), size
                rooms.append(size)
            want.append(room - lengths[i])
            rooms[b] -= lengths[i]
        bins = swap_packing.best_fit_decreasing(lengths, size)
        assert sorted(size - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(swap_packing.default_tokenizer())
    fast = swap_packing.encoder(swap_packing.default_tokenizer())
    rng = random.Random(8)
    marks = [*" \t\n\r\x0b\x0c\x1c\x85\xa0 　", *"'sSLlv1234_-.,!?", "́", "̧", "e", "É", "Σ", "ς", "İ", "ß", "ﬁ", "각", "ᄀ", "ᅡ", "日", "🙂", "‍", "<|endoftext|>", "<|startoftext|>", "<|endo", "'ll", "'RE", "\0", "﻿", "don't", "Word"]
    for _ in range(4000):
        text = "".join(rng.choices(marks, k=rng.randrange(12)))
        assert np.frombuffer(fast(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    wide = [chr(c) for c in (*range(0x250), *rng.sample(range(0x250, 0x3000), 300), 0x1D400, 0x10FFFF)]
    for _ in range(4000):
        text = "".join(rng.choices(wide, k=rng.randrange(1, 9)) + rng.choices("etaoin shrdlu'", k=rng.randrange(12)))
        assert np.frombuffer(fast(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(20_000):
        text = "".join(rng.choices("etaoinsrhldcumfpgwybvkxjqzéüß'.-", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(1, 14)))
        assert np.frombuffer(fast(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    text = "The  quick\r\nbrown " * 300 + "x" * 5000
    assert np.frombuffer(fast(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(swap_packing, "WORDS", 3)
    fast = swap_packing.encoder.__wrapped__(swap_packing.default_tokenizer())
    assert [fast("a b c d e f a b") for _ in range(2)][0] == fast("a b c d e f a b")


@pytest.mark.parametrize("size, group", [(2048, 8192), (16, 50), (1, 4096)])
def test_packs(spark, rows, size, group):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(swap_packing.default_tokenizer())
    rows = [r for r in rows if size > 1 or len(r[1] or "") < 300]
    got = swap_packing.pack(frame(spark, rows), size, group=group, with_ids=True).collect()
    want = Counter((k, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t, _, _ in rows)
    by_doc, seen = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["start"] == r["piece"] * size
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    for key, whole in want:
        copies = sum(n for (k, _), n in want.items() if k == key)
        pieces = sorted(by_doc[key], key=lambda r: r["start"])
        if copies == 1:
            assert b"".join(r["ids"] for r in pieces) == whole and all(r["length"] == size for r in pieces[:-1])
    assert sum(r["length"] for r in got) == sum(len(w) // 4 * n for (_, w), n in want.items())
    again = swap_packing.pack(frame(spark, rows, False).repartition(7), size, group=group)
    assert again.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if size == 2048:
        assert len(seen) <= -(-sum(r["length"] for r in got) // size) + 1
    assert swap_packing.pack(frame(spark, []), size).count() == 0
