"""Phrases whose words stand together more often than apart: a count-min sketch first, exact counts of what it leaves."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.llm import _text
from quillmeter.llm._store import Store

#: Cells in each of the sketch's two rows, as a power of two: a byte each while it is filled, a bit each when it is read.
#: It has one size for all inputs: a fuller sketch lets more through to the exact counts, never less.
WIDTH = 25
#: Cells of the sketch in one row of its table.
BLOCK = 1 << 16
#: Bytes of text that are counted at once, and copies of a part's count in the join.
CHUNK, SALTS = 1 << 21, 8

#: Bytes between pieces, and bytes of words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_SPLIT = b".,;:!?\n"
_U = np.uint64


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between pieces; no phrase crosses them."""
    at = 0
    while len(text) - at > CHUNK:
        found = [p for p in (text.find(bytes([c]), at + CHUNK) for c in _SPLIT) if p >= 0]
        if not found:
            break
        yield text[at : min(found)]
        at = min(found)
    yield text[at:]


class _Grams:
    """The distinct phrases of one to three words in some texts: word numbers, counts and hashes, by length."""

    def __init__(self, texts: list[bytes], lang: bytes):
        raw, bounds = _text.join(texts)
        buf = _text.LOWER[raw]
        starts, ends, _ = _text.words(buf, bounds, _WORD)
        self.n = len(starts)
        stop, inside = _ENDS[buf], _WORD[buf]
        stop[bounds[1:] - 1], inside[bounds[1:] - 1] = True, False
        piece = np.cumsum(stop)[starts]
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])]).dictionary_encode()
        self.words, ids = words.dictionary, words.indices.to_numpy().astype(np.int64)
        v = max(1, len(self.words))
        one = np.bincount(ids, minlength=len(self.words))
        two = np.full(max(0, self.n - 1), -1)
        near = piece[1:] == piece[:-1]
        two[near], pairs = pd.factorize(ids[:-1][near] * v + ids[1:][near])
        near = near[1:] & near[:-1]
        three, triples = pd.factorize(two[:-1][near] * v + ids[2:][near])
        first, second = np.divmod(pairs, v)
        head, third = np.divmod(triples, v)
        self.parts = [(np.arange(len(self.words)),), (first, second), (first[head], second[head], third)]
        self.counts = [one, np.bincount(two[two >= 0], minlength=len(pairs)), np.bincount(three, minlength=len(triples))]
        spell, at = _text.join(self.words.to_pylist())
        key = _text.word_hash(spell, at[:-1], at[1:] - 1)
        seed = _text.word_hash(*(np.array(x) for x in (np.frombuffer(lang, np.uint8), [0], [len(lang)])), 1)[0]
        self.hashes = [np.full(len(c), seed, _U) for c in self.counts]
        for k, columns in enumerate(self.parts):
            for ids in columns:
                self.hashes[k] = _text.mix(self.hashes[k] * _U(0x9E3779B97F4A7C15) + key[ids])

    def cells(self, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the phrases in both rows of the sketch."""
        h, bits = self.hashes[k], _U((1 << width) - 1)
        return (h & bits).astype(np.int64), (h >> _U(64 - width)).astype(np.int64)

    def phrases(self, k: int, which: np.ndarray) -> pa.Array:
        columns = [self.words.take(pa.array(ids[which])) for ids in self.parts[k]]
        return (pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if k else columns[0]).cast(pa.string())


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, _Grams]]:
    for batch in batches:
        by_lang: defaultdict[bytes, list[bytes]] = defaultdict(list)
        for lang, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            by_lang[lang] += _segments(text or b"")
        for lang, texts in by_lang.items():
            for i, j in _text.chunks(texts, CHUNK):
                yield lang, _Grams(texts[i:j], lang)


def _sketch(width: int):
    """Each task's own sketch, by blocks; cells stay at 255, far above any threshold here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, 1 << width), np.uint8)
        for _, grams in _grams(batches):
            for k, counts in enumerate(grams.counts):
                for row, cells in zip(sketch, grams.cells(k, width), strict=True):
                    code, cells = pd.factorize(cells)
                    row[cells] = np.minimum(row[cells] + np.bincount(code, counts, len(cells)), 255)
        pack = zstandard.ZstdCompressor(level=1).compress
        for number, block in enumerate(sketch.reshape(-1, min(BLOCK, 1 << width))):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pack(block.tobytes())], pa.binary())], names=["block", "cells"])

    return run


def _merge(least: int, size: int):
    """Adds up the blocks of one number, which follow each other; a bit for each cell that reaches the threshold."""

    def done(number: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, total = None, np.zeros(size, np.uint16)
        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = number, np.zeros(size, np.uint16)
                total = np.minimum(total + np.frombuffer(unpack(cells), np.uint8), 255)
        if now is not None:
            yield done(now, total)

    return run


def _exact(width: int, bits):
    """(lang, words, phrase, n) of the phrases that the sketch leaves, added up in each chunk; words 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = bits.value
        for lang, grams in _grams(batches):
            out = [(0, pa.nulls(1, pa.string()), np.array([grams.n]))]
            for k, counts in enumerate(grams.counts):
                keep = np.ones(len(counts), bool)
                for row, cells in zip(sketch, grams.cells(k, width), strict=True):
                    keep &= (row[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                which = np.flatnonzero(keep)
                out.append((k + 1, grams.phrases(k, which), counts[which]))
            for k, phrases, counts in out:
                same = pa.array([lang] * len(phrases), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([same, pa.array(np.full(len(phrases), k, np.int32)), phrases, pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "n"])

    return run


def _score(left: str, right: str):
    """floor(1000000 * a * a / (left * right)) in 38 digits."""
    d = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"({d('a')} * {d('a')} * 1000000) div ({d(left)} * {d(right)})")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, top: int = 2000, width: int = WIDTH, store: Store | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first top phrases of two or three words.

    Texts are cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs; A-Z are lower-cased. A
    phrase counts if it occurs at least least times (a). It is cut in two where the score 1000000 * a * a / (l * r) is
    least (l and r: occurrences of the parts; the first cut at a tie); n are all words of the language. A phrase goes if a
    longer one that contains it has at least covered per cent of its occurrences. Order: score and a descending, phrase.

    Null texts are empty, a null language is `und`; repeated rows count again; extra columns are ignored; an empty table
    and languages without such phrases give no row. Everything is counted over whole texts of all documents.

    One pass fills sketches task by task, which are added up block by block. What the sum puts under least can't reach it,
    so the second pass counts exactly only the rest (words as well: a phrase's parts are at least as frequent as it). The
    sketch's size is fixed, so a larger input fills it more and sends more rare phrases through the exact counts, which
    are combined in tasks before they shuffle; results never depend on it. Its bits (2 * 2 ** width) are broadcast.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = docs.sparkSession
    store = store or Store(spark, "collocations")
    raw = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string")).toDF("lang", "text")
    size = min(BLOCK, 1 << width)
    blocks = raw.mapInArrow(_sketch(width), "block int, cells binary").repartition("block").sortWithinPartitions("block")
    merged = store.table(blocks.mapInArrow(_merge(least, size), "block int, bits binary"), "sketch")
    bits = np.zeros((2 << width) // size * (size // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["block"] * (size // 8) :][: size // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(2, -1))
    counts = raw.mapInArrow(_exact(width, shared), "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    counts = store.table(counts.where((F.col("words") == 0) | (F.col("n") >= least)), "counts")
    shared.unpersist()
    store.drop("sketch")

    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = "struct(1 as cut, 'l' as side, w[0] as part), struct(1 as cut, 'r' as side, array_join(slice(w, 2, 2), ' ') as part)"
    more = "struct(2 as cut, 'l' as side, array_join(slice(w, 1, 2), ' ') as part), struct(2 as cut, 'r' as side, w[2] as part)"
    asked = found.select("lang", "phrase", "words", "a", F.explode(F.expr(f"if(words = 2, array({cuts}), array({cuts}, {more}))")).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    # Frequent words are parts of many phrases: their counts come in copies, and a phrase asks one of them. Pairs of words
    # are parts of far fewer, and come once.
    copies = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = counts.where("words in (1, 2)").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(copies).alias("salt"))
    salt = F.when(F.instr("part", " ") > 0, 0).otherwise(F.pmod(F.hash("phrase", "cut", "side"), F.lit(SALTS)))
    told = asked.withColumn("salt", salt).join(known, ["lang", "part", "salt"])
    f = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f")))
    cut = told.groupBy("lang", "phrase", "words", "a").agg(f(1, "l").alias("l1"), f(1, "r").alias("r1"), f(2, "l").alias("l2"), f(2, "r").alias("r2"))
    cut = cut.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")}).withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False)))
    longer = asked.where("words = 3 and part like '% %'").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    pick = lambda a, b: F.when(F.col("second"), F.col(b)).otherwise(F.col(a))
    scored = cut.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * a")
    scored = scored.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # A language's best are among the best of its 64 parts, so that no task sorts a whole language: the last ranking reads
    # 64 * top rows at most.
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(counts.where("words = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
