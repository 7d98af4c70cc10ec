"""Benchmark decontamination: an FM-index over each shard of the training text, searched backwards for test windows.

A shard's text is its documents' words as symbols of the test vocabulary. Words outside it end a run, and runs
shorter than the shortest window are left out: no occurrence lies there, so the index holds all that can match and is
small. Words are compared by 128-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmeter.llm import _text
from quillmeter.llm._store import Store, small_batches

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Bytes of test text in one pass over the documents, and text bytes or symbols after which a shard is indexed.
BLOCK_BYTES, SHARD_BYTES, SHARD_SYMBOLS = 16 << 20, 24 << 20, 2_000_000
SAMPLE = 16
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ADDED = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", T.ArrayType(_SPAN))]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols, for arrays of c and i at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits, self.ones, self.zeros = max(1, int(sigma - 1).bit_length()), [], []
        for k in reversed(range(self.bits)):
            bit = (symbols >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for k, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            right = ((c >> k) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(right, zeros + a, low - a), np.where(right, zeros + b, high - b)
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; the last symbol must be the only smallest."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """text: symbols from 1; 0 is put at its end."""
        text = np.append(text, 0)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.tree = WaveletMatrix(self.bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.marked = order % SAMPLE == 0
        self.sample_rank, self.samples = np.cumsum(self.marked) - 1, order[self.marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (a row of symbols), last symbol first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            c = c[live]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text until a sampled position."""
        rows, out, left, steps = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            hit = self.marked[rows[left]]
            out[left[hit]] = self.samples[self.sample_rank[rows[left[hit]]]] + steps
            left = left[~hit]
            c = self.bwt[rows[left]]
            rows[left] = self.before[c] + self.tree.rank(c, rows[left])
            steps += 1
        return out


class Windows:
    """The distinct windows of test items, by length, over a vocabulary of word hashes. Symbols: 1 ends a run, words from 2."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = [t.encode() for _, t in items]
        for seed in range(0, 256, 2):
            self.seeds = seed, seed + 1
            hashes, checks, first = _text.hashed_words(texts, _text.ALNUM, self.seeds)
            self.vocabulary, at, symbols = np.unique(hashes, return_index=True, return_inverse=True)
            self.checks = checks[at]
            if (self.checks[symbols] == checks).all():  # no two different words share a hash
                break
        self.owners: list[list[str]] = []
        self.patterns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        known: dict[bytes, int] = {}
        found: dict[int, list[np.ndarray]] = {}
        for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = min(window, b - a)
            for i in range(a, b - n + 1) if n else ():
                w = symbols[i : i + n] + 2
                k = known.setdefault(w.tobytes(), len(known))
                if k == len(self.owners):
                    self.owners.append([])
                    found.setdefault(n, []).append(w)
                    self.patterns.setdefault(n, ([], []))[0].append(k)
                if item not in self.owners[k][-1:]:
                    self.owners[k].append(item)
        self.patterns = {n: (np.array(k), np.stack(found[n])) for n, (k, _) in self.patterns.items()}
        self.shortest = min(self.patterns, default=0)

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, document and word number of each symbol, words of each document): the runs that can hold a window."""
        hashes, checks, first = _text.hashed_words(texts, _text.ALNUM, self.seeds)
        counts = np.diff(first)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        known = (self.vocabulary[at] == hashes) & (self.checks[at] == checks) if len(self.vocabulary) else np.zeros(len(hashes), bool)
        doc = np.repeat(np.arange(len(texts)), counts)
        spread = np.zeros(len(hashes) + len(texts) + 1, np.int64)  # a gap after each document ends its last run
        place = np.arange(len(hashes)) + doc
        spread[place] = np.where(known, at + 2, 0)
        edge = np.diff(np.concatenate([[0], (spread > 0).astype(np.int8)]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= max(1, self.shortest)
        starts, sizes = starts[long], (ends - starts)[long] + 1  # each run takes the gap after it along, as its end
        take = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        symbols = spread[take]
        symbols[symbols == 0] = 1
        docs = np.searchsorted(first[1:] + np.arange(len(texts)), take, side="left")
        return symbols, docs, take - first[docs] - docs, counts

    def find(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, position, length) of every occurrence in a shard's symbols."""
        out = []
        if len(symbols) and self.patterns:
            index = FMIndex(symbols, len(self.vocabulary) + 2)
            for n, (ids, patterns) in self.patterns.items():
                low, high = index.search(patterns)
                count = high - low
                hits = np.repeat(np.arange(len(ids)), count)
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                out.append((ids[hits], index.locate(rows), np.full(len(rows), n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _scan(shared, text_at: int, keep: list[int], schema: pa.Schema, shard_symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        held: list[pa.RecordBatch] = []
        parts: list[tuple] = []
        size = symbols = 0

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.concatenate([[0], np.cumsum([len(p[3]) for p in parts])])
            text = np.concatenate([p[0] for p in parts])
            docs = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=False)])
            words = np.concatenate([p[2] for p in parts])
            n_words = np.concatenate([p[3] for p in parts])
            which, where, length = windows.find(text)
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, where, 1)
            np.add.at(cover, where + length, -1)
            hit = np.cumsum(cover[:-1]) > 0
            n_hit = np.bincount(docs[hit], minlength=len(n_words))
            items: dict[int, set[str]] = {}
            for d, w in zip(*np.unique(np.stack([docs[where], which]), axis=1).tolist(), strict=True) if len(where) else ():
                items.setdefault(d, set()).update(windows.owners[w])
            spans: dict[int, list[dict]] = {}
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                spans.setdefault(int(docs[a]), []).append({"start": int(words[a]), "end": int(words[b - 1]) + 1})
            done = 0
            for batch in held:
                rows = range(done, done + batch.num_rows)
                done += batch.num_rows
                own = [n_words[rows.start : rows.stop], n_hit[rows.start : rows.stop], [sorted(items.get(i, ())) for i in rows], [spans.get(i, []) for i in rows]]
                columns = [batch.column(i) for i in keep] + [pa.array(c, f.type) for c, f in zip(own, list(schema)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            held.clear()
            parts.clear()

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(text_at).to_pylist()]
            for i, j in _text.chunks(texts):
                parts.append(windows.runs(texts[i:j]))
                symbols += len(parts[-1][0])
            held.append(batch if text_at in keep else batch.set_column(text_at, "_", pa.nulls(batch.num_rows)))
            size += sum(map(len, texts))
            if size >= SHARD_BYTES or symbols >= shard_symbols:
                yield from flush()
                size = symbols = 0
        if held:
            yield from flush()

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    for row in rows.toLocalIterator():
        block.append(tuple(row))
        size += len(row[1])
        if size >= most:
            yield block
            block, size = [], 0
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """The kept columns of docs (default: all) with n_words, n_hit, items (ids, sorted as strings), spans (runs of hit
    words as start and end word numbers) and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    One row for each document. The test set goes to the shards in blocks of 16 MB, of which the driver holds one at a
    time. A test set of one block takes one pass and shuffles nothing; of a larger one each block's hits are written and
    then grouped by document. Null and empty texts have no words and items without words no windows. Repeated items and
    documents are treated alike. Columns of docs with the names added are replaced.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    own = ["n_words", "n_hit", "items", "spans", "contaminated"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in own]

    def scan(df: DataFrame, kept: list[str], shared) -> DataFrame:
        df = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
        schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, t) for c, t in ADDED)])
        return df.mapInArrow(_scan(shared, df.columns.index(text), [df.columns.index(c) for c in kept], to_arrow_schema(schema), shard_symbols), schema)

    blocks = _blocks(benchmark, item, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if not second:
        out = scan(docs, keep, sc.broadcast(Windows(first, window)))
    else:
        out = _by_blocks(docs, keep, text, scan, chain([first, second], blocks), window)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


_ROW = "__decontaminate_row"


def _merge_spans(schema: pa.Schema):
    """(row, items, spans) with spans that overlap or touch made one, and the number of their words: sorted by row and start,
    a span begins anew where it lies beyond all ends before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            pairs = spans.flatten()
            start, end = (pairs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
            row = np.repeat(np.arange(len(batch)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            order = np.lexsort((start, row))
            start, row = start[order], row[order]
            shift = row * (int(end.max(initial=0)) + 2)  # rows lie apart on one line
            reach = np.maximum.accumulate(end[order] + shift) if len(order) else shift
            new = np.ones(len(order), bool)
            new[1:] = start[1:] + shift[1:] > reach[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(order)) - 1 if len(first) else first
            start, end, row = start[first], reach[last] - shift[last], row[first]
            n_hit = np.bincount(row, end - start, len(batch)).astype(np.int64)
            offsets = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            kind = schema.field("spans").type.value_type
            merged = pa.StructArray.from_arrays([pa.array(start).cast(kind.field(0).type), pa.array(end).cast(kind.field(1).type)], fields=[kind.field(0), kind.field(1)])
            columns = [batch.column(0), pa.array(n_hit), batch.column("items"), pa.ListArray.from_arrays(pa.array(offsets), merged)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _by_blocks(docs: DataFrame, keep: list[str], text: str, scan: Callable, blocks: Iterable[list[tuple[str, str]]], window: int) -> DataFrame:
    """The kept columns with n_words, n_hit, items and spans, from passes of which each writes what it found."""
    store = Store(docs.sparkSession, "decontaminate")
    # Stored, so that a row has one number in all passes.
    rows = store.table(docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text]))).withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    counts, hits = None, []
    for k, block in enumerate(blocks):
        if not block and k:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, window))
        found = scan(rows, [_ROW], shared)
        if counts is None:
            found = counts = store.table(found, "counts")
            hits.append(counts.where("n_hit > 0"))
        else:
            hits.append(store.table(found.where("n_hit > 0"), f"hits-{k}"))
        shared.destroy()
    grouped = reduce(DataFrame.union, (h.select(_ROW, "items", "spans") for h in hits)).groupBy(_ROW)  # a row for each block at most
    grouped = grouped.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    schema = T.StructType([grouped.schema[_ROW], T.StructField("n_hit", T.LongType()), *(grouped.schema[c] for c in ("items", "spans"))])
    grouped = grouped.mapInArrow(_merge_spans(to_arrow_schema(schema)), schema)
    out = rows.select(_ROW, *(f"`{c}`" for c in keep)).join(counts.select(F.col(_ROW).alias("_r"), "n_words"), F.col(_ROW) == F.col("_r")).drop("_r").join(grouped, _ROW, "left")
    empty = {c: F.coalesce(c, F.array().cast(grouped.schema[c].dataType)) for c in ("items", "spans")}
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), **empty}).select(*(f"`{c}`" for c in keep), "n_words", "n_hit", "items", "spans")


def cut(text: str | None, spans: list) -> str | None:
    """A text without the hit words and what stands between them."""
    if text is None or not len(spans):
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*out, text[at:]])


_LOWER = {i: i + 32 for i in range(65, 91)}
