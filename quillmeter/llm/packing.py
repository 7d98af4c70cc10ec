"""Packing documents into sequences: first-fit decreasing on a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm._store import small_batches

#: Documents in a group on average: groups are packed alone, so their number grows with the input and their size doesn't.
GROUP = 4096
#: The added token of byte_bpe_50k.json.
SPECIAL = {"<|endoftext|>": 50256}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str, special: bool = False):
    """ids of a text by the byte-level BPE of a rank file; the strings of special tokens are ordinary text, or with
    special one id each, as in that library's plain call.

    The ids are those of byte_bpe_50k.json, the same vocabulary, by the tokenizers library (a test compares them); this
    encoder takes a quarter of the time. Texts it gives up on go to that library.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all") if special else fast.encode_ordinary(text)
        except Exception:  # its pattern engine limits backtracking
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            slow.encode_special_tokens = not special
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def first_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece. A tournament tree holds the largest room below each node, so the first bin with room is
    found from the root in logarithmic steps."""
    leaves = 1 << max(1, len(lengths) - 1).bit_length()
    tree = [size] * (2 * leaves)
    out = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        out[i] = node - leaves
        tree[node] -= need
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
    return out


def _tokenise(path: str, size: int, groups: int, with_ids: bool, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path, special), Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), 0], np.uint32)
                raw = ids.astype("<u4").tobytes()
                whole = zlib.crc32(raw)
                mark = (key, whole, len(ids))
                seen[mark] += 1
                # Copies of a row get groups of their own, and a task that runs again deals out the same.
                group = zlib.crc32(repr((*mark, seen[mark])).encode()) % groups
                for start in range(0, len(ids), size):
                    piece = raw[4 * start : 4 * (start + size)]
                    row = key, start, len(piece) // 4, zlib.crc32(piece), len(ids), group, whole, seen[mark], piece if with_ids else None
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            types = [batch.schema.field(0).type, *[pa.int64()] * 7, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["key", "start", "length", "ids_crc32", "doc_tokens", "grp", "whole", "copy", "ids"])

    return run


def _pack(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("whole", "doc_tokens", "key", "copy", "start")]))
        length = table.column("length").to_numpy()
        bins, tails = np.empty(len(length), np.int64), length < size
        bins[tails] = first_fit_decreasing(length[tails], size)
        opened = int(bins[tails].max()) + 1 if tails.any() else 0
        bins[~tails] = opened + np.arange((~tails).sum())
        order = np.lexsort((-length, bins))
        table, length, bins = table.take(pa.array(order)), length[order], bins[order]
        before = np.cumsum(length) - length
        offset = before - before[np.searchsorted(bins, bins)]
        sequence = bins + (table.column("grp").to_numpy() << 32)
        kept = table.select(["key", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, size: int = 1024, key: str = "doc_id", text: str = "text", group: int = GROUP, ranks: str | None = None, with_ids: bool = False, special: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids
    (little-endian unsigned 32-bit) if asked for.

    With special, strings of special tokens in a text are one id each (the tokenizers library's plain call), else they
    are ordinary text. A document's ids end with a 0; it is cut into pieces of size and a rest. The rests of a random group of documents
    are packed by first-fit decreasing. Null and empty texts are a lone 0. Null keys and repeated rows are packed as
    documents of their own. Other columns are ignored. Texts are tokenised where they are read; only pieces' lengths
    (and ids, if asked for) are shuffled.
    """
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group))
    rows = docs.select(F.col(key), F.col(text)).mapInArrow(
        _tokenise(ranks or default_ranks(), size, groups, with_ids, special), f"key {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, grp long, whole long, copy long, ids binary"
    )
    out = rows.groupBy("grp").applyInArrow(_pack(size), f"key {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")
    out = out.withColumnRenamed("key", key)
    return out if with_ids else out.drop("ids")
