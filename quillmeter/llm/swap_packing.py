"""Packing whole documents into as few sequences as possible: best fit, then exchanges that fill bins until some empty."""

from __future__ import annotations

import json
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

#: Documents in a group on average; each group leaves about one bin unfilled.
GROUP = 8192
#: Words of at most so many characters are kept with their ids, up to so many words.
WORD, WORDS = 40, 400_000
#: Exchanges in a group for each of its pieces, at most.
STEPS = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str):
    """ids of one piece of lower-cased text by the file's merges.

    Each byte is a symbol, the last one with the mark of a word's end. Written as a byte that UTF-8 hasn't, the mark is
    merged with the byte before it first of all, since those symbols have the lowest ids; from there on merges go by id.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    end = "</w>"
    spelt = lambda t: bytes(byte[c] for c in t.removesuffix(end)) + (b"\xff" if t.endswith(end) else b"")
    ranks = {spelt(t): n for t, n in vocabulary.items() if not t.startswith("<|")}
    core = tiktoken.Encoding("word_bpe", pat_str=".", mergeable_ranks=ranks, special_tokens={})
    return lambda piece: core._encode_single_piece(piece.encode() + b"\xff")


@cache
def encoder(path: str):
    """ids of a text, as little-endian unsigned 32-bit numbers, by a tokenizer whose tokens don't cross white space.

    Its pattern keeps white space apart and its normalizer works on each side of it alone, so a text's ids are those of
    its words one after the other. Words come again and again, and are looked up; new ones of Latin letters are cut by the
    tokenizer's pattern and merged here, at a tenth of the library's time, and all others go to the library.
    """
    import regex
    from tokenizers import Tokenizer

    encode, merged = Tokenizer.from_file(path).encode, _pieces(path)
    cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
    plain = regex.compile(r"[\x00-\u024F]*").fullmatch
    known: dict[str, bytes] = {"": b""}
    spaces = str.maketrans("\t\n\r", "   ")

    def new(word: str) -> bytes:
        if "<|" in word or not plain(word):
            ids = encode(word, add_special_tokens=False).ids
        else:
            low = word.lower() if word.isascii() else "".join([c.lower() for c in word])
            ids = [n for piece in cut(low) for n in merged(piece)]
        return np.array(ids, "<u4").tobytes()

    def ids(text: str) -> bytes:
        out = []
        for word in text.translate(spaces).split(" ") if text.isascii() else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            found = known.get(word)
            if found is None:
                found = new(word)
                if len(word) <= WORD:
                    if len(known) > WORDS:
                        known.clear()
                        known[""] = b""
                    known[word] = found
            out.append(found)
        return b"".join(out)

    return ids


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """The pieces of each bin: longest first, each into the fullest bin that has room. One bit for each room that some bin
    has; the lowest bit from a length upwards is the best fit."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - need
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _offers(bin_: list[int], lengths: list[int]) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """Sums of one piece and of two pieces that a bin can give, with pieces that have it. Sizes in a bin are few, since they
    add up to its size."""
    by_size: dict[int, list[int]] = {}
    for i in bin_:
        by_size.setdefault(lengths[i], []).append(i)
    one = {s: (own[0],) for s, own in by_size.items()}
    two: dict[int, tuple] = {}
    sizes = sorted(by_size)
    for k, s in enumerate(sizes):
        if len(by_size[s]) > 1:
            two.setdefault(2 * s, tuple(by_size[s][:2]))
        for t in sizes[k + 1 :]:
            two.setdefault(s + t, (by_size[s][0], by_size[t][0]))
    return one, two


def exchange(bins: list[list[int]], lengths: np.ndarray, size: int, steps: int) -> list[list[int]]:
    """Moves a piece, or exchanges one for one or two for one between two underfull bins, whenever that raises the sum of
    squared fills; the emptiest bins give first. It ends when no fewer bins are possible, when no exchange helps any more,
    or after so many steps. Each step takes the exchange of the largest gain for one giving bin."""
    length = lengths.tolist()
    least = -(-int(lengths.sum()) // size)
    fill = [sum(length[i] for i in b) for b in bins]
    live = {b for b, f in enumerate(fill) if f < size}
    used = len(bins)
    if used <= least or len(live) < 2:
        return bins
    held = {}

    def rows(b: int) -> np.ndarray:
        """bin, what it gives back (nothing, one piece, two pieces) and how many pieces that is."""
        held[b] = one, two = _offers(bins[b], length)
        return np.array([(b, 0, 0), *((b, s, 1) for s in one), *((b, s, 2) for s in two)], np.int64)

    table = np.concatenate([rows(b) for b in sorted(live)])
    filled = np.array(fill)
    improved = True
    while improved and used > least and steps > 0:
        improved = False
        for a in sorted(live, key=lambda b: (filled[b], b)):
            while a in live and used > least and steps > 0:
                to, back, pieces = table.T
                room = size - filled[to]
                gain = np.full(len(table), -1)
                give = np.zeros(len(table), np.int64)
                for k, offers in enumerate(held[a]):
                    below = np.zeros(size + 1, np.int64)  # the largest sum up to each number that the giver can part with
                    below[[s for s in offers if s <= size]] = [s for s in offers if s <= size]
                    np.maximum.accumulate(below, out=below)
                    x = below[np.minimum(back + room, size)]
                    d = x - back
                    g = np.where((x > 0) & (d > 0) & (to != a) & (pieces == 1 if k else pieces >= 0), d * (filled[to] - filled[a] + d), -1)
                    better = g > gain
                    gain[better], give[better] = g[better], x[better] + k * (size + 1)
                best = int(gain.argmax())
                if gain[best] <= 0:
                    break
                b, two = int(to[best]), give[best] > size
                mine = held[a][int(two)][int(give[best]) - int(two) * (size + 1)]
                theirs = held[b][int(pieces[best]) - 1][int(back[best])] if pieces[best] else ()
                d = sum(length[i] for i in mine) - sum(length[i] for i in theirs)
                bins[a] = [i for i in bins[a] if i not in mine] + list(theirs)
                bins[b] = [i for i in bins[b] if i not in theirs] + list(mine)
                filled[a] -= d
                filled[b] += d
                steps, improved = steps - 1, True
                table = table[(to != a) & (to != b)]
                for c in (a, b):
                    if 0 < filled[c] < size:
                        table = np.concatenate([table, rows(c)])
                    else:
                        live.discard(c)
                        used -= int(filled[c] == 0)
    return [b for b in bins if b]


def pack_bins(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece, from 0."""
    out = np.zeros(len(lengths), np.int64)
    for b, own in enumerate(exchange(best_fit_decreasing(lengths, size), lengths, size, STEPS * len(lengths))):
        out[own] = b
    return out


def _tokenise(path: str, size: int, groups: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text or "") + b"\0\0\0\0"
                whole = zlib.crc32(raw)
                mark = (key, whole, len(raw))
                seen[mark] += 1
                # Copies of a row get groups of their own, and a task that runs again deals out the same.
                group = zlib.crc32(repr((*mark, seen[mark])).encode()) % groups
                for piece, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    row = key, piece, at // 4, len(part) // 4, zlib.crc32(part), group, whole, seen[mark], part if with_ids else None
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["key", "piece", "start", "length", "ids_crc32", "grp", "whole", "copy", "ids"])

    return run


def _pack(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("whole", "key", "copy", "start")]))
        length = table.column("length").to_numpy()
        bins, rests = np.empty(len(length), np.int64), length < size
        bins[rests] = pack_bins(length[rests], size)
        opened = int(bins[rests].max()) + 1 if rests.any() else 0
        bins[~rests] = opened + np.arange((~rests).sum())
        order = np.lexsort((-length, bins))
        table, length, bins = table.take(pa.array(order)), length[order], bins[order]
        before = np.cumsum(length) - length
        offset = before - before[np.searchsorted(bins, bins)]
        sequence = bins + (table.column("grp").to_numpy() << 32)
        kept = table.select(["key", "piece", "start", "length", "ids_crc32", "ids"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, size: int = 2048, key: str = "doc_id", text: str = "text", group: int = GROUP, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset, and the piece's ids (little-endian
    unsigned 32-bit) if asked for.

    A document's ids end with a 0. A longer one than size is cut into pieces of size and a rest; others stay whole. Full
    pieces are sequences of their own; the rest of a random group of documents are packed by best fit and exchanges.
    Null and empty texts are a lone 0. Null keys and repeated rows are packed as documents of their own; an empty table
    gives no row; other columns are ignored. Texts are tokenised where they are read; only pieces' lengths (and ids, if
    asked for) are shuffled. Groups hold group documents on average whatever the input's size; a task that runs again
    gives the same.
    """
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text)).mapInArrow(
        _tokenise(tokenizer or default_tokenizer(), size, groups, with_ids), f"key {kind}, piece int, start long, length long, ids_crc32 long, grp long, whole long, copy long, ids binary"
    )
    out = rows.groupBy("grp").applyInArrow(_pack(size), f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long").withColumnRenamed("key", key)
    return out if with_ids else out.drop("ids")
