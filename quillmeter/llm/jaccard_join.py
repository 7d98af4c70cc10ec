"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Documents of equal shingle sets form a class. Classes meet in tiles, one for each of the smallest shingle hashes they
hold; a tile is sorted by set size, so that only sizes within the threshold's band are compared. There, parity bitmaps
bound the overlap from above: each element that only one set holds flips one bit, so the sets differ in at least as
many elements as their bitmaps in bits. Pairs that may still reach the threshold are decided by intersecting the
sorted arrays of all their shingles.

A tile over a bound is cut into cells of bounded size. First its classes meet block by block, together with a few pivots
of the tile, which joins families of near copies. Then only classes of different components have to meet: those of the
tile's largest component stay in their blocks, all others visit every block of their sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.llm import _text
from quillmeter.llm._components import components
from quillmeter.llm._store import Store

#: Words of a shingle, and the threshold in percent.
WORDS, PERCENT = 5, 75
#: Smallest hashes by which a class enters tiles. Each of the smallest hashes of a union is shared with a probability of
#: the similarity, so a pair at 0.75 meets in none with a chance of 0.25 ** 32.
SMALLEST = 32
#: Classes in a block of a tile, shingles of a block that are intersected together, and pivots by size band of a tile.
TILE, SETTLED, PIVOTS = 8_000, 4_000_000, 8
#: Bits of a bitmap by the size of the set; neighbours differ by FOLD.
WIDTHS, FOLD = (256, 1024, 4096, 16384), 4
#: Ids up to which a table of them is broadcast (under 100 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
_Q = np.random.default_rng(7).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for i, j in _text.chunks(texts):
        w, first = _text.hashed_words(texts[i:j], _text.NON_SPACE)
        n = len(w)
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s[: max(0, n - k)] += w[k:] * _Q[k]
        s = _text.mix(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                part = np.sort(s[a : b - WORDS + 1])
                out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
            elif b > a:
                out.append(_text.mix(np.array([(w[a:b] * _Q[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(w[:0])
    return out


def width(n: int) -> int:
    return next((k for k, w in enumerate(WIDTHS) if n <= w), len(WIDTHS) - 1)


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the number of hashes at each bit."""
    bits = WIDTHS[width(len(s))]
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [], [], [], []
        for s in shingle_sets([t and t.encode() for t in batch.column(1).to_pylist()]):
            rows[0].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            rows[1].append(len(s))
            rows[2].append(s[:SMALLEST].view(np.int64).tolist())
            rows[3].append(bitmap(s))
        types = pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], names=["id", "cls", "n", "smallest", "bits"])


def _whole_tiles(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole tiles from rows sorted by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield table.slice(0, last)
                held = table.slice(last).combine_chunks().to_batches()
            else:
                held = table.to_batches()
                least = 2 * table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a table (cell, n, bits, side), sorted by cell and n, of different sides (or without one) whose bitmaps
    allow a link."""
    key, n, side = table.column("cell").to_numpy(), table.column("n").to_numpy(), table.column("side").to_numpy()
    raw = table.column("bits").to_pylist()
    kind = np.searchsorted(WIDTHS, np.minimum(n, WIDTHS[-1]))
    place, maps = np.zeros((len(WIDTHS), len(n)), np.int64), []
    for k, w in enumerate(WIDTHS):
        own, wider = np.flatnonzero(kind == k), np.flatnonzero(kind == k + 1)
        a = np.frombuffer(b"".join(raw[i] for i in own.tolist()), np.uint64).reshape(len(own), w // 64)
        b = np.frombuffer(b"".join(raw[i] for i in wider.tolist()), np.uint64).reshape(len(wider), FOLD, w // 64)
        maps.append(np.concatenate([a, np.bitwise_xor.reduce(b, axis=1)]))
        place[k, own], place[k, wider] = np.arange(len(own)), len(own) + np.arange(len(wider))
    active, d = np.arange(len(n)), 0
    while True:
        d += 1
        active = active[active + d < len(n)]
        active = active[(key[active] == key[active + d]) & (100 * n[active] >= PERCENT * n[active + d])]
        if not len(active):
            return
        first = active[(side[active] == 0) | (side[active] != side[active + d])]
        other = first + d
        # Linked sets overlap in at least p/(100+p) of their summed sizes.
        most = n[first] + n[other] - 2 * -(-PERCENT * (n[first] + n[other]) // (100 + PERCENT))
        near = np.zeros(len(first), bool)
        for k in range(len(WIDTHS)):
            at = np.flatnonzero(kind[first] == k)
            for part in np.array_split(at, max(1, len(at) * WIDTHS[k] // (1 << 26))):
                differ = np.bitwise_count(maps[k][place[k, first[part]]] ^ maps[k][place[k, other[part]]])
                near[part] = differ.sum(axis=1, dtype=np.int64) <= most[part]
        yield first[near], other[near]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a tile, the smallest id among its candidates and itself."""
    for table in _whole_tiles(batches):
        ids = table.column("id").to_numpy()
        best = ids.copy()
        for a, b in _candidates(table):
            best[a] = np.minimum(best[a], ids[b])
            best[b] = np.minimum(best[b], ids[a])
        away = best < ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(best[away])], names=["x", "y"])


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a cell that have a candidate in another component; with lists of smallest hashes, only if no other
    tile is a better place for the pair, which is that of the smallest hash that both list."""
    for table in _whole_tiles(batches):
        tile, group = table.column("tile").to_numpy(), table.column("component").to_numpy()
        lists = np.full((table.num_rows, SMALLEST), -1, np.int64) if "smallest" in table.column_names else None
        for i, x in enumerate(table.column("smallest").to_pylist() if lists is not None else ()):
            lists[i] = (x + x[:1] * SMALLEST)[:SMALLEST]
        flags = np.zeros(table.num_rows, bool)
        for a, b in _candidates(table):
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
            for i in range(0, len(a) if lists is not None else 0, 4096):
                one, two = lists[a[i : i + 4096]], lists[b[i : i + 4096]]
                common = (one[:, :, None] == two[:, None, :]).any(axis=2)
                first = np.where(common, one, np.iinfo(np.int64).max).min(axis=1)
                here = first == tile[a[i : i + 4096]]
                flags[a[i : i + 4096][here]] = flags[b[i : i + 4096][here]] = True
            if lists is None:
                flags[a] = flags[b] = True
        yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().filter(pa.array(flags)) for c in ("tile", "id", "component")], names=["tile", "id", "component"])


def _overlap(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of a sorted array with others."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    ends = np.cumsum(np.fromiter(map(len, others), np.int64, len(others)))
    return np.diff(np.concatenate([[0], np.cumsum(one[at] == every)])[np.concatenate([[0], ends])])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of each cell, from rows (cell, id, side, component, text) sorted by cell and side.

    A set is intersected with all of its size band in other components; what is joined already needs no more pairs. The
    block of a cell is held as sets (SETTLED bounds it), visitors pass one by one, and no text is kept.
    """
    cell, held = None, []  # (id, component, set) of the block
    for batch in batches:
        found: tuple[list[int], list[int]] = [], []
        sets = shingle_sets([t and t.encode() for t in batch.column("text").to_pylist()])
        for key, i, side, component, s in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "side", "component")), sets, strict=True):
            if key != cell:
                cell, held, root = key, [], {}

            def top(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            n, own = len(s), top(component)
            near = [x for x in held if side != 1 and top(x[1]) != own and 100 * min(n, len(x[2])) >= PERCENT * max(n, len(x[2]))] if n else []
            if near:
                both = _overlap(s, [x[2] for x in near])
                for (j, c, other), k in zip(near, both.tolist(), strict=True):
                    if 100 * k >= PERCENT * (n + len(other) - k) and top(c) != top(component):
                        found[0].append(max(i, j))
                        found[1].append(min(i, j))
                        root[top(c)] = top(component)
            if side < 2 and n:
                held.append((i, component, s))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["x", "y"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (x, y, text of x, text of y) that reach the threshold; sets of recent y are kept."""
    recent: OrderedDict[bytes, np.ndarray] = OrderedDict()
    for batch in batches:
        left = shingle_sets([t and t.encode() for t in batch.column(2).to_pylist()])
        right = [(t or "").encode() for t in batch.column(3).to_pylist()]
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, t) in enumerate(zip(left, right, strict=True)):
            mark = hashlib.blake2b(t, digest_size=16).digest()
            b = recent.pop(mark, None)
            recent[mark] = b = b if b is not None else shingle_sets([t])[0]
            if len(recent) > 64:
                recent.popitem(last=False)
            if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
                continue
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            keep[i] = 100 * both >= PERCENT * (len(a) + len(b) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _tiles(classes: DataFrame, store: Store) -> DataFrame:
    """(tile, id): each class in the tiles of its smallest hashes that another class shares."""
    rows = classes.select("id", F.explode("smallest").alias("tile"))
    # Written first, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    counts = store.table(rows.groupBy("tile").count().where("count > 1").select("tile"), "counts")
    return rows.join(counts, "tile")


def _with(rows: DataFrame, small: DataFrame, store: Store, name: str, how: str = "inner") -> DataFrame:
    """rows joined with a table by tile, by broadcast while that is small: tiles may be hot."""
    small = store.table(small, name)
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if few else small, "tile", how)


def _near() -> Column:
    """The size bands that sets of a band can link into."""
    return F.array(*(F.col("band") + d for d in (-1, 0, 1)))


def _blocks(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _hot(rows: DataFrame, weight, limit: int, store: Store, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(the rows of tiles under a limit as cells, the other rows with their band or None)."""
    totals = store.table(rows.groupBy("tile").agg(F.sum(weight).alias("w")).where(F.col("w") > limit).select("tile", F.lit(True).alias("hot")), f"{name}-hot")
    cold = lambda df: df.withColumns({"cell": F.col("tile"), "side": F.lit(0)})
    if totals.limit(1).count() == 0:
        return cold(rows), None
    both = _with(rows, totals, store, f"{name}-hot-tiles", "left")
    return cold(both.where("hot is null").drop("hot")), both.where("hot").drop("hot").withColumn("band", F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int"))


def _blocks_with_pivots(rows: DataFrame, store: Store) -> DataFrame:
    """rows (tile, id, n, bits) with cell and side: a hot tile's size bands in blocks, which its pivots all visit."""
    cold, hot = _hot(rows, F.lit(1), TILE, store, "stars")
    if hot is None:
        return cold
    count = hot.groupBy("tile", "band").agg(F.ceil(F.count("*") / TILE).alias("k")).groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("k"))  # some sixty bands at most
    hot = _with(hot, count, store, "stars-sizes")
    own = hot.select(*rows.columns, F.xxhash64("tile", "band", F.pmod(F.xxhash64("id"), F.try_element_at("k", F.col("band"))).cast("int")).alias("cell"), F.lit(0).alias("side"))
    pivots = hot.groupBy("tile", "band", F.pmod(F.xxhash64("id"), F.lit(PIVOTS))).agg(F.min_by(F.struct("id", "n", "bits"), "id").alias("p"), F.first("k").alias("k"))
    cells = F.flatten(F.transform(_near(), lambda b: F.transform(_blocks(F.try_element_at("k", b)), lambda i: F.xxhash64("tile", b, i))))
    visiting = pivots.select("tile", "p.*", F.explode(cells).alias("cell"), F.lit(0).alias("side"))
    return cold.select(own.columns).union(own).union(visiting.select(own.columns))


def _blocks_of_components(rows: DataFrame, weight, limit: int, store: Store, name: str) -> DataFrame:
    """rows (tile, id, n, component and more) with cell and side, so that each two of a tile in neighbouring size bands and
    different components meet in some cell: in a hot tile, blocks of all (side 1) meet blocks of those that aren't in its
    largest component (side 2)."""
    cold, hot = _hot(rows, weight, limit, store, name)
    if hot is None:
        return cold
    main = hot.groupBy("tile", "component").agg(F.sum(weight).alias("w")).groupBy("tile").agg(F.max_by("component", F.struct("w", "component")).alias("main"))
    hot = _with(hot, main, store, f"{name}-main").withColumn("visits", F.col("component") != F.col("main"))
    sizes = hot.groupBy("tile", "band").agg(F.ceil(F.sum(weight) / limit).alias("k"), F.ceil(F.coalesce(F.sum(F.when(F.col("visits"), weight)), F.lit(0)) / limit).alias("m"))
    sizes = sizes.groupBy("tile").agg(*(F.map_from_entries(F.collect_list(F.struct("band", c))).alias(c) for c in ("k", "m")))
    hot = _with(hot, sizes, store, f"{name}-sizes")
    block = lambda c: F.pmod(F.xxhash64("id"), F.try_element_at(c, F.col("band"))).cast("int")
    hot = hot.withColumns({"i": block("k"), "j": F.when(F.col("visits"), block("m"))})
    stays = F.flatten(F.transform(_near(), lambda b: F.transform(_blocks(F.try_element_at("m", b)), lambda j: F.xxhash64("tile", "band", "i", b, j))))
    goes = F.flatten(F.transform(_near(), lambda b: F.transform(_blocks(F.try_element_at("k", b)), lambda i: F.xxhash64("tile", b, i, "band", "j"))))
    sides = [df.select(*rows.columns, F.explode(c).alias("cell"), F.lit(k).alias("side")) for k, df, c in ((1, hot, stays), (2, hot.where("visits"), goes))]
    return cold.select(sides[0].columns).union(sides[0]).union(sides[1])


def _texts(docs: DataFrame, ids: DataFrame, store: Store, name: str) -> DataFrame:
    """The rows of docs with the ids of a table, as a table; the ids are broadcast while they are few."""
    ids = store.table(ids.distinct(), f"{name}-ids")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return store.table(docs.join(F.broadcast(ids) if few else ids, "id", "left_semi"), f"{name}-texts")


def _verify(pairs: DataFrame, docs: DataFrame, store: Store) -> DataFrame:
    """The pairs (x, y) that are linked, by the whole texts of both."""
    pairs = store.table(pairs, "pairs")
    texts = _texts(docs, pairs.select(F.explode(F.array("x", "y")).alias("id")), store, "star")
    with_x = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
    both = with_x.join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")
    return store.table(both.mapInArrow(_linked, "x long, y long").distinct(), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id), one row for each document; component_id is the smallest key reachable by links.

    A document's set holds its distinct five-word shingles, or all its words as one if it has fewer; two link at a
    Jaccard similarity of 0.75 or more. Null and empty texts have empty sets and link with nothing. Keys are integers;
    rows of equal keys count as one document with the links of all of them, and rows with a null key have a null
    component_id. Other columns are ignored.

    First each class is checked against the smallest of its candidates, which joins groups of copies along stars. Then the
    classes with candidates in other components meet with their whole sets, where every pair that is not joined by then
    is intersected; no list of pairs is written.
    """
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = store.table(docs.mapInArrow(_sets, "id long, cls binary, n long, smallest array<long>, bits binary"), "sets")
    with_set = sets.where("cls is not null and id is not null")
    classes = with_set.groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("smallest").alias("smallest"), F.first("bits").alias("bits"))
    classes = store.table(classes, "classes")
    tiles = store.table(_tiles(classes, store).join(classes.select("id", "n", "bits"), "id").select("tile", "id", "n", "bits"), "tiles")
    dealt = lambda df: df.repartition("cell").sortWithinPartitions("cell", "n", "id")
    columns = ["cell", "side", "tile", "id", "n", "bits"]
    stars = dealt(_blocks_with_pivots(tiles, store).select(columns)).mapInArrow(_stars, "x long, y long").groupBy("x").agg(F.min("y").alias("y"))
    links = _verify(stars, docs, store)
    joined = components(links, store, "star-components")
    labelled = tiles.join(joined, tiles["id"] == joined["node"], "left").select("tile", "id", "n", "bits", F.coalesce("component", "id").alias("component"))
    labelled = store.table(labelled, "labelled")
    store.drop("tiles", "pairs", "star-ids", "star-texts")
    labelled = _blocks_of_components(labelled, F.lit(1), TILE, store, "meet").select(*columns, "component")
    flagged = store.table(dealt(labelled).mapInArrow(_flagged, "tile long, id long, component long").distinct(), "flagged")
    flagged = flagged.join(classes.select("id", "n", "bits", "smallest"), "id").select("tile", "id", "n", "bits", "component", "smallest")
    flagged = _blocks_of_components(store.table(flagged, "flagged-sets"), F.lit(1), TILE, store, "place").select(*columns, "component", "smallest")
    placed = store.table(dealt(flagged).mapInArrow(_flagged, "tile long, id long, component long").distinct(), "placed")
    texts = _texts(docs, placed.select("id"), store, "rest")
    placed = _blocks_of_components(placed.join(classes.select("id", "n"), "id"), F.greatest("n", F.lit(SETTLED // TILE)), SETTLED, store, "settle").select("cell", "side", "id", "component")
    rest = placed.join(texts, "id").select("cell", "side", "id", "component", "text")
    more = rest.repartition("cell").sortWithinPartitions("cell", "side", "id").mapInArrow(_settle, "x long, y long")
    more = store.table(more.distinct(), "more")
    same = with_set.select("id", "cls").join(classes.select("cls", F.col("id").alias("rep")), "cls").where("id <> rep").select("id", "rep")
    smallest = components(links.union(more).union(same), store)
    out = sets.select("id", F.col("n").alias("n_shingles")).join(smallest, sets["id"] == smallest["node"], "left")
    out = store.table(out.select(F.col("id").cast(kind).alias(key), "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id")), "result")
    store.drop(*(n for n in store.names if n != "result"))
    return out
