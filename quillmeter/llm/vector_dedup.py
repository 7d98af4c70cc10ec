"""Near-duplicate vectors by an inverted multi-index.

The two halves of the unit vectors have codebooks of their own; a cell of their product grid holds the vectors nearest
to one centroid in each half. A query visits cells in the order of its distance to their borders, summed over the
halves (the multi-sequence order), as far as the target recall asks for; there its cosines are computed exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm._components import components
from quillmeter.llm._store import Store

COSINE, RECALL = 0.95, 0.999
#: Vectors on which codebooks and the stop are fitted at most, and those of them whose partners are looked up there.
SAMPLE, QUERIES = 20_000, 2_000
#: Vectors in a cell to aim for: a copy of each vector goes to every cell it visits, and larger cells are fewer. With it
#: the centroids of a half grow with the square root of the input, to a tenth of the sample at most.
IN_CELL, MOST_CENTROIDS = 600, SAMPLE // 10
#: Cells up to which their sizes are broadcast (under 20 bytes each); larger tables are joined by shuffle.
BROADCAST_CELLS = 1_000_000
#: Vectors of a cell compared at once; larger cells are split into blocks.
BLOCK = 2048


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (row numbers, float64 vectors) of the usable rows of a list column."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    at = np.asarray(column.offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    sizes = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[at[rows][:, None] + np.arange(d)]
        usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        out[d] = rows[usable], x[usable] + 0.0  # -0.0 and 0.0 are equal
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, (rows, x) in matrix(batch.column(1)).items():
                raw = [r.tobytes() for r in x.astype(dtype)]
                cls = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], names=["id", "cls", "vec"])

    return run


class Codebooks:
    """Centroids of both halves of unit vectors of one dimension, and how far queries go."""

    def __init__(self, sample: np.ndarray, k: int, recall: float, cosine: float):
        rng, self.half = np.random.default_rng(11), sample.shape[1] // 2
        self.centroids = [self._fit(x, min(k, len(x)), rng) for x in self.split(sample)]
        # Partners show how far a query must go to meet their cells: made-up ones at the threshold's cosine in random
        # directions, and those that queries have in the sample.
        far = rng.normal(size=sample.shape)
        far -= (far * sample).sum(axis=1, keepdims=True) * sample
        length = np.sqrt((far * far).sum(axis=1, keepdims=True))
        made = unit(cosine * sample + np.sqrt(1 - cosine**2) * far / np.maximum(length, 1e-30))
        asking = rng.choice(len(sample), min(QUERIES, len(sample)), replace=False)
        needs = [self.need(sample, made), np.zeros(0)]
        for part in np.array_split(asking, -(-len(asking) // 256)):
            i, j = np.nonzero(sample[part] @ sample.T >= cosine)
            needs[1] = np.concatenate([needs[1], self.need(sample[part[i]], sample[j])])
        stops = [np.quantile(x, recall) if len(x) >= 1000 else x.max(initial=0.0) for x in needs]
        # No partner is further than that; small tables are searched so far.
        exact = 2 - 2 * cosine
        self.stop = float(min(max(stops), exact) if len(sample) >= 1000 else exact) + 1e-9

    def need(self, x: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """How far queries x must go to visit the cell of their partner."""
        out = np.zeros(len(x))
        for k in range(0, len(x), 4096):
            rows = slice(k, k + 4096)
            codes, (a, b) = self.borders(partners[rows])[0], self.borders(x[rows])[1]
            at = np.arange(len(codes[0]))
            out[rows] = a[at, codes[0]] + b[at, codes[1]]
        return out

    @cached_property
    def between(self) -> list[np.ndarray]:
        """The distances of a half's centroids; made where they are needed."""
        return [np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c @ c.T, 1e-30)) for c in self.centroids]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "between"}

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    @staticmethod
    def _fit(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            own = np.concatenate([np.argmin((c * c).sum(axis=1) - 2 * part @ c.T, axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
            for j in np.unique(own):
                c[j] = x[own == j].mean(axis=0)
        return np.unique(c, axis=0)

    def borders(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the nearest centroid, and the squared distance to the border of every centroid's cell, which no
        vector of that cell is nearer than."""
        codes, out = [], []
        for part, c, between in zip(self.split(x), self.centroids, self.between, strict=True):
            d = (c * c).sum(axis=1) - 2 * part @ c.T
            own = np.argmin(d, axis=1)
            d -= d[np.arange(len(d)), own][:, None]
            codes.append(own)
            out.append((d / (2 * between[own])) ** 2)
            out[-1][np.arange(len(d)), own] = 0.0
        return codes, out

    def visits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, first codes, second codes): the k-th nearest centroids of the first half meet those of the second in
        rising order until the sum passes the stop."""
        a, b = self.borders(x)[1]
        order = [np.argsort(z, axis=1, kind="stable") for z in (a, b)]
        a, b = (np.take_along_axis(z, o, axis=1) for z, o in zip((a, b), order, strict=True))
        for i in range(a.shape[1]):
            rows = np.flatnonzero(a[:, i] <= self.stop)
            for j in range(b.shape[1]):
                rows = rows[a[rows, i] + b[rows, j] <= self.stop]
                if not len(rows):
                    break
                yield rows, order[0][rows, i], order[1][rows, j]
            if not len(np.flatnonzero(a[:, i] <= self.stop)):
                break


def cell(d: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (np.int64(d) << 32) | (first.astype(np.int64) << 16) | second


def _assign(shared, dtype: str, query: bool):
    """(id, copies, vec, cell): the own cell, or with query the cells to visit that come later in the grid's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, Codebooks] = shared.value
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(dtype).itemsize
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = unit(np.frombuffer(b"".join(raw[i] for i in rows.tolist()), dtype).reshape(-1, d).astype(np.float64))
                if d not in books:
                    found = [] if query else [(np.arange(len(rows)), np.zeros(len(rows), np.int64))]
                else:
                    (p, q), _ = books[d].borders(x)
                    own = cell(0, p, q)
                    found = ((r, c) for r, i, j in books[d].visits(x) for c in [cell(0, i, j)]) if query else [(np.arange(len(rows)), own)]
                for r, c in found:
                    if query:
                        later = c > own[r]
                        r, c = r[later], c[later]
                    if len(r):
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows[r])) for k in range(3)), pa.array(c + (d << 32))], names=["id", "copies", "vec", "cell"])

    return run


def _links(dtype: str, cosine: float, size: int):
    """(id, links, label) of the linked classes of each block: how many vectors they link with, and the smallest id that
    they reach there. Rows come by cell and block, first the block's own, then those that visit it."""

    def near(a: np.ndarray, ua: np.ndarray, b: np.ndarray, ub: np.ndarray) -> np.ndarray:
        g = ua @ ub.T
        close = g >= cosine
        for i, j in zip(*np.nonzero(np.abs(g - cosine) < 1e-9), strict=True):
            close[i, j] = float(a[i] @ b[j]) / (float(np.sqrt(a[i] @ a[i])) * float(np.sqrt(b[j] @ b[j]))) >= cosine
        return close

    def rows(ids, copies, links, label):
        on = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(label[on])], names=["id", "links", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)], axis=1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
                for k in range(i, j, size):
                    part = batch.slice(k, min(size, j - k))
                    ids, copies = part.column(3).to_numpy(), part.column(4).to_numpy()
                    d = int(key[i, 0]) >> 32
                    x = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype).reshape(-1, d).astype(np.float64)
                    u, mark = unit(x), tuple(key[i, :2])
                    if key[i, 2] == 0:
                        # A block's own rows; those that came before in this block are compared as well.
                        close = near(x, u, x, u)
                        np.fill_diagonal(close, False)
                        label = _settle(close, ids, ids)[0]
                        yield rows(ids, copies, close @ copies, label)
                        if at == mark:
                            yield from cross(own, (ids, copies, x, u))
                            own = tuple(np.concatenate(z) for z in zip(own, (ids, copies, x, u), strict=True))
                        else:
                            at, own = mark, (ids, copies, x, u)
                    elif at == mark:
                        yield from cross(own, (ids, copies, x, u))

    def cross(a, b):
        close = near(a[2], a[3], b[2], b[3])
        if close.any():
            one, two = _settle(close, a[0], b[0])
            yield rows(a[0], a[1], close @ b[1], one)
            yield rows(b[0], b[1], close.T @ a[1], two)

    return run


def _settle(close: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches in a block of links."""
    i, j = np.nonzero(close)
    one, two = a.copy(), b.copy()
    if a is b:
        two = one
    while len(i):
        before = one.copy(), two.copy()
        np.minimum.at(one, i, two[j])
        np.minimum.at(two, j, one[i])
        if (before[0] == one).all() and (before[1] == two).all():
            break
    return one, two


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each vector: how many others link with it directly (cosine of at
    least the threshold, in double precision), the smallest key reachable by links, and whether that is its own.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows with a null key, link with
    nothing; so do vectors of different length. Equal vectors are handled once and counted as often as they occur. Keys
    are integers; rows of equal keys are vectors of their own. Other columns are ignored.
    Codebooks and the stop are fitted on 20,000 vectors at most, chosen by hash; every vector is indexed and is a query.
    """
    spark, store = vectors.sparkSession, Store(vectors.sparkSession, "vectors")
    kind = vectors.schema[key].dataType
    dtype = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    usable = store.table(rows.where("id is not null and size(v) > 0").mapInArrow(_classes(dtype), "id long, cls binary, vec binary"), "usable")
    classes = usable.groupBy("cls").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = store.table(classes.withColumn("id", F.xxhash64("cls")), "classes")
    total = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, total))) < SAMPLE).select("vec").limit(2 * SAMPLE).collect()
    by_size: dict[int, list[bytes]] = {}
    for (v,) in sample:
        by_size.setdefault(len(v) // np.dtype(dtype).itemsize, []).append(bytes(v))
    k = int(min(MOST_CENTROIDS, max(1, round((total / IN_CELL) ** 0.5))))
    books = {d: Codebooks(unit(np.frombuffer(b"".join(v), dtype).reshape(-1, d).astype(np.float64)), k, recall, cosine) for d, v in by_size.items()}
    shared = spark.sparkContext.broadcast(books)
    ddl = "id long, copies long, vec binary, cell long"
    base = classes.select("id", "copies", "vec")
    own = store.table(base.mapInArrow(_assign(shared, dtype, False), ddl), "own")
    sizes = store.table(own.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    sizes = F.broadcast(sizes) if sizes.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else sizes
    place = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    placed = own.join(sizes, "cell").withColumn("block", place)
    visiting = base.mapInArrow(_assign(shared, dtype, True), ddl).join(sizes, "cell")
    everywhere = visiting.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    later = placed.where("block < blocks - 1").withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    columns = ["cell", "block", "kind", "id", "copies", "vec"]
    dealt = placed.withColumn("kind", F.lit(0)).select(columns).union(everywhere.union(later.select(everywhere.columns)).withColumn("kind", F.lit(1)).select(columns))
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = store.table(dealt.mapInArrow(_links(dtype, cosine, block), "id long, links long, label long"), "found")
    joined = components(found.select("id", "label"), store)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    each = classes.select("id", "cls", "copies", "smallest").join(joined, F.col("id") == F.col("node"), "left").join(links, "id", "left")
    each = store.table(each.select("cls", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("node")), "each")
    linked = each.join(each.groupBy("node").agg(F.min("smallest").alias("component")), "node").select("cls", "n_links", "component")
    linked = usable.select("id", "cls").join(linked, "cls").select("id", "n_links", "component")
    unusable = rows.where("not coalesce(id is not null and size(v) > 0, false)").select("id", F.lit(0).cast("long"), F.col("id"))
    odd = rows.where("id is not null and size(v) > 0").select("id", F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"), F.forall("v", lambda x: x == 0).alias("zero"))
    odd = odd.where("coalesce(bad, true) or coalesce(zero, false)").select("id", F.lit(0).cast("long"), F.col("id"))
    out = linked.union(unusable).union(odd).toDF("id", "n_links", "component")
    out = out.select(F.col("id").cast(kind).alias(key), "n_links", F.col("component").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
    out = store.table(out, "result")
    store.drop(*(n for n in store.names if n != "result"))
    return out
