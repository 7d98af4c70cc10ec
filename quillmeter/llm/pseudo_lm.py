"""Document scores by masked pseudo-likelihood.

A network reads three words to either side of a masked word and predicts it by a walk from the root of a tree of all
symbols down to the word: a step's direction is a logistic function of the hidden layer. The tree is Huffman's, so a walk
has about as many steps as the word has bits of surprise by its frequency, and cost grows with the logarithm of the
symbols. A document's score sums the logarithms of the conditional probabilities of all its words.

Symbols are the words that occur LEAST times in the corpus, of which only those above a frequency where there are more
than a bound that grows with the corpus (see room). All other words are one symbol for the network and are then spelt
byte by byte, each given the one before, by a model counted over all such words. So every word has a probability of its
own, and both vocabulary and spelling grow with what the corpus holds.

Training is data-parallel: every task starts from the shared parameters, learns from a share of its documents' words,
another one in each round, and hands on how far the rows of parameters moved that its words touched, in half precision. A
row moves by the mean of the tasks that touched it, weighted by how often they did. All documents take part in each round, and over the rounds
every word is masked once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillmeter.llm import _text
from quillmeter.llm._store import Store

#: Occurrences from which a word is a symbol; symbols are at most ROOM times the corpus' words to the power of GROWTH.
LEAST, ROOM, GROWTH = 5, 1250, 0.25
REACH, DIM, HIDDEN = 3, 12, 16
#: Rounds of training, the share of words masked in each, and words in a step: fewer where texts are so few that there
#: would be less than STEPS steps.
ROUNDS, SHARE, BATCH, SMALLEST_BATCH, STEPS = 2, 0.5, 4096, 256, 16
#: Nodes next to the root that training and scoring take one by one, and words that scoring sorts at once.
TOP, SPLIT, BLOCK = 32, 1024, 1 << 18
#: Words of a task at least, unless cores would idle: each task hands on a copy of what it touched.
TASK_WORDS = 2_000_000
#: Rows of a block of parameters, tasks whose blocks are summed in one group, and the blocks of what all words share.
CHUNK, FAN_IN, DENSE, SPELLING = 1024, 64, -1, -2
_F = np.float32
_OFFSETS = np.array([k for k in range(-REACH, REACH + 1) if k])
#: Stands for a word's border in spellings.
_EDGE = 256


def room(words: float) -> int:
    """Symbols at most in a corpus of so many words: 56,000 for four million, 395,000 for ten billion, 2.5 million (400 MB of
    parameters) for the 16 trillion of 100 TB."""
    return int(ROOM * max(words, 1.0) ** GROWTH)


class Tree:
    """Huffman's tree over symbols by their counts; inner nodes are numbered from the root, which is 0.

    The walk to symbol s takes the steps first[s] up to first[s + 1]: at node[k] to the side right[k] (1 or 0). Steps go
    from the symbol to the root, so those at nodes from TOP on, deep[s] of them, come first.

    rank numbers the symbols from left to right. Those below node v < SPLIT have the ranks from spans[v, 0] to spans[v, 2],
    to its right from spans[v, 1] on.
    """

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        leaves = deque(sorted(range(n), key=lambda i: (counts[i], -i)))
        inner: deque[int] = deque()
        weight = [*counts.tolist(), *[0.0] * (n - 1)]
        above, side = np.full(max(2 * n - 1, 1), -1, np.int64), np.zeros(max(2 * n - 1, 1), np.int8)
        below, leaves_of = [], [1] * n

        def lightest() -> int:
            return leaves.popleft() if not inner or (leaves and weight[leaves[0]] <= weight[inner[0]]) else inner.popleft()

        for new in range(n, 2 * n - 1):
            left, right = lightest(), lightest()
            above[left] = above[right] = new
            side[right], weight[new] = 1, weight[left] + weight[right]
            inner.append(new)
            below.append((left, right))
            leaves_of.append(leaves_of[left] + leaves_of[right])
        begin, spans = [0] * max(2 * n - 1, 1), []
        for new in range(2 * n - 2, n - 1, -1):
            left, right = below[new - n]
            begin[left], begin[right] = begin[new], begin[new] + leaves_of[left]
            if len(spans) < SPLIT:
                spans.append((begin[new], begin[right], begin[new] + leaves_of[new]))
        self.rank, self.spans = np.array(begin[:n], np.int32), np.array(spans, np.int32).reshape(-1, 3)
        owner, node, turn = [], [], []
        at, symbol = np.arange(n), np.arange(n)
        while len(live := np.flatnonzero(above[at] >= 0)):
            at, symbol = at[live], symbol[live]
            owner.append(symbol)
            node.append(2 * n - 2 - above[at])
            turn.append(side[at])
            at = above[at]
        none = [np.zeros(0, np.int64)]
        owner = np.concatenate(owner or none)
        order = np.argsort(owner, kind="stable")
        self.node = np.concatenate(node or none)[order].astype(np.int32)
        self.right = np.concatenate(turn or none)[order].astype(_F)
        self.first = np.searchsorted(owner[order], np.arange(n + 1))
        self.deep, self.deeper = (np.bincount(owner[order][self.node >= edge], minlength=n).astype(np.int16) for edge in (TOP, SPLIT))
        self.sides = np.zeros((max(n - 1, 1), 2))
        children = np.flatnonzero(above >= 0)
        self.sides[2 * n - 2 - above[children], side[children]] = np.array(weight)[children]

    def deepest_first(self, symbols: np.ndarray) -> np.ndarray:
        """The order of symbols in which far() takes them."""
        return np.argsort(-self.deep[symbols], kind="stable")

    def far(self, symbols: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """(levels, node, side) of the steps at nodes from TOP on: the first one of every symbol, then the second one of those
        that have one, and so on. A level (size, begin, end) has the steps from begin to end, of the first size symbols."""
        begins, levels, at = self.first[symbols], [], 0
        for size in (len(symbols) - np.cumsum(np.bincount(self.deep[symbols]))[:-1]).tolist():
            levels.append((size, at, at + size))
            at += size
        k = np.concatenate([begins[:size] + i for i, (size, _, _) in enumerate(levels)] or [begins[:0]])
        return levels, self.node.take(k), self.right.take(k)


class Vocabulary:
    """Symbols of word hashes by falling frequency; the symbol after the last one stands for all other words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, others: float):
        """counts: of the words in their order; others: how often all other words occur."""
        self.words, self.order = len(hashes), np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.counts = np.append(counts, others).astype(np.float64)
        self.tree = Tree(self.counts + 0.5)

    @cached_property
    def _begins(self) -> tuple[np.uint64, np.ndarray]:
        """(shift, where hashes begin that are at least i << shift), two to four times as many as hashes; made in tasks."""
        bits = self.words.bit_length() + 1
        shift = np.uint64(64 - bits)
        return shift, np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(len(hashes), np.int64)
        # Hashes are spread evenly, so the place is next to where their first bits begin.
        shift, begins = self._begins
        at, last = begins.take((hashes >> shift).astype(np.intp)), self.words - 1
        live = np.flatnonzero((at < last) & (self.hashes.take(at, mode="clip") < hashes))
        while len(live):
            at[live] += 1
            live = live[(at[live] < last) & (self.hashes.take(at[live], mode="clip") < hashes[live])]
        np.minimum(at, last, out=at)
        return np.where(self.hashes.take(at) == hashes, self.order.take(at), self.words)


class Network:
    """rows: what symbols enter as (the last is for places beyond a text); mix: from each offset to the hidden layer;
    node: from there to the steps of the tree, with a bias as the last column."""

    SHARED = {"mix": (2 * REACH, DIM, HIDDEN), "bias": (HIDDEN,)}
    BY_ROW = ("rows", "node")

    def __init__(self, p: dict[str, np.ndarray], tree: Tree):
        self.p, self.tree = p, tree

    @classmethod
    def fresh(cls, tree: Tree, seed: int = 3) -> Network:
        """Small random weights; the biases are the symbols' frequencies."""
        rng, n = np.random.default_rng(seed), len(tree.first) - 1
        draw = lambda *shape: (rng.standard_normal(shape, _F) * _F(0.1))
        node = draw(len(tree.sides), HIDDEN + 1)
        node[:, -1] = np.log(np.maximum(tree.sides[:, 1], 0.5) / np.maximum(tree.sides[:, 0], 0.5))
        return cls({"rows": draw(n + 1, DIM), "node": node, "mix": draw(*cls.SHARED["mix"]), "bias": np.zeros(HIDDEN, _F)}, tree)

    def copy(self) -> Network:
        return Network({k: v.copy() for k, v in self.p.items()}, self.tree)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What neighbours enter the hidden layer by: the rows, and the mix of all offsets one below the other."""
        return self.p["rows"], self.p["mix"].reshape(-1, HIDDEN)

    def log_likelihood(self, tables: tuple[np.ndarray, np.ndarray], seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The logarithm of each position's symbol's probability between its neighbours."""
        out, node, tree = np.zeros(len(at)), self.p["node"], self.tree
        rows, mix = tables
        for i in range(0, len(at), BLOCK):
            where = at[i : i + BLOCK]
            h = np.ones((len(where), HIDDEN + 1), node.dtype)
            for k in range(0, len(where), 1 << 12):
                near = seq.take(where[k : k + (1 << 12), None] + _OFFSETS)
                np.tanh(rows.take(near, axis=0).reshape(len(near), -1) @ mix + self.p["bias"], out=h[k : k + (1 << 12), :-1])
            rank, order = _ranked(tree.rank.take(seq.take(where)))
            where = where.take(order)
            symbols = seq.take(where)
            h = h.take(order, axis=0)
            # Sorted like the leaves, all words below a node stand together.
            total, edges = np.zeros(len(where)), np.searchsorted(rank, tree.spans)
            for v in np.flatnonzero(edges[:, 2] > edges[:, 0]).tolist():
                left, right, end = edges[v].tolist()
                z = h[left:end] @ node[v]
                np.negative(z[right - left :], out=z[right - left :])
                total[left:end] += _surprise(z)
            begins = tree.first.take(symbols)
            owner, k = _ranges(begins, tree.deeper.take(symbols))
            for j in range(0, len(k), 1 << 14):
                own, step = owner[j : j + (1 << 14)], k[j : j + (1 << 14)]
                z = np.einsum("ij,ij->i", node.take(tree.node.take(step), axis=0), h.take(own, axis=0))
                first = own[0]
                cost = np.bincount(own - first, _surprise(z * (1 - 2 * tree.right.take(step))))
                total[first : first + len(cost)] += cost
            out[i + order] = -total
        return out

    def step(self, seq: np.ndarray, at: np.ndarray, state: dict, rate: float = 0.01) -> None:
        """One step on the mean negative log-likelihood of the positions: Adam for what all words share, AdaGrad by row for
        rows and nodes, of which only those that take part are touched; state counts how often."""
        p, n = self.p, len(at)
        rank, order = _ranked(self.tree.rank.take(seq.take(at)))
        at = at.take(order)
        near = seq.take(at + _OFFSETS[:, None])
        x = p["rows"].take(near.T, axis=0).reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), p["node"].dtype)  # the last column meets the biases
        np.tanh(x @ p["mix"].reshape(-1, HIDDEN) + p["bias"], out=h[:, :-1])
        dh, symbols = np.zeros_like(h), seq.take(at)
        order = self.tree.deepest_first(symbols)
        levels, node, right = self.tree.far(symbols[order])
        if len(node):
            own = h.take(order, axis=0)
            w, z = p["node"].take(node, axis=0), np.empty(len(node), h.dtype)
            for size, begin, end in levels:
                np.einsum("ij,ij->i", w[begin:end], own[:size], out=z[begin:end])
            g = _chance(z) - right
            w *= g[:, None]
            g /= _F(n)
            back, across, moves = np.empty((HIDDEN + 1, len(node)), h.dtype), np.ascontiguousarray(own.T), np.zeros_like(h)
            for size, begin, end in levels:
                moves[:size] += w[begin:end]
                np.multiply(across[:, :size], g[begin:end], out=back[:, begin:end])
            _whole(dh)[order] = _whole(moves)
        # Most steps are at few nodes. The words below one stand together, as they are sorted like the leaves.
        spans = self.tree.spans[:TOP]
        w, edges = p["node"][: len(spans)], np.searchsorted(rank, spans)
        times = edges[:, 2] - edges[:, 0]
        ends = np.cumsum(times)
        g, places = np.empty(times.sum(), h.dtype), list(zip(*edges.T.tolist(), (ends - times).tolist(), ends.tolist(), strict=True))
        for v, (left, _, right, begin, end) in enumerate(places):
            np.dot(h[left:right], w[v], out=g[begin:end])
        g, by_node = _chance(g), np.zeros((len(w), n), h.dtype)
        for v, (left, middle, right, begin, end) in enumerate(places):
            g[begin + middle - left : end] -= 1
            by_node[v, left:right] = g[begin:end]
        dh += by_node.T @ w
        total = by_node @ h / _F(n)
        if len(node):
            self._descend("node", *_summed(node, back, self._held("node", state)[2]), state, rate)
        self._descend("node", np.arange(len(w)), total, times, state, rate)
        d = dh[:, :-1] * (1 - h[:, :-1] ** 2)
        back = p["mix"].transpose(1, 0, 2).reshape(-1, HIDDEN) @ (d.T / _F(n))
        grad = {"bias": np.ones(n, d.dtype) @ d, "mix": (x.T @ d).reshape(p["mix"].shape)}
        self._descend("rows", *_summed(near.ravel(), back.reshape(DIM, -1), self._held("rows", state)[2]), state, rate)
        state["t"] = t = state.get("t", 0) + 1
        for k, g in grad.items():
            m, v = state.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            g = g / _F(n)
            m += _F(0.1) * (g - m)
            v += _F(0.01) * (g * g - v)
            p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(_F)

    def _held(self, name: str, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What state holds for each row: the sum of its squared gradients, how often it took part, and room for _summed."""
        if name not in state:
            n = len(self.p[name])
            state[name] = np.full(n, 1e-8, _F), np.zeros(n, np.int64), np.zeros(n, np.intp)
        return state[name]

    def _descend(self, name: str, at: np.ndarray, grad: np.ndarray, times: np.ndarray, state: dict, rate: float) -> None:
        """AdaGrad on the rows at, with one learning rate for each."""
        p = self.p[name]
        slow, seen, _ = self._held(name, state)
        now = slow.take(at) + np.einsum("ij,ij->i", grad, grad) / _F(grad.shape[1])
        slow[at] = now
        seen[at] += times
        moved = p.take(at, axis=0)
        moved -= grad * (_F(5 * rate) / np.sqrt(now))[:, None]
        _whole(p)[at] = _whole(moved)


def _whole(rows: np.ndarray) -> np.ndarray:
    """Each row as one value, which is written several times as fast."""
    return rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel()


def _chance(z: np.ndarray) -> np.ndarray:
    """The logistic function."""
    return 1 / (1 + np.exp(-np.clip(z, -80, 80)))


def _surprise(z: np.ndarray) -> np.ndarray:
    """The negative logarithm of the chance that a step isn't taken to the right."""
    return np.log(1 + np.exp(-np.abs(z))) + np.maximum(z, 0)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values in order, their places)."""
    bits = len(values).bit_length()
    both = np.sort((values.astype(np.int64) << bits) | np.arange(len(values)))  # far faster than argsort
    return both >> bits, both & ((1 << bits) - 1)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(its number, value) of all values of ranges, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(total[-1] if len(total) else 0) + np.repeat(begins + sizes - total, sizes)


def _summed(at: np.ndarray, columns: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers, sum of the values of each as a row, how many); columns has the values' components one by one, and
    place is room for a value of each number. The values themselves aren't sorted."""
    turn = np.arange(len(at))
    place[at] = turn  # one of each number's stays
    distinct = np.sort(at[place.take(at) == turn])  # for rows next to each other in memory
    place[distinct] = turn[: len(distinct)]
    where = place.take(at)
    out = np.zeros((len(columns), len(distinct)), columns.dtype)
    for total, values in zip(out, columns, strict=True):
        np.add.at(total, where, values)
    return distinct, np.ascontiguousarray(out.T), np.bincount(where, minlength=len(distinct))


class Text:
    """Texts as symbols: seq with REACH pads around each text, at (places of the words), counts (words of each text), and
    the byte pairs of the words that are no symbols, as pair = before * 257 + byte, with the word's number in owner."""

    def __init__(self, voc: Vocabulary, texts: list[bytes | None]):
        raw, bounds = _text.join(texts)
        buf = _text.LOWER[raw]
        starts, ends, first = _text.words(buf, bounds, _text.ALNUM)
        symbols = voc.symbols(_text.word_hash(buf, starts, ends))
        self.counts = np.diff(first)
        self.at = np.arange(len(starts)) + REACH * (1 + np.repeat(np.arange(len(texts)), self.counts))
        self.seq = np.full(len(starts) + REACH * (len(texts) + 1), voc.words + 1, np.int64)
        self.seq[self.at] = symbols
        self.spelt = np.flatnonzero(symbols == voc.words)
        self._words = buf, starts[self.spelt], ends[self.spelt]

    @cached_property
    def owner(self) -> np.ndarray:
        _, starts, ends = self._words  # the border behind each word is spelt as well
        return np.repeat(np.arange(len(self.spelt)), ends - starts + 1)

    @cached_property
    def pair(self) -> np.ndarray:
        buf, starts, ends = self._words
        sizes = ends - starts + 1
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = starts[self.owner] + step
        byte = buf[np.minimum(place, len(buf) - 1)].astype(np.int64)  # a batch ends with a NUL at least
        byte[step == sizes[self.owner] - 1] = _EDGE
        before = np.where(step == 0, _EDGE, np.concatenate([[_EDGE], byte[:-1]]))
        return before * (_EDGE + 1) + byte


def spelling(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of each byte (or border) given the one before, from counts of pairs."""
    grid = counts.reshape(_EDGE + 1, _EDGE + 1) + 0.01
    return np.log(grid / grid.sum(axis=1, keepdims=True)).ravel()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of the words of a task's documents, in tables of bounded size."""
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged(parts):
        h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return h, np.bincount(back, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)

    out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], names=["hash", "n"])
    for batch in batches:
        texts = [t and t.encode() for t in batch.column(0).to_pylist()]
        parts = [held]
        for i, j in _text.chunks(texts):
            h, n = np.unique(_text.hashed_words(texts[i:j], _text.ALNUM)[0], return_counts=True)
            parts.append((h, n))
        held = merged(parts)
        if len(held[0]) > 2_000_000:
            yield out(held)
            held = held[0][:0], held[1][:0]
    yield out(held)


def vocabulary(docs: DataFrame, store: Store, text: str = "text", least: int = LEAST) -> Vocabulary:
    """Counted over all documents; the driver gets the words that are symbols, and one sum for all others.

    Where more words than there is room for reach least, the frequency from which on they fit takes its place: no word is
    preferred to another one of its frequency, and none is sorted.
    """
    counts = store.table(docs.select(text).mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # By the frequency's power of two first: at most 64 rows; then by the frequencies of the power in which room ends.
    most, above, frequent = room(total), 0, counts.where(F.col("n") >= least)
    power = F.floor(F.log2(F.col("n"))).cast("int")
    for r in sorted(frequent.groupBy(power.alias("p")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["p"]):
        if above + r["words"] > most:
            low = max(1 << r["p"], least)
            part = 1 + (low >> 10)  # steps of frequency: at most 1024 rows
            cells = frequent.where(power == r["p"]).groupBy(F.expr(f"(n - {low}) div {part}").alias("c")).agg(F.count("*").alias("words"))
            least = 2 << r["p"]
            for c in sorted(cells.collect(), key=lambda c: -c["c"]):
                above += c["words"]
                if above > most:
                    break
                least = low + c["c"] * part
            break
        above += r["words"]
    top = sorted(((r["n"], r["hash"]) for r in counts.where(F.col("n") >= least).collect()), key=lambda r: (-r[0], r[1]))
    store.drop("counts")
    n = np.array([r[0] for r in top], np.float64)
    return Vocabulary(np.array([r[1] for r in top], np.int64).view(np.uint64), n, total - n.sum())


def _learn(shared, number: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, start = shared.value
        net, state, learned, pairs = start.copy(), {}, 0, np.zeros((_EDGE + 1) ** 2)
        for batch in batches:
            texts = [t and t.encode() for t in batch.column(0).to_pylist()]
            for i, j in _text.chunks(texts):
                x = Text(voc, texts[i:j])
                # The same draws in every round, of which each takes another part.
                rng = np.random.default_rng([len(x.at), int(x.seq.sum() % (1 << 31))])
                draw = rng.random(len(x.at))
                masked = rng.permutation(x.at[(draw >= share * number) & (draw < share * (number + 1))])
                size = min(BATCH, max(SMALLEST_BATCH, len(masked) // STEPS))
                for k in range(0, len(masked), size):
                    net.step(x.seq, masked[k : k + size], state)
                learned += len(masked)
                if number == 0:
                    pairs += np.bincount(x.pair, minlength=len(pairs))
        slot = TaskContext.get().partitionId()
        if pairs.any():
            yield _row("spelling", SPELLING, slot, [0], [1], pairs)
        if learned:
            yield _row("shared", DENSE, slot, [0], [learned], np.concatenate([(net.p[k] - start.p[k]).ravel() for k in net.SHARED]))
            for name in net.BY_ROW:
                if name in state:
                    seen = state[name][1]
                    for k in range(0, len(seen), CHUNK):
                        at = np.flatnonzero(seen[k : k + CHUNK])
                        if len(at):
                            yield _row(name, k // CHUNK, slot, at, seen[k + at], net.p[name][k + at] - start.p[name][k + at])

    return run


#: A block of parameters: the numbers of its rows, by what each is weighted, and how far each moved.
_DDL = "name string, block long, slot long, at binary, n binary, p binary"
_BLOCKS = pa.schema([("name", pa.string()), ("block", pa.int64()), ("slot", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("p", pa.binary())])


def _kind(name: str) -> type:
    return np.float16 if name in Network.BY_ROW else _F


def _row(name: str, block: int, slot: int, at, n, p: np.ndarray) -> pa.RecordBatch:
    packed = np.asarray(at, np.int32).tobytes(), np.asarray(n, _F).tobytes(), p.astype(_kind(name)).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((name, block, slot, *packed), _BLOCKS, strict=True)], schema=_BLOCKS)


def _unrow(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(r["at"], np.int32)
    return at, np.frombuffer(r["n"], _F), np.frombuffer(r["p"], _kind(r["name"])).reshape(len(at), -1).astype(_F)


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean move of each row of a block, weighted by how often tasks touched it."""
    weight = total = None
    for r in pdf.to_dict("records"):
        at, n, p = _unrow(r)
        if total is None:
            weight, total = np.zeros(CHUNK), np.zeros((CHUNK if r["block"] >= 0 else 1, p.shape[1]))
        weight[at] += n
        total[at] += n[:, None] * p
    at = np.flatnonzero(weight)
    out = _row(pdf["name"].iloc[0], int(pdf["block"].iloc[0]), int(pdf["slot"].iloc[0]) // FAN_IN, at, weight[at], total[at] / weight[at][:, None])
    return out.to_pandas()


def train(docs: DataFrame, voc: Vocabulary, text: str = "text", rounds: int = ROUNDS, share: float = SHARE) -> tuple[Network, np.ndarray]:
    """(network, spelling) after the rounds. Blocks are averaged in groups of at most FAN_IN tasks, and these in groups
    of FAN_IN groups, until one is left; the driver gets one copy."""
    spark, net = docs.sparkSession, Network.fresh(voc.tree)
    pairs, most = np.zeros((_EDGE + 1) ** 2), max(spark.sparkContext.defaultParallelism, int(voc.counts.sum() / TASK_WORDS))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((voc, net))
        found, tasks = docs.select(text).coalesce(most).mapInArrow(_learn(shared, k, share), _DDL), most
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            found = found.groupBy("name", "block", F.expr(f"slot div {FAN_IN}")).applyInPandas(lambda key, pdf: _mean(pdf), _DDL)
        found = found.groupBy("name", "block").applyInPandas(_mean, _DDL)
        net = net.copy()
        for r in found.collect():
            at, n, p = _unrow(r)
            if r["block"] == SPELLING:  # a mean of counts times the number of tasks is their sum
                pairs = n[0] * p[0].astype(np.float64)
            elif r["block"] == DENSE:
                edge = int(np.prod(net.SHARED["mix"]))
                net.p["mix"] += p[0, :edge].reshape(net.SHARED["mix"])
                net.p["bias"] += p[0, edge:]
            else:
                net.p[r["name"]][r["block"] * CHUNK + at] += p
    return net, spelling(pairs)


def score_texts(voc: Vocabulary, net: Network, spelt: np.ndarray, tables: list[np.ndarray], texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probability of all words) of each text."""
    x = Text(voc, texts)
    lp = net.log_likelihood(tables, x.seq, x.at)
    if len(x.spelt):
        lp[x.spelt] += np.bincount(x.owner, spelt[x.pair], len(x.spelt))
    return x.counts, np.bincount(np.repeat(np.arange(len(texts)), x.counts), lp, len(texts))


def score_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """The kept columns of docs (default: all) with n_words, log_likelihood (natural logarithm, summed over all words)
    and score (its mean for a word), one row for each document.

    Null and empty texts have no words, a log_likelihood of 0 and a null score. Repeated rows score alike and count as
    often as they occur. Columns of docs with the names added are replaced.
    """
    store = Store(docs.sparkSession, "lm")
    own = ["n_words", "log_likelihood", "score"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    voc = vocabulary(docs, store, text, least)
    shared = docs.sparkSession.sparkContext.broadcast((voc, *train(docs, voc, text, rounds, share)))

    @F.pandas_udf(StructType([StructField("n_words", LongType()), StructField("log_likelihood", DoubleType())]))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, net, spelt = shared.value
        tables = net.tables()
        for batch in batches:
            texts = [t and t.encode() for t in batch]
            parts = [score_texts(known, net, spelt, tables, texts[i:j]) for i, j in _text.chunks(texts)]
            yield pd.DataFrame({"n_words": np.concatenate([p[0] for p in parts]), "log_likelihood": np.concatenate([p[1] for p in parts])})

    found = score(F.col(text))
    out = docs.select(*(f"`{c}`" for c in keep), found.alias("log_likelihood")).select(*(f"`{c}`" for c in keep), "log_likelihood.*")
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
