"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the mean of five learned rows: of the word itself and of the strings of its first 3, 4 and 5 and its
last 3 bytes. Two recurrent passes read every overlapping window of 64 words; attention pools their states into one
logit. A document's score is that of its most toxic window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmeter.llm import _text
from quillmeter.llm._store import small_batches

WINDOW, STRIDE = 64, 48
ROWS, DIM, HIDDEN = 1 << 16, 8, 8
#: Labelled documents of each class that are fitted on at most, windows of a document in training, and passes.
SAMPLE, PER_DOCUMENT, EPOCHS, BATCH = 3000, 3, 4, 128
THRESHOLD = 0.3
#: Documents in which a string must occur for its row to be learned; rows of rarer ones stay zero.
LEAST_SEEN = 3
_F = np.float32


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the distinct words (n, 5), word numbers in text order, first word of each text, with the end added)."""
    raw, bounds = _text.join(texts)
    buf = _text.LOWER[raw]
    accent = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
    buf[accent] += 32  # capital letters of Latin-1
    starts, ends, first = _text.words(buf, bounds, _text.ALNUM)
    c = _text.prefix_hash(buf)
    whole = _text.span_hash(c, starts, ends)
    _, one, number = np.unique(whole, return_index=True, return_inverse=True)
    a, b = starts[one], ends[one]
    parts = [whole[one], *(_text.span_hash(c, a, np.minimum(a + k, b)) for k in (3, 4, 5)), _text.span_hash(c, np.maximum(b - 3, a), b)]
    rows = np.stack([_text.mix(p + np.uint64(k + 1)) >> np.uint64(48) for k, p in enumerate(parts)], axis=1).astype(np.int64)
    return rows, number, first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of all windows: every STRIDE words until the text's end is covered; none for no words."""
    sizes = np.diff(first)
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = step * STRIDE
    return text, first[:-1][text] + start, np.minimum(WINDOW, sizes[text] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


class Network:
    """The parameters: rows, for each direction input and state weights of the three gates, attention and output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) * 0.3).astype(_F)
        self.p = {"rows": np.zeros((ROWS, DIM), _F), "att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, _F)}
        for d in "fb":
            self.p |= {f"w{d}": draw(DIM, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, _F)}

    def _steps(self, d: str, active: list[int]) -> list[int]:
        steps = [t for t in range(len(active)) if active[t]]
        return steps if d == "f" else steps[::-1]

    def forward(self, x: np.ndarray, active: list[int], keep: bool = False):
        """Logits of windows sorted by falling length; x: inputs (step, window, DIM), active: windows longer than each step."""
        p, n = self.p, x.shape[1]
        states, saved = np.zeros((x.shape[0], n, 2 * HIDDEN), _F), {}
        for d, at in (("f", 0), ("b", HIDDEN)):
            g = x @ p[f"w{d}"] + p[f"c{d}"]
            h, u = np.zeros((n, HIDDEN), _F), p[f"u{d}"]
            for t in self._steps(d, active):
                k = active[t]
                old = h[:k].copy() if keep else h[:k]
                s, gt = old @ u, g[t, :k]
                zr = _sigmoid(gt[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(gt[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                new = c + z * (old - c)
                h[:k] = new
                states[t, :k, at : at + HIDDEN] = new
                if keep:
                    saved[d, t] = old, z, r, c, s[:, 2 * HIDDEN :]
        scores = states @ p["att"]
        for t in range(x.shape[0]):
            scores[t, active[t] :] = -np.inf
        scores = np.exp(scores - scores.max(axis=0))
        alpha = scores / scores.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, states, alpha, pooled, saved) if keep else logits

    def gradients(self, x: np.ndarray, active: list[int], y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted cross-entropy, by parameter, and of the inputs."""
        p = self.p
        logits, states, alpha, pooled, saved = self.forward(x, active, keep=True)
        d_logit = ((_sigmoid(logits) - y) * weight / len(y)).astype(_F)
        grad = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_alpha = np.einsum("tnh,nh->tn", states, d_pool)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["att"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = alpha[:, :, None] * d_pool + d_score[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for d, at in (("f", 0), ("b", HIDDEN)):
            w, u = p[f"w{d}"], p[f"u{d}"]
            gw, gu, gc = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * HIDDEN, _F)
            dh = np.zeros((x.shape[1], HIDDEN), _F)
            for t in self._steps(d, active)[::-1]:
                k = active[t]
                old, z, r, c, s = saved[d, t]
                d_new = dh[:k] + d_states[t, :k, at : at + HIDDEN]
                dc = d_new * (1 - z) * (1 - c * c)
                dz = d_new * (old - c) * z * (1 - z)
                dr = dc * s * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                gw += x[t, :k].T @ gates
                gc += gates.sum(axis=0)
                gu += old.T @ inner
                dx[t, :k] += gates @ w.T
                dh[:k] = d_new * z + inner @ u.T
            grad |= {f"w{d}": gw, f"u{d}": gu, f"c{d}": gc}
        return grad, dx

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        """The input of each distinct word."""
        return sum(self.p["rows"][rows[:, k]] for k in range(rows.shape[1])) * _F(1 / rows.shape[1])

    def window_logits(self, vectors: np.ndarray, number: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        out = np.zeros(len(start), _F)
        for i in range(0, len(order), 2048):
            part = order[i : i + 2048]
            at, active = _places(start[part], length[part], len(number))
            out[part] = self.forward(vectors[number[at]], active)
        return out


def _places(start: np.ndarray, length: np.ndarray, words: int) -> tuple[np.ndarray, list[int]]:
    """(word places (step, window), active windows of each step) for windows sorted by falling length."""
    steps = np.arange(int(length[0]))[:, None]
    return np.minimum(start + steps, words - 1), [int((length > t).sum()) for t in range(len(steps))]


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = 5, share: float | None = None) -> Network | None:
    """A network fitted to labelled documents; None if one of the classes is missing.

    share: of toxic ones among all labelled documents that these were drawn from, to which scores are calibrated
    (default: their own).

    The rows begin with the smoothed log-odds of their strings. Of each document the windows with the largest log-odds
    are learned from (of clean ones a random one as well), since toxic documents hold harmless windows too.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    raw = [t and t.encode() for t in texts]
    parts, bad, good = [], np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64)
    for i, j in _text.chunks(raw, 1 << 20):
        rows, number, first = words(raw[i:j])
        doc = np.repeat(np.arange(j - i), np.diff(first))
        seen = np.unique(doc * np.int64(len(rows)) + number)
        pairs = np.unique(((seen // max(1, len(rows)))[:, None] * ROWS + rows[seen % max(1, len(rows))]).ravel())
        for v, into in ((True, bad), (False, good)):
            into += np.bincount(pairs[toxic[i + pairs // ROWS] == v] % ROWS, minlength=ROWS)
        parts.append((rows, number + sum(len(p[0]) for p in parts), np.diff(first)))
    rows, number, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.concatenate([[0], np.cumsum(sizes)])
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    odds *= (bad + good) / (bad + good + 3.0)
    odds[bad + good < LEAST_SEEN] = 0
    net.p["rows"][:, 0] = odds / 2
    text, start, length = windows(first)
    if not toxic[text].any() or toxic[text].all():  # one class has no words
        return net
    # A window's log-odds: its largest word.
    value = odds[rows].mean(axis=1)[number]
    best = np.array([value[s : s + n].max() for s, n in zip(start.tolist(), length.tolist(), strict=True)]) if len(start) else np.zeros(0)
    order = np.lexsort((-best, text))
    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    chosen = order[place < PER_DOCUMENT - 1]
    keep = np.ones(len(chosen), bool)
    odd = toxic[text[chosen]]
    keep[odd & (best[chosen] < np.median(best[chosen][odd]) / 3) & (place[place < PER_DOCUMENT - 1] > 0)] = False
    some = np.flatnonzero(~toxic[text])
    chosen = np.unique(np.concatenate([chosen[keep], rng.choice(some, min(len(some), int((~toxic).sum())), replace=False)]))
    y = toxic[text[chosen]].astype(_F)
    share = toxic.mean() if share is None else share
    weight = np.where(y > 0, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6)).astype(_F)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k != "rows"}
    known = bad + good >= LEAST_SEEN
    slow, step = np.full(ROWS, 1e-4, _F), 0
    epochs = max(EPOCHS, min(30, 60 * BATCH * EPOCHS // max(1, len(chosen))))
    for _ in range(epochs):
        mixed = rng.permutation(len(chosen))
        for i in range(0, len(mixed), BATCH):
            part = mixed[i : i + BATCH]
            part = part[np.argsort(-length[chosen[part]], kind="stable")]
            w = chosen[part]
            at, active = _places(start[w], length[w], len(number))
            used, inverse = np.unique(number[at], return_inverse=True)
            inverse = inverse.reshape(at.shape)
            x = net.inputs(rows[used])[inverse]
            grad, dx = net.gradients(x, active, y[part], weight[part])
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(_F)
            of_word = np.zeros((len(used), DIM), _F)
            np.add.at(of_word, inverse, dx)  # steps after a window's end have no gradient
            touched, back = np.unique(rows[used].ravel(), return_inverse=True)
            of_row = np.zeros((len(touched), DIM), _F)
            np.add.at(of_row, back, np.repeat(of_word, rows.shape[1], axis=0) / rows.shape[1])
            slow[touched] += (of_row * of_row).mean(axis=1)
            net.p["rows"][touched] -= 0.03 * of_row / np.sqrt(slow[touched])[:, None] * known[touched][:, None]
    return net


def score_texts(net: Network | None, texts: list[str | None]) -> np.ndarray:
    """The score of each text: of its most toxic window; that of an empty window for texts without words."""
    raw = [t and t.encode() for t in texts]
    out = []
    for i, j in _text.chunks(raw, 1 << 20):
        if net is None:
            out.append(np.zeros(j - i))
            continue
        rows, number, first = words(raw[i:j])
        text, start, length = windows(first)
        best = np.full(j - i, net.p["bias"][0], np.float64)
        if len(start):
            logits = net.window_logits(net.inputs(rows), number, start, length)
            some = np.flatnonzero(np.diff(first) > 0)
            best[some] = np.maximum.reduceat(logits, np.searchsorted(text, some)).astype(np.float64)
        out.append(1 / (1 + np.exp(-np.clip(best, -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def _known(labels: DataFrame, key: str, held_out) -> DataFrame:
    return labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max("toxic").alias("toxic"))


def toxic_share(docs: DataFrame, labels: DataFrame, key: str, held_out) -> float | None:
    """The share of toxic ones among all labelled documents that aren't held out; None if there are none."""
    found = _known(labels, key, held_out).where("toxic in (0, 1)").join(docs.select(key), key, "left_semi")
    counts = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    return counts.get(1, 0) / sum(counts.values()) if counts else None


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, held_out) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled documents of each class that aren't held out, chosen by hash of the id."""
    known = _known(labels, key, held_out)
    by_hash = lambda v: known.where(F.col("toxic") == v).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    few = by_hash(1).union(by_hash(0)).withColumnRenamed(key, "_k")
    found = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(few), "_k").select("_k", "text", "toxic")
    return found.dropDuplicates(["_k"]).orderBy(F.xxhash64("_k"), "_k").limit(2 * SAMPLE)


def held_out(key):
    """The fold that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of docs (default: all) with held_out, score (0 to 1) and predicted (1 if the score reaches the
    threshold, else 0), one row for each document; nothing is shuffled.

    The network is fitted on the driver to a bounded sample of labelled rows, weighted by the classes' counts over all
    labelled rows, then scores every whole text. Null and
    empty texts get the score of an empty window. Without toxic or without clean labels every score is 0. A null id is
    not held out. Repeated rows score alike. Columns of docs with the names added are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = ["held_out", "score", "predicted"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    labels = labels.select(key, "toxic")
    rows = training_rows(docs, labels, key, text, held_out).collect()
    share = toxic_share(docs, labels, key, held_out)
    shared = spark.sparkContext.broadcast(fit([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool), share=share))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score_texts(shared.value, batch.tolist()))

    out = docs.select(*(f"`{c}`" for c in keep), held_out(F.col(key)).alias("held_out"), score(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
