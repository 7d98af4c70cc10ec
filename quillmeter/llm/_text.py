"""Vectorised word splitting and hashing over UTF-8 bytes, shared by the text operators.

Every function works on one joined buffer of many texts, so that a batch costs a few numpy passes and no loop
over words. Equal byte strings always hash alike. Words are hashed by mixing eight bytes at a time; spans of fixed, short
length (under a hundred bytes) by 64-bit polynomial sums with a final mix.
"""

from __future__ import annotations

import hashlib

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64

#: ASCII A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of words [^\x20\x09-\x0D]+.
NON_SPACE = np.ones(256, bool)
NON_SPACE[0x20] = NON_SPACE[0x09:0x0E] = False

#: A random odd-ish 64-bit value for each byte, so that short words spread over all bits.
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Keeps the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n, kept between calls."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        both = []
        for base in (_P, _P_INV):
            p = np.full(size, base, _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = tuple(both)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads low and high bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of byte values times P**position over buf[i:j]; one longer than buf."""
    out = np.empty(len(buf) + 1, _U)
    out[0] = 0
    np.multiply(_BYTE[buf], powers(len(buf))[0][: len(buf)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of buf[start:end] for every pair, the same wherever those bytes stand."""
    return mix((c[ends] - c[starts]) * powers(len(c))[1][starts] + (ends - starts).astype(_U))


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of every word buf[start:end]: a chain of mixes over its eight-byte parts, which is a bijection of words up
    to eight bytes of one length; long words go through BLAKE2b. Hashes of two seeds are independent."""
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # from each place
    sizes = ends - starts
    h = mix(sizes.astype(_U) * _U(_P) + _U(seed * 0x51_7CC1_B727_220A_95 % (1 << 64)))
    live, done = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(live):
        h[live] = mix(h[live] ^ (eight[starts[live] + done] & _FIRST[np.minimum(sizes[live] - done, 8)]))
        done += 8
        live = live[sizes[live] > done]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        raw = buf[starts[k] : ends[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def join(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one NUL after each, and the offset of each text with the end added; None counts as empty."""
    parts = [t or b"" for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return np.frombuffer(b"\0".join(parts) + b"\0" if parts else b"", np.uint8), bounds


def words(buf: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text, with the end added) of all words; no word crosses a text's end."""
    mask = np.zeros(len(buf) + 2, np.int8)
    mask[1:-1] = kind[buf]
    mask[bounds[1:]] = 0  # the NUL after each text; mask is shifted by one
    step = np.diff(mask)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(starts, bounds)


def hashed_words(texts: list[bytes | None], kind: np.ndarray, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """(hash of every word of the lower-cased texts, for each seed; first word of each text, with the end added)."""
    raw, bounds = join(texts)
    buf = LOWER[raw]
    starts, ends, first = words(buf, bounds, kind)
    return *(word_hash(buf, starts, ends, s) for s in seeds), first


def chunks(texts: list, size: int = 1 << 21):
    """Ranges (i, j) of texts of about size bytes in total, at least one text each; keeps the numpy passes in cache."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)
