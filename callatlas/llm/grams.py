"""Hashes of words and of windows of units, and the anchors that windows choose.

Words are hashed eight bytes at a time with a mixing step after each block, and windows of
words by doubling, with a mixing step at each level; so texts of a regular make (such as
Thue-Morse words) don't collide as they do under a polynomial modulo 2**64. Bytes have a
polynomial, which only deals windows to buckets there: bytes themselves decide.

Equal windows choose the same anchor (the k-gram in them with the smallest hash, the
leftmost of equals) at the same offset. A segment is a run of windows of one document that
chose the same anchor; so equal windows lie in segments of one bucket.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SIZE_1, SIZE_2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of spans of a sequence of units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.n = n
        self.inverse = powers(n + 1, INVERSE)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(units * powers(n + 1, BASE)[:n], out=self.prefix[1:])

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[first]) * self.inverse[first]

    def all(self, size: int) -> np.ndarray:
        """Of every span of this size."""
        m = max(0, self.n - size + 1)
        return (self.prefix[size : size + m] - self.prefix[:m]) * self.inverse[:m]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with a line feed between them, and where each text starts (and one more)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


#: Spans over so many bytes are hashed one by one.
LONG_SPAN = 64
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    from xxhash import xxh3_64_intdigest

    left = np.asarray(end - first, np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buf) + 1,), (1,))  # the eight bytes from each place on
    at, h = np.asarray(first, np.int64), left.astype(np.uint64) * SIZE_1 + SIZE_2
    long, view = np.flatnonzero(left > LONG_SPAN), memoryview(buf)
    h = mix(mix(h) ^ (eight[at] & LOW_BYTES[np.clip(left, 0, 8)]))
    live = np.flatnonzero((left > 8) & (left <= LONG_SPAN))
    step = 8
    while len(live):
        h[live] = mix(h[live] ^ (eight[at[live] + step] & LOW_BYTES[np.minimum(left[live] - step, 8)]))
        step += 8
        live = live[left[live] > step]
    if len(long):
        h[long] = np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(at[long].tolist(), (at + left)[long].tolist(), strict=True)], np.uint64)
    return h


BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, text number) of each word, and the bytes."""
    buf, at = joined(texts)
    edge = np.diff(np.concatenate([[0], (~BLANK[buf]).view(np.int8), [0]]).astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(buf, first, end), first, end, np.searchsorted(at, first, "right") - 1, buf


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, in this order."""
    return mix(a * SIZE_1 + b)


class Windows:
    """Hashes of windows of units, each of two windows that overlap or meet and are a power of two long."""

    def __init__(self, units: np.ndarray):
        self.n, self.level = len(units), {1: units}

    def power(self, p: int) -> np.ndarray:
        if p not in self.level:
            half = self.power(p // 2)
            m = max(0, self.n - p + 1)
            self.level[p] = both(half[:m], half[p // 2 : p // 2 + m])
        return self.level[p]

    def all(self, size: int) -> np.ndarray:
        """Of every window of this size."""
        p = 1 << (size.bit_length() - 1)
        a, m = self.power(p), max(0, self.n - size + 1)
        return a[:m] if p == size else both(a[:m], a[size - p : size - p + m])

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of windows of any sizes."""
        out, size = np.zeros(len(first), np.uint64), np.asarray(end - first, np.int64)
        for p in (1 << k for k in range(int(size.max(initial=0)).bit_length())):
            pick = np.flatnonzero((size >= p) & (size < 2 * p))
            if len(pick):
                a = self.power(p)
                out[pick] = mix(both(a[first[pick]], a[end[pick] - p]) + size[pick].astype(np.uint64) * SIZE_2)
        return out


def slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    n, m, size = len(a) - w + 1, a, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


class Segments:
    """first, count: the run of window starts; h: the anchor's hash; pre: units before the anchor; text: the text's number."""

    def __init__(self, grams: np.ndarray, text: np.ndarray, window: int, gram: int):
        """grams: the hash of each window of `gram` units; text: of each unit."""
        self.window, n = window, len(text)
        if n < window:
            self.first = self.count = self.pre = self.text = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        anchor = (slide_min((grams & HIGH) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & LOW).astype(np.int64)
        start = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
        a = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (a[1:] != a[:-1]) | (np.diff(start) != 1)
        at = np.flatnonzero(new)
        self.first = start[at]
        self.count = np.diff(np.append(at, len(start)))
        self.h, self.pre = grams[a[at]], a[at] - self.first
        self.text = text[self.first]

    @property
    def end(self) -> np.ndarray:
        """Where the units of each segment end."""
        return self.first + self.count + self.window - 1

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `which`, window start) of every window of these segments."""
        count = self.count[which]
        at = np.repeat(np.arange(len(which)), count)
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.first[which][at] + within


def digests(buf, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span themselves, never 0."""
    from xxhash import xxh3_64_intdigest

    view = memoryview(buf)
    out = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, len(first))
    return np.maximum(out, np.uint64(1))
