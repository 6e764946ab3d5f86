"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the raw UTF-8 bytes of an Arrow string column with numpy, a bounded chunk of
documents at a time, so that a Python worker never holds Python objects per word.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``. Hashes are 64 bit and not linear in the bytes; they depend on the bytes
only, so they agree on every executor. Where equality is promised, words and lines that share a hash are compared.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 22  # bytes of text handled at a time (one longer document is a chunk of its own)
LONG = 256
_R = 0xD6E8FEB86659FD93 | 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Octets:
    """Up to eight bytes from any place of a buffer as one number, for many places at once."""

    MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)

    def __init__(self, buf: np.ndarray) -> None:
        padded = np.zeros((len(buf) >> 3 << 3) + 16, dtype=np.uint8)
        padded[: len(buf)] = buf
        self.words = padded.view(U64)

    def load(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes from ``at`` on, ``size`` of them but at most eight."""
        word, shift = at >> 3, ((at & 7) << 3).astype(U64)
        got = self.words[word] >> shift
        got |= self.words[word + 1] << U64(1) << (U64(63) - shift)
        return got & self.MASKS[np.minimum(size, 8)]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each ``buf[s:e]``; another salt gives another hash.

    Eight bytes at a time enter two non-linear lanes; spans of up to eight bytes of one length never clash, and those of more than
    ``LONG`` bytes go to blake2b.
    """
    size = ends - starts
    octets = Octets(buf)
    out = (octets.load(starts, size) + size.astype(U64) * U64(0xA0761D6478BD642F)) ^ U64(salt)
    more = np.flatnonzero((size > 8) & (size <= LONG))
    if len(more):
        more = more[np.argsort(-size[more], kind="stable")]
        at, left = starts[more] + 8, size[more] - 8
        one, two = mix(out[more]), out[more] * U64(0xD6E8FEB86659FD93)
        n = len(more)
        while n:
            part = octets.load(at[:n], left[:n])
            one[:n] = mix(one[:n] ^ part)
            lane = (two[:n] + part) * U64(0x9E3779B97F4A7C15)
            two[:n] = lane ^ (lane >> U64(32))
            at[:n] += 8
            left[:n] -= 8
            n = int(np.searchsorted(-left[:n], 0, side="left"))
        out[more] = one + two * U64(0xE7037ED1A0B428DB)
    for i in np.flatnonzero(size > LONG):
        raw = buf[int(starts[i]) : int(ends[i])].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return mix(out)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Is ``a[at:at + size] == b[other:other + size]``, for many places at once?"""
    left, right = Octets(a), Octets(b)
    same = left.load(at, size) == right.load(other, size)
    rows, done = np.flatnonzero(same & (size > 8)), 8
    while len(rows):
        if done == LONG:
            for i in rows:
                same[i] = a[at[i] + done : at[i] + size[i]].tobytes() == b[other[i] + done : other[i] + size[i]].tobytes()
            break
        ok = left.load(at[rows] + done, size[rows] - done) == right.load(other[rows] + done, size[rows] - done)
        same[rows[~ok]] = False
        rows, done = rows[ok], done + 8
        rows = rows[size[rows] > done]
    return same


class Memo:
    """What is known of distinct words, found by hash and then compared byte for byte."""

    def __init__(self, most: int, kinds: tuple[type, ...]) -> None:
        self.most, self.kinds = most, kinds
        self.reset()

    def reset(self) -> None:
        self.known, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = [np.zeros(0, k) for k in self.kinds]
        self.pool, self.used = np.zeros(1 << 16, np.uint8), 0

    def distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, index of the first, which of them every word is, is it the first of its hash?) of the distinct words."""
        uniq, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        twin = first[which]
        odd = np.flatnonzero((size != size[twin]) | ~same_bytes(buf, starts, buf, starts[twin], np.minimum(size, size[twin])))
        if not len(odd):
            return uniq, first, which, np.ones(len(uniq), dtype=bool)
        extra: dict[bytes, int] = {}
        rows, hashes, which = [], [], which.copy()
        for i in odd.tolist():
            word = buf[starts[i] : ends[i]].tobytes()
            if word not in extra:
                extra[word] = len(uniq) + len(rows)
                rows.append(i)
                hashes.append(uniq[which[i]])
            which[i] = extra[word]
        alone = np.concatenate([np.ones(len(uniq), dtype=bool), np.zeros(len(rows), dtype=bool)])
        return np.concatenate([uniq, np.array(hashes, U64)]), np.concatenate([first, rows]), which, alone

    def values_of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, work: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """Values of each word; ``work`` finds those of the words (starts, ends) that are not known yet."""
        if not len(starts):
            return [np.zeros(0, k) for k in self.kinds]
        uniq, first, which, alone = self.distinct(buf, starts, ends)
        if len(self.known) + len(uniq) > self.most:
            self.reset()
        at, size = starts[first], ends[first] - starts[first]
        where = np.searchsorted(self.known, uniq)
        held = where < len(self.known)
        held[held] = self.known[where[held]] == uniq[held]
        hit = held.copy()
        spot = where[held]
        hit[held] = (self.size[spot] == size[held]) & same_bytes(buf, at[held], self.pool, self.at[spot], np.minimum(size[held], self.size[spot]))
        out = [np.zeros(len(uniq), k) for k in self.kinds]
        for o, v in zip(out, self.values):
            o[hit] = v[where[hit]]
        fresh = np.flatnonzero(~hit)
        if len(fresh):
            for o, v in zip(out, work(at[fresh], at[fresh] + size[fresh])):
                o[fresh] = v
            new = fresh[alone[fresh] & ~held[fresh]]
            total = int(size[new].sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * total, np.uint8)])
            self.pool[self.used : self.used + total] = buf[ranges(at[new], size[new])]
            spot = where[new]
            self.known = np.insert(self.known, spot, uniq[new])
            self.at = np.insert(self.at, spot, self.used + np.cumsum(size[new]) - size[new])
            self.size = np.insert(self.size, spot, size[new])
            self.values = [np.insert(v, spot, o[new]) for v, o in zip(self.values, out)]
            self.used += total
        return [o[which] for o in out]


def text_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off_buf, data = texts.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs without a byte of ``gap``, and for each document the index of its first (one more entry at the end)."""
    solid = ~gap[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = off[:-1][off[:-1] < off[1:]]
    first[at] = solid[at]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    at = off[1:][off[:-1] < off[1:]] - 1
    last[at] = solid[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries of h (not finished by mix); shorter than h by n - 1."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    acc, done, block, size = None, 0, h, 1
    while True:  # n as a sum of powers of two, each doubled from the last
        if n & size:
            part = block if acc is None else block[done:] * U64(pow(_R, done, 1 << 64))
            acc = part if acc is None else acc[: len(part)] + part[: len(acc)]
            done += size
        if done == n:
            return acc[: len(h) - n + 1]
        block = block[:-size] + block[size:] * U64(pow(_R, size, 1 << 64))
        size *= 2


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on beside the JVM for stages that need it there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def window_mask(word_off: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each of the ``total`` words: does a window of n words that starts there end in its own document?"""
    end = np.repeat(word_off[1:], np.diff(word_off))
    return end - np.arange(total) >= n


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + l)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over ``off[i]:off[i + 1]``."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each entry that occurs at least twice in keys."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out
