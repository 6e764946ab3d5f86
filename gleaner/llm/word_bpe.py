"""Exact ids of a word-level BPE tokenizer file, computed for many distinct words at once.

White space separates words and no merge crosses it, so the ids of a text are those of its words in a row. Each
distinct word is encoded once and remembered. Plain words (printable ASCII and Latin-1 letters) are encoded with numpy,
merging the best pair of all words of one length at a time; every other word goes to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json

import numpy as np

from . import textops as tx

_NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class PairTable:
    """(left id, right id) to merge rank, as a two-table cuckoo hash."""

    BITS = 18
    MULT = (np.uint64(0x9E3779B1), np.uint64(0x85EBCA77))

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.full((2, 1 << self.BITS), 2**64 - 1, dtype=np.uint64)
        self.rank = np.full((2, 1 << self.BITS), _NONE, dtype=np.int32)
        spots = np.stack([self._spot(keys, t) for t in (0, 1)])
        owner = [{}, {}]
        for rank in range(len(keys)):
            item, side = rank, 0
            for _ in range(500):
                spot = int(spots[side, item])
                item, owner[side][spot] = owner[side].get(spot), item
                if item is None:
                    break
                side ^= 1
            else:
                raise ValueError("merge table is too full")
        for side in (0, 1):
            where = np.fromiter(owner[side].keys(), dtype=np.int64)
            which = np.fromiter(owner[side].values(), dtype=np.int64)
            self.keys[side, where] = keys[which]
            self.rank[side, where] = which

    def _spot(self, keys: np.ndarray, side: int) -> np.ndarray:
        return ((keys * self.MULT[side] & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        a, b = self._spot(keys, 0), self._spot(keys, 1)
        return np.where(self.keys[0][a] == keys, self.rank[0][a], np.where(self.keys[1][b] == keys, self.rank[1][b], _NONE))


class WordBpe:
    """Ids of words; ``path`` names a tokenizer file whose pre-tokenizer drops white space and whose model marks word ends."""

    LONGEST = 40  # bytes of a pre-token that numpy handles
    MOST = 3_000_000  # words remembered at a time

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.pairs = PairTable(keys)
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        kind = np.full(256, 2, dtype=np.uint8)
        kind[48:58] = 1
        kind[65:91] = kind[97:123] = kind[128:] = 0
        self.kind = kind
        odd = np.zeros(256, dtype=bool)
        odd[:33] = odd[127] = odd[39] = True
        odd[0xC0:] = True
        odd[0xC3] = False
        self.odd = odd
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self._reset()

    def _reset(self) -> None:
        self.memo = tx.Memo(self.MOST, (np.int64, np.int64))
        self.pool = np.zeros(1 << 16, dtype=np.uint16)
        self.used = 0

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""

        def encode(starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
            ids, counts = self._encode(buf, starts, ends)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.uint16)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            return [self.used - len(ids) + np.cumsum(counts) - counts, counts]

        if self.used > 8 * self.MOST:
            self._reset()
        at, counts = self.memo.values_of(buf, starts, ends, encode)
        return self.pool[tx.ranges(at, counts)], counts

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, in their order."""
        length = ends - starts
        text = buf[tx.ranges(starts, length)]
        off = np.concatenate([[0], np.cumsum(length)])
        bad = self.odd[text]
        follow = np.zeros(len(text), dtype=np.uint8)
        follow[1:] = text[:-1]
        bad |= (follow == 0xC3) & ((text == 0x97) | (text == 0xB7))
        bad |= (follow == ord("<")) & (text == ord("|"))
        slow = tx.per_doc(bad.astype(np.int64), off) > 0
        low = self.lower[text]
        up = (follow == 0xC3) & (text >= 0x80) & (text <= 0x9E)
        low[up] += 0x20
        kind = self.kind[text]
        cut = np.ones(len(text) + 1, dtype=bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cut[off] = True
        begin = np.flatnonzero(cut)
        size = np.diff(begin)
        begin = begin[:-1]
        owner = np.searchsorted(off, begin, side="right") - 1
        slow[owner[size > self.LONGEST]] = True
        fine = ~slow[owner]
        begin, size, owner = begin[fine], size[fine], owner[fine]
        out, counts = self._merge(low, begin, size)
        per_word = np.bincount(owner, weights=counts, minlength=len(starts)).astype(np.int64)
        if not slow.any():
            return out, per_word
        at = np.cumsum(per_word) - per_word
        rows = np.flatnonzero(slow)
        words = [text[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in rows]
        extra = [np.array(e.ids, dtype=np.uint16) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        per_word[rows] = [len(e) for e in extra]
        base = len(out)
        lens = np.array([len(e) for e in extra], dtype=np.int64)
        at[rows] = base + np.cumsum(lens) - lens
        return np.concatenate([out, *extra])[tx.ranges(at, per_word)], per_word

    def _merge(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of pre-tokens, in their order."""
        counts = np.zeros(len(begin), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            raw = text[begin[rows][:, None] + np.arange(length)]
            ids = self.inner[raw]
            ids[:, -1] = self.final[raw[:, -1]]
            ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:]) if length > 1 else None
            while ids.shape[1] > 1:
                best = ranks.argmin(axis=1)
                every = np.arange(len(rows))
                value = ranks[every, best]
                done = value == _NONE
                if done.any():
                    found.append((rows[done], ids[done]))
                    go = ~done
                    rows, ids, ranks, best, value = rows[go], ids[go], ranks[go], best[go], value[go]
                    every = np.arange(len(rows))
                if not len(rows):
                    break
                width = ids.shape[1] - 1
                ids[every, best] = self.merged[value]
                keep = np.ones(ids.shape, dtype=bool)
                keep[every, best + 1] = False
                ids = ids[keep].reshape(len(rows), width)
                keep = np.ones(ranks.shape, dtype=bool)
                keep[every, best] = False
                ranks = ranks[keep].reshape(len(rows), width - 1)
                left = np.flatnonzero(best > 0)
                b = best[left]
                ranks[left, b - 1] = self.pairs.ranks(ids[left, b - 1], ids[left, b])
                right = np.flatnonzero(best < width - 1)
                b = best[right]
                ranks[right, b] = self.pairs.ranks(ids[right, b], ids[right, b + 1])
            if len(rows):
                found.append((rows, ids))
        for rows, ids in found:
            counts[rows] = ids.shape[1]
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.uint16)
        for rows, ids in found:
            out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One instance for each file and process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
