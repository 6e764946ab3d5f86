"""Token counts under a unigram vocabulary, without building the tokens.

Spaces become the word mark and start a new word, and a text that starts with no mark gets one. An Aho-Corasick
automaton over the vocabulary's bytes enumerates the pieces ending at each byte, longest first, and dynamic programming
carries only the best score and its number of pieces. Ties: of segmentations with the same score, the one whose last
piece is longer wins. A character that is no piece itself may be covered by the unknown piece, whose score is the
lowest score less 10, and then counts one token for each of its bytes.

The automaton steps through many distinct words at once with numpy; each distinct word is counted once and remembered.

Defined cases: null and empty texts have 0 tokens and score 0; an empty table gives an empty result; repeated rows are
counted alike; words of any length are handled; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

MARK = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long, score double"


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file. Its control pieces and runs of the mark are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or MARK in piece[1:]):
            out.append((piece, model.get_score(i)))
    return out


class UnigramCounter:
    UNK_PENALTY = 10.0
    MOST = 3_000_000
    ROWS = 1 << 15

    def __init__(self, vocab: list[tuple[str, float]]) -> None:
        kids: list[dict[int, int]] = [{}]
        depth, parent, last = [0], [0], [0]
        ends: dict[int, float] = {}
        for piece, score in vocab:
            node = 0
            for b in piece.encode("utf-8"):
                nxt = kids[node].get(b)
                if nxt is None:
                    nxt = len(kids)
                    kids[node][b] = nxt
                    kids.append({})
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    last.append(b)
                node = nxt
            ends[node] = score
        n = len(kids)
        self.depth = np.array(depth, dtype=np.int32)
        parents, bytes_ = np.array(parent), np.array(last)
        self.goto = np.zeros((n, 256), dtype=np.int32)
        fail = np.zeros(n, dtype=np.int32)
        own = np.zeros(n, dtype=bool)
        own[list(ends)] = True
        self.score = np.zeros(n)
        self.score[list(ends)] = list(ends.values())
        self.out = np.zeros(n, dtype=np.int32)
        self.next_out = np.zeros(n, dtype=np.int32)
        top = np.flatnonzero(self.depth == 1)
        self.goto[0, bytes_[top]] = top
        for d in range(1, int(self.depth.max()) + 1):
            here = np.flatnonzero(self.depth == d)
            if d > 1:
                fail[here] = self.goto[fail[parents[here]], bytes_[here]]
            self.goto[here] = self.goto[fail[here]]
            below = np.flatnonzero(self.depth == d + 1)
            self.goto[parents[below], bytes_[below]] = below
            self.next_out[here] = self.out[fail[here]]
            self.out[here] = np.where(own[here], here, self.next_out[here])
        self.unk = min(score for _, score in vocab) - self.UNK_PENALTY
        mark = np.frombuffer(MARK.encode(), dtype=np.uint8)
        self.mark = mark
        self.memo = tx.Memo(self.MOST, (np.float64, np.int64))

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and best score of each word; a word gets the mark in front."""
        best, n = self.memo.values_of(buf, starts, ends, lambda s, e: list(self._viterbi(buf, s, e)))
        return n, best

    def _viterbi(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        best, n = np.zeros(len(size)), np.zeros(len(size), dtype=np.int64)
        lo = 0
        while lo < len(order):
            rows = max(1, min(self.ROWS, (self.ROWS << 5) // (int(size[order[lo]]) + 4)))
            pick = order[lo : lo + rows]
            best[pick], n[pick] = self._block(buf, starts[pick], size[pick])
            lo += rows
        return best, n

    def _block(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by falling size."""
        rows, width = len(size), int(size[0]) + len(self.mark)
        text = np.zeros((rows, width + 1), dtype=np.uint8)
        text[:, : len(self.mark)] = self.mark
        cell = np.repeat(np.arange(rows) * (width + 1) + len(self.mark), size) + tx.ranges(np.zeros(rows, np.int64), size)
        text.ravel()[cell] = buf[tx.ranges(starts, size)]
        text = np.ascontiguousarray(text.T)
        total = size + len(self.mark)
        best = np.full((width + 1, rows), -np.inf)
        best[0] = 0
        count = np.zeros((width + 1, rows), dtype=np.int64)
        state = np.zeros(rows, dtype=np.int32)
        run = np.zeros(rows, dtype=np.int64)
        active = rows
        for e in range(width):
            active = int(np.searchsorted(-total[:active], -e, side="left"))  # those longer than e
            b = text[e, :active]
            run = np.where((b & 0xC0) == 0x80, run[:active] + 1, 1)
            state = self.goto[state[:active], b]
            score, pieces = best[e + 1, :active], count[e + 1, :active]
            single = np.zeros(active, dtype=bool)
            out = self.out[state]
            who = np.flatnonzero(out)
            out = out[who]
            while len(who):
                length = self.depth[out]
                cand = best[e + 1 - length, who] + self.score[out]
                better = cand > score[who]
                w = who[better]
                score[w] = cand[better]
                pieces[w] = count[e + 1 - length[better], w] + 1
                single[who[length == run[who]]] = True
                out = self.next_out[out]
                more = out > 0
                who, out = who[more], out[more]
            lone = np.flatnonzero(~single & ((text[e + 1, :active] & 0xC0) != 0x80))
            if len(lone):
                length = run[lone]
                cand = best[e + 1 - length, lone] + self.unk
                better = cand > score[lone]
                w = lone[better]
                score[w] = cand[better]
                pieces[w] = count[e + 1 - length[better], w] + length[better]
        every = np.arange(rows)
        return best[total, every], count[total, every]


def mark_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words that a mark begins; some are empty."""
    space = np.flatnonzero(buf == 0x20)
    head = off[:-1][off[1:] > off[:-1]]
    rows = np.flatnonzero(off[1:] > off[:-1])
    plain = buf[head] != 0x20
    starts = np.concatenate([space + 1, head[plain]])
    doc = np.concatenate([np.searchsorted(off, space, side="right") - 1, rows[plain]])
    order = np.argsort(starts, kind="stable")
    starts, doc = starts[order], doc[order]
    nxt = np.append(space, len(buf))[np.searchsorted(space, starts)]
    return starts, np.minimum(nxt, off[doc + 1]), doc


_loaded: dict[str, UnigramCounter] = {}


def unigram_counter(path: str) -> UnigramCounter:
    """One instance for each file and process."""
    if path not in _loaded:
        _loaded[path] = UnigramCounter(piece_vocabulary(path))
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, tokens and best score of each document; ``model`` is the place of a SentencePiece file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unigram_counter(model)
        for batch in batches:
            texts = pc.replace_substring(batch.column("text").cast(pa.large_string()), MARK, " ")
            for lo, hi, buf, off in tx.text_chunks(texts):
                starts, ends, doc = mark_spans(buf, off)
                n, best = counter.count(buf, starts, ends)
                word_off = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(word_off)), pa.array(tx.per_doc(n, word_off)), pa.array(np.round(tx.per_doc(best, word_off), 3))],
                    names=["doc_id", "n_words", "n_tokens", "score"],
                )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(count, SCHEMA)
