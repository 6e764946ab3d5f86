"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. The distinct vote patterns of all documents
(at most ``3 ** len(LABELLERS)``) are counted; expectation-maximisation over these counts estimates each labeller's
accuracy and the share of good documents, starting from majorities. The posteriors of at most ``fit_docs`` documents (the
smallest by a hash of the id) train a logistic scorer on hashed words and word shapes, which judges every document.

Defined cases: null and empty texts have score 0 and are not kept; very long texts are read whole, and their score is a mean that
no length dominates; documents without any vote count by the share of good ones; a score equal to ``cut`` is kept; an empty
table gives an empty result; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .quality_rules import Block, base_block

WORD_BITS = 16
SHAPES = 256
SCHEMA = "doc_id long, votes long, posterior double, score double, kept boolean"
_UPPER, _DIGIT, _STOP, _SYMBOL, _LETTER = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[list(b".,;:!?")] = True
_SYMBOL[list(b"#*$%&|<>{}\\~^@=_")] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_TAIL = _SYMBOL.copy()
_TAIL[list(b"!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _vote(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """0 for nothing, 1 for bad, 2 for good."""
    return np.where(bad, 1, np.where(good, 2, 0)) + 0 * value.astype(np.int64)


def _share(b: Block, table: np.ndarray) -> np.ndarray:
    return tx.per_doc(table[b.buf].astype(np.int64), b.off) / np.maximum(np.diff(b.off), 1)


def _symbols(b: Block) -> np.ndarray:
    x = b.stats["n_symbols"] / np.maximum(b.stats["n_words"], 1)
    return _vote(x, x > 0.15, x < 0.02)


def _capitals(b: Block) -> np.ndarray:
    x = _share(b, _UPPER)
    return _vote(x, x > 0.3, x < 0.1)


def _repeats(b: Block) -> np.ndarray:
    x = b.stats["n_repeat_words"] / np.maximum(b.stats["n_words"], 1)
    return _vote(x, x > 0.4, x < 0.15)


def _word_length(b: Block) -> np.ndarray:
    x = b.stats["word_chars"] / np.maximum(b.stats["n_words"], 1)
    return _vote(x, (x < 2.5) | (x > 11), (x > 3) & (x < 9))


def _sentences(b: Block) -> np.ndarray:
    end = np.isin(b.buf[b.ends - 1], np.frombuffer(b".!?", dtype=np.uint8)) if len(b.ends) else np.zeros(0, bool)
    x = tx.per_doc(end.astype(np.int64), b.word_off) / np.maximum(b.stats["n_words"], 1)
    return _vote(x, (x < 0.015) | (x > 0.5), (x > 0.03) & (x < 0.3))


def _lines(b: Block) -> np.ndarray:
    x = b.stats["n_dup_lines"] / np.maximum(b.stats["n_lines"], 1)
    return _vote(x, x > 0.3, (x == 0) & (b.stats["n_lines"] > 1))


def _letters(b: Block) -> np.ndarray:
    x = _share(b, _LETTER)
    return _vote(x, x < 0.65, x > 0.75)


def _bare_words(b: Block) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_LETTER[b.buf], dtype=np.int64)])
    bare = sums[b.ends] == sums[b.starts]
    x = tx.per_doc(bare.astype(np.int64), b.word_off) / np.maximum(b.stats["n_words"], 1)
    return _vote(x, x > 0.1, x < 0.05)


def _word_tails(b: Block) -> np.ndarray:
    odd = _TAIL[b.buf[b.ends - 1]] if len(b.ends) else np.zeros(0, bool)
    x = tx.per_doc(odd.astype(np.int64), b.word_off) / np.maximum(b.stats["n_words"], 1)
    return _vote(x, x > 0.25, x < 0.08)


def follows_itself(b: Block) -> np.ndarray:
    """For each word: is the word before it in the document the same?"""
    h = tx.span_hashes(b.buf, b.starts, b.ends)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    head = b.word_off[:-1][b.word_off[:-1] < len(h)]
    same[head] = False
    return same


def _runs(b: Block) -> np.ndarray:
    x = tx.per_doc(follows_itself(b).astype(np.int64), b.word_off) / np.maximum(b.stats["n_words"], 1)
    return _vote(x, x > 0.1, x < 0.02)


def _size(b: Block) -> np.ndarray:
    x = b.stats["n_words"]
    return _vote(x, x < 20, x > 60)


LABELLERS: dict[str, Callable[[Block], np.ndarray]] = {
    "symbols": _symbols,
    "capitals": _capitals,
    "repeats": _repeats,
    "word_length": _word_length,
    "sentences": _sentences,
    "lines": _lines,
    "letters": _letters,
    "bare_words": _bare_words,
    "word_tails": _word_tails,
    "runs": _runs,
    "size": _size,
}


def vote_codes(b: Block) -> np.ndarray:
    code = np.zeros(len(b.off) - 1, dtype=np.int64)
    for labeller in LABELLERS.values():
        code = code * 3 + labeller(b)
    return code


def decode(codes: np.ndarray) -> np.ndarray:
    """One row of votes for each code."""
    m = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and P(vote | class) as [labeller, class, vote], by expectation-maximisation."""
    post = np.clip(0.5 + ((votes == 2).sum(axis=1) - (votes == 1).sum(axis=1)) / (2 * votes.shape[1]), 0.05, 0.95)
    prior, table = 0.5, np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        new = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(votes.shape[1]):
            for c in (0, 1):
                got = np.bincount(votes[:, j], weights=weight[c], minlength=3) + 1.0
                table[j, c] = got / got.sum()
        old, post = post, posterior(votes, new, table)
        prior = new
        if len(old) and np.abs(old - post).max() < 1e-7:
            break
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of good."""
    odds = np.full(len(votes), np.log(prior / (1 - prior)))
    for j in range(votes.shape[1]):
        said = votes[:, j] > 0
        odds += np.where(said, np.log(table[j, 1, votes[:, j]] / table[j, 0, votes[:, j]]), 0)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def features(b: Block) -> np.ndarray:
    """(2, words): slots of the word and of its shape."""
    low = _LOWER[b.buf]
    word = (tx.span_hashes(low, b.starts, b.ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    shape = np.searchsorted([3, 6, 10], b.ends - b.starts, side="right")
    for table in (_UPPER, _DIGIT, _STOP, _SYMBOL):
        sums = np.concatenate([[0], np.cumsum(table[b.buf], dtype=np.int32)])
        shape = shape * 2 + (sums[b.ends] > sums[b.starts])
    shape = shape * 2 + follows_itself(b)
    inner = np.concatenate([[0], np.cumsum(_UPPER[b.buf], dtype=np.int32)])
    shape = shape * 2 + (inner[b.ends] > inner[np.minimum(b.starts + 1, b.ends)])
    return np.stack([word, (1 << WORD_BITS) + shape])


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 150, ridge: float = 1e-5) -> np.ndarray:
    """Weights of all slots, the last for the constant, by adaptive gradient steps."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    slots = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    value = 1 / np.sqrt(np.maximum(size, 1))
    w = np.zeros((1 << WORD_BITS) + SHAPES + 1)
    square = np.full(len(w), 1e-6)
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[slots], minlength=len(rows)) * value + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(len(rows), 1)
        grad = np.bincount(slots, weights=(err * value)[owner], minlength=len(w)) + ridge * w
        grad[-1] = err.sum()
        square += grad**2
        w -= 0.5 * grad / np.sqrt(square)
    return w


def weak_label_quality(docs: DataFrame, fit_docs: int = 4000, cut: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Votes, posterior of the votes, score of the trained scorer and verdict of each document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in tx.text_chunks(batch.column("text")):
                codes, n = np.unique(vote_codes(base_block(buf, off)), return_counts=True)
                yield pa.record_batch([pa.array(codes), pa.array(n)], names=["votes", "n"])

    patterns = base.select("text").mapInArrow(vote, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()
    codes, counts = patterns["votes"].to_numpy(dtype=np.int64), patterns["n"].to_numpy(dtype=np.float64)
    prior, table = estimate(decode(codes), counts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in tx.text_chunks(batch.column("text")):
                b = base_block(buf, off)
                slots = features(b)
                rows = [np.sort(slots[:, s:e].ravel()).astype(np.int32).tobytes() for s, e in zip(b.word_off[:-1], b.word_off[1:])]
                yield pa.record_batch([pa.array(vote_codes(b)), pa.array(rows, pa.binary())], names=["votes", "slots"])

    ids = base.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    picked = base.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(sample, "votes long, slots binary").collect()
    target = posterior(decode(np.array([r.votes for r in picked], dtype=np.int64)), prior, table) if picked else np.zeros(0)
    weights = train([np.frombuffer(r.slots, dtype=np.int32).astype(np.int64) for r in picked], target)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                b = base_block(buf, off)
                slots = features(b)
                z = tx.per_doc(w[slots[0]] + w[slots[1]], b.word_off) / np.sqrt(np.maximum(2 * np.diff(b.word_off), 1)) + w[-1]
                p = np.where(np.diff(b.word_off) > 0, np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9), 0.0)
                votes = vote_codes(b)
                cols = [votes, posterior(decode(votes), prior, table), p, p >= cut]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, cols)], names=["doc_id", "votes", "posterior", "score", "kept"])

    return base.mapInArrow(score, SCHEMA)
