"""Quality rules as a short-circuit cascade.

Base rules decide first: fewer than 50 words, or more than half of the words in repeated 3-word windows. The other
rules form a cascade: on a bounded sample their cost (seconds per document) and selectivity (share rejected) are
measured, and they run in the order of rejection per cost, each only on the documents that all earlier rules passed.
The verdict is a conjunction, so the measured order changes the cost and never the result.

Defined cases: null text counts as empty (zero counts, ``base_failed`` true, ``kept`` false); very long texts are read whole; rules
of equal worth run in the order of their names' declaration; an empty table gives an empty result; repeated rows are judged one by
one; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, failed_rule string"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LINE_END = np.zeros(256, dtype=bool)
_LINE_END[10] = True


@dataclass
class Block:
    """Documents of one chunk with their base statistics; ``rows`` are those a rule still has to judge."""

    buf: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_off: np.ndarray
    stats: dict[str, np.ndarray]

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the given documents, one after another, and their offsets."""
        lengths = self.off[rows + 1] - self.off[rows]
        off = np.concatenate([[0], np.cumsum(lengths)])
        if len(rows) == len(self.off) - 1:
            return self.buf, off
        return self.buf[tx.ranges(self.off[rows], lengths)], off


def _share(table: np.ndarray, b: Block, rows: np.ndarray) -> np.ndarray:
    buf, off = b.pick(rows)
    return tx.per_doc(table[buf].astype(np.int64), off) / np.maximum(off[1:] - off[:-1], 1)


def _symbols(b: Block, rows: np.ndarray) -> np.ndarray:
    return b.stats["n_symbols"][rows] > 0.1 * b.stats["n_words"][rows]


def _word_length(b: Block, rows: np.ndarray) -> np.ndarray:
    mean = b.stats["word_chars"][rows] / np.maximum(b.stats["n_words"][rows], 1)
    return (mean < 2) | (mean > 14)


def _dup_lines(b: Block, rows: np.ndarray) -> np.ndarray:
    return b.stats["n_dup_lines"][rows] > 0.3 * b.stats["n_lines"][rows]


def _capitals(b: Block, rows: np.ndarray) -> np.ndarray:
    return _share(_UPPER, b, rows) > 0.4


def _letters(b: Block, rows: np.ndarray) -> np.ndarray:
    return _share(_LETTER, b, rows) < 0.5


RULES: dict[str, Callable[[Block, np.ndarray], np.ndarray]] = {
    "symbols": _symbols,
    "word_length": _word_length,
    "dup_lines": _dup_lines,
    "capitals": _capitals,
    "letters": _letters,
}


def _lines(buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those of them equal to an earlier one."""
    n_docs = len(off) - 1
    cut = np.flatnonzero(buf == 10)
    begin = np.union1d(off[:-1], cut + 1)
    begin = begin[begin < len(buf)]
    if not len(begin):
        return np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
    end = np.append(begin[1:], len(buf))
    end = end - ((end > begin) & (buf[end - 1] == 10))
    some = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[some], end[some]
    doc = np.searchsorted(off, begin, side="right") - 1
    keys = tx.mix(tx.span_hashes(buf, begin, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    dup = np.ones(len(keys), dtype=np.int64)
    dup[first] = 0
    again = np.flatnonzero(dup)
    twin, size = first[which[again]], end[again] - begin[again]
    odd = (size != end[twin] - begin[twin]) | (doc[again] != doc[twin])
    odd |= ~tx.same_bytes(buf, begin[again], buf, begin[twin], np.minimum(size, end[twin] - begin[twin]))
    for d in np.unique(doc[again[odd]]):  # lines that only share a hash
        seen: set[bytes] = set()
        for i in np.flatnonzero(doc == d):
            line = buf[begin[i] : end[i]].tobytes()
            dup[i] = line in seen
            seen.add(line)
    line_off = np.searchsorted(doc, np.arange(n_docs + 1))
    return np.diff(line_off), tx.per_doc(dup, line_off)


def base_block(buf: np.ndarray, off: np.ndarray) -> Block:
    starts, ends, word_off = tx.word_spans(buf, off)
    solid = np.zeros(len(buf), dtype=np.int64)
    solid[:] = ~tx.SPACE[buf] & ((buf & 0xC0) != 0x80)
    n_lines, dup_lines = _lines(buf, off, starts)
    hashes = tx.span_hashes(buf, starts, ends)
    grams = tx.ngram_hashes(hashes, 3)
    inside = tx.window_mask(word_off, 3, len(hashes))[: len(grams)]
    at = np.flatnonzero(inside)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(word_off))[at]
    twice = tx.repeated(tx.mix(grams[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    covered = np.zeros(len(hashes), dtype=np.int64)
    for k in range(3):
        covered[at[twice] + k] = 1
    stats = {
        "n_words": np.diff(word_off),
        "word_chars": tx.per_doc(solid, off),
        "n_symbols": tx.per_doc(_SYMBOL[buf].astype(np.int64), off),
        "n_dup_lines": dup_lines,
        "n_lines": n_lines,
        "n_repeat_words": tx.per_doc(covered, word_off),
    }
    return Block(buf, off, starts, ends, word_off, stats)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def measure(texts: pa.Array) -> list[str]:
    """Rule names by rejection per second on these texts, best first; without any text, as declared."""
    cost, cut, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
    for _, _, buf, off in tx.text_chunks(texts):
        block = base_block(buf, off)
        rows = np.flatnonzero(~base_failed(block.stats))
        n += len(rows)
        for name, rule in RULES.items():
            began = time.perf_counter()
            cut[name] += int(rule(block, rows).sum())
            cost[name] += time.perf_counter() - began
    return sorted(RULES, key=lambda r: -(cut[r] + 0.5) / (n + 1) / max(cost[r], 1e-9)) if n else list(RULES)


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 256) -> DataFrame:
    """Base counts and the verdict for each document. At most ``sample_rows`` rows fix the order of the rules."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = [r.text for r in base.select("text").limit(sample_rows).collect()]
    order = measure(pa.array(sample, type=pa.string()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                block = base_block(buf, off)
                s = block.stats
                failed = base_failed(s)
                why = np.full(hi - lo, None, dtype=object)
                why[failed] = "base"
                rows = np.flatnonzero(~failed)
                for name in order:
                    if not len(rows):
                        break
                    bad = RULES[name](block, rows)
                    why[rows[bad]] = name
                    rows = rows[~bad]
                kept = np.zeros(hi - lo, dtype=bool)
                kept[rows] = True
                cols = [s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), *map(pa.array, cols), pa.array(failed), pa.array(kept), pa.array(why, type=pa.string())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"],
                )

    return base.mapInArrow(judge, SCHEMA)
