"""Toxicity by class-conditional Kneser-Ney models.

One interpolated bigram model for toxic and one for ordinary text. Both back off to unigrams with absolute discounting and
from there to the same continuation counts, pooled over the classes; expressions of fewer than ``min_count`` contexts have
no entry of their own and are left to that shared part. Every count is of distinct contexts, so neither what one document
repeats nor a group of copies looks typical of its class. A document's features are the difference of its two
log-likelihoods per word, and the largest such difference in any run of ``SPAN`` words; a logistic curve, fitted on
labelled documents that the counts have not seen, turns them into a score.

Counts are learned from all labelled documents of the training folds, and the curve from at most ``max_docs`` others (those
with the smallest hash of the id); every document is scored whole. Labels are broadcast if they are at most ``broadcast_rows``.

Defined cases: null and empty texts get the score of zero evidence; very long texts are read whole; a score of 0.5 counts as toxic; if either class has no training document every
score is 0 (no toxic one) or 1; several labels of one document count as toxic if one is; labels of unknown documents are
ignored; an empty table gives an empty result; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .language_id import held_out
from .scratch import written

GAP = np.ones(256, dtype=bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DISCOUNT = 0.75
MIN_COUNT = 8
SPAN = 8
WORD = np.uint64(24)
_ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, score double, predicted int"


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tx.mix(before * _ODD + word) | np.uint64(1)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of 40 bits, pair hashes (0 at a document's first word) and document offsets."""
    low = LOWER[buf]
    starts, ends, word_off = tx.word_spans(low, off, GAP)
    h = tx.span_hashes(low, starts, ends) >> WORD
    pair = np.zeros(len(h), dtype=np.uint64)
    if len(h) > 1:
        pair[1:] = pair_key(h[:-1], h[1:])
    head = word_off[:-1][word_off[:-1] < len(h)]
    pair[head] = 0
    return h, pair, word_off


def count_expressions(train: DataFrame) -> DataFrame:
    """(before, word, t, o): in how many distinct contexts of one more word the pair occurs in toxic and in ordinary texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                h, pair, word_off = word_hashes(buf, off)
                at = np.flatnonzero(pair != 0)
                if not len(at):
                    continue
                far = np.where(pair[at - 1] == 0, np.uint64(0), h[at - 2])
                mine = toxic[lo:hi][np.searchsorted(word_off, at, side="right") - 1]
                _, first, where = np.unique(tx.mix(pair[at] + far * _ODD), return_index=True, return_inverse=True)
                t = np.bincount(where, weights=mine, minlength=len(first)) > 0
                o = np.bincount(where, weights=~mine, minlength=len(first)) > 0
                rows = at[first]
                before, word = h[rows - 1], h[rows]
                # three words and two marks in two numbers, as these rows are all that is shuffled
                one = before << WORD | word >> np.uint64(16)
                two = (word & np.uint64(0xFFFF)) << np.uint64(48) | far[first] << np.uint64(2) | t.astype(np.uint64) | o.astype(np.uint64) << np.uint64(1)
                yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["one", "two"])

    rows = train.select("text", "toxic").mapInArrow(count, "one long, two long")
    # one exchange serves both counts
    rows = rows.withColumn("tail", F.shiftrightunsigned("two", 48)).repartition("one", "tail")
    rows = rows.groupBy("one", "tail", F.shiftrightunsigned("two", 2).alias("far")).agg(F.bit_or(F.col("two").bitwiseAND(3)).alias("seen"))
    counts = rows.groupBy("one", "tail").agg(F.sum(F.col("seen").bitwiseAND(1)).alias("t"), F.sum(F.shiftright("seen", 1)).alias("o"))
    word = F.shiftleft(F.col("one").bitwiseAND(0xFFFFFF), 16).bitwiseOR(F.col("tail"))
    return counts.select(F.shiftrightunsigned("one", 24).alias("before"), word.alias("word"), "t", "o")


class KneserNey:
    """Tables of log-likelihood differences, from the counts of ``count_expressions``."""

    def __init__(self, counts: DataFrame, min_count: int = MIN_COUNT) -> None:
        contexts = counts.groupBy("word").agg(
            F.sum((F.col("t") > 0).cast("long")).alias("t"), F.sum((F.col("o") > 0).cast("long")).alias("o"), F.count("*").alias("n")
        )
        sums = contexts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ton"], F.count("*").alias("kinds")).first()
        kept = contexts.filter(F.col("t") + F.col("o") >= min_count)
        after = counts.groupBy(F.col("before").alias("word")).agg(F.sum("t").alias("st"), F.sum("o").alias("so"))
        words = kept.join(after, "word", "left").na.fill(0).toPandas()
        pairs = counts.filter(F.col("t") + F.col("o") >= min_count).toPandas()
        key = words["word"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        self.words = key[order]
        col = lambda df, c: df[c].to_numpy(dtype=np.float64)
        uni = np.stack([col(words, "t"), col(words, "o")])[:, order]
        total = np.maximum(np.array([[sums.t], [sums.o]], dtype=np.float64), 1)
        own = np.maximum(uni - DISCOUNT, 0) / total
        rest = 1 - own.sum(axis=1, keepdims=True)
        shared = col(words, "n")[order] / (sums.n + sums.kinds + 1)
        p = own + rest * shared
        self.word_llr = np.log(p[0] / p[1])
        self.none = float(np.log(rest[0, 0] / rest[1, 0]))
        left, right = (pairs[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("before", "word"))
        known = np.isin(left, self.words) & np.isin(right, self.words)
        left, right, bi = left[known], right[known], np.stack([col(pairs, "t"), col(pairs, "o")])[:, known]
        b, w = np.searchsorted(self.words, left), np.searchsorted(self.words, right)
        seen = np.stack([col(words, "st"), col(words, "so")])[:, order]
        own_bi = np.maximum(bi - DISCOUNT, 0) / np.maximum(seen[:, b], 1)
        back = np.clip(1 - np.stack([np.bincount(b, weights=x, minlength=len(self.words)) for x in own_bi]), 1e-6, 1)
        self.back_llr = np.log(back[0] / back[1])
        full = own_bi + back[:, b] * p[:, w]
        keys = pair_key(left, right)
        order = np.argsort(keys)
        self.pairs, self.pair_llr = keys[order], np.log(full[0] / full[1])[order]

    def features(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(mean difference, largest difference in a run) of each document."""
        h, pair, word_off = word_hashes(buf, off)
        n = np.diff(word_off)
        uni, back = np.full(len(h), self.none), np.zeros(len(h))
        if len(self.words) and len(h):
            uniq, where = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(self.words, uniq), len(self.words) - 1)
            hit = self.words[at] == uniq
            uni = np.where(hit, self.word_llr[at], self.none)[where]
            back[1:] = np.where(hit, self.back_llr[at], 0)[where][:-1]
        llr = uni + np.where(pair == 0, 0, back)
        if len(self.pairs) and len(h):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[at] == pair
            llr[hit] = self.pair_llr[at[hit]]
        sums = np.concatenate([[0], np.cumsum(llr)])
        mean = (sums[word_off[1:]] - sums[word_off[:-1]]) / np.maximum(n, 1)
        end = np.minimum(np.arange(len(h)) + SPAN, np.repeat(word_off[1:], n))
        run = (sums[end] - sums[:-1]) / SPAN
        most = np.zeros(len(n))
        some = np.flatnonzero(n > 0)
        if len(some):
            most[some] = np.maximum.reduceat(run, word_off[:-1][some])
        return np.stack([mean, most], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) / 100, x.T @ (y - p) - ridge * len(x) * w / 100)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_filter: object,
    fit_filter: object,
    max_docs: int = 6000,
    min_count: int = MIN_COUNT,
    broadcast_rows: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Scores of all documents. Labelled rows with ``train_filter`` may be learned from; those of them with ``fit_filter`` only fit the curve."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train_filter).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fitting = named.filter(fit_filter).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id", "toxic")
    learned = named.filter(~fit_filter).select("doc_id", "toxic", F.lit(False).alias("fit"))
    sample = written(learned.unionAll(fitting.withColumn("fit", F.lit(True))))
    if sample.limit(broadcast_rows + 1).count() <= broadcast_rows:  # the documents need no shuffle
        sample = F.broadcast(sample)
    train = base.filter(train_filter).join(sample, "doc_id")
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        only = float(1 in sizes)
        return base.select("doc_id", F.lit(only).alias("score"), F.lit(int(only)).alias("predicted"))
    model = KneserNey(written(count_expressions(train.filter(~F.col("fit")))), min_count)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                f = shared.value.features(buf, off)
                yield pa.record_batch([batch.column("toxic").slice(lo, hi - lo), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["toxic", "mean", "most"])

    seen = train.filter("fit").select("text", "toxic").mapInArrow(features, "toxic int, mean double, most double").toPandas()
    if seen["toxic"].nunique() == 2:
        weights = logistic(seen[["mean", "most"]].to_numpy(), seen["toxic"].to_numpy(dtype=np.float64))
    else:
        weights = np.array([0.0, 8.0, -4.0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                z = shared.value.features(buf, off) @ weights[:2] + weights[2]
                p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return base.mapInArrow(score, SCHEMA)


def toxicity_held_out(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """Scores with the fold of each document; labels of the held-out fold are never read."""
    out = toxicity(docs, labels, ~held_out("doc_id", 5, 0), held_out("doc_id", 5, 4), **options)
    return out.select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", "predicted")
