"""Near duplicates by a containment ensemble of MinHash bands.

1. Equal texts count as one from here on; each text has its set of word shingles and a MinHash signature.
2. Texts are partitioned by set size (half octaves). For texts d partitions apart, containment t of the smaller in the
   larger means a Jaccard similarity of at least t / (ratio + 1 - t), and the banding (rows and bands) for that distance
   is tuned for this threshold on its own, up to ``NEAR`` partitions apart.
3. Band keys go to shards as packed arrays. The texts of a key are compared by sizes and a short sketch: all pairs of at most
   ``few`` texts; of more, each with all texts that nothing joins it to yet, which finds the same families with fewer rows.
   Keys with very many texts are compared in blocks, and pairs of whole blocks are tasks of their own. Candidates are texts whose
   sketches agree in ``ALIKE`` bytes, so that texts which share a little, as a licence, are not all one family.
4. All near pairs of a family of connected candidates are counted exactly on their full shingle sets; large families are split into
   pairs of blocks. A task gives numbers of links, a forest of the symmetric ones and each text's largest container, not pairs.
   ``far_links`` finds all other links exactly, so families decide what a link costs, not whether it is found.
5. Links whose intersection is most of either set join classes; a text without such a link that is nearly all contained in larger
   ones joins the class of the largest of them. So texts that merely share a small text do not fall into one class.

Defined cases: texts without a word (null, empty) are classes of their own without links; texts shorter than a shingle have one
shingle of all their words; very long texts are read whole; equal texts are copies, and of rows that repeat both id and text one is
kept; ids that name several texts give each row the class of its own text; a null id is larger than all others, and a class
without any id has a null class_id (ids are taken to be below ``2 ** 62``); ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .components import components
from .far_links import far_links
from .scratch import written

SHINGLE = 5
HASHES = 96
SKETCH = 40
NEAR = 1  # partitions apart that bands serve
ALIKE = 12  # bytes of two sketches that agree if a family may hold both texts
NO_ID = 1 << 62  # from here on ids stand for texts without one
_A = (np.random.default_rng(20).integers(1, 2**62, HASHES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.default_rng(21).integers(1, 2**62, HASHES).astype(np.uint64)


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the document of each."""
    starts, ends, word_off = tx.word_spans(buf, off)
    h = tx.span_hashes(buf, starts, ends)
    n = np.diff(word_off)
    grams = tx.ngram_hashes(h, SHINGLE)
    at = np.flatnonzero(tx.window_mask(word_off, SHINGLE, len(h))[: len(grams)])
    doc = np.repeat(np.arange(len(n)), n)[at]
    keys = tx.mix(grams[at])
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        whole = [tx.ngram_hashes(h[word_off[i] : word_off[i + 1]], int(n[i]))[0] for i in few]
        doc, keys = np.concatenate([doc, few]), np.concatenate([keys, tx.mix(np.array(whole, dtype=np.uint64))])
    return keys, doc


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all documents in a row, and the first of each."""
    keys, doc = shingles(buf, off)
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    keep = np.ones(len(keys), dtype=bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[keep], np.searchsorted(doc[keep], np.arange(len(off)))


def signatures(keys: np.ndarray, cut: np.ndarray) -> np.ndarray:
    out = np.full((len(cut) - 1, HASHES), 2**32 - 1, dtype=np.uint32)
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        for j in range(HASHES):
            out[some, j] = np.minimum.reduceat(((keys * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), cut[:-1][some])
    return out


def tune(t: float, apart: int, recall: float = 0.95, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands) for texts so many half octaves apart: the most rows whose bands reach the recall at the threshold."""
    j = t / (2 ** ((apart + 1) / 2) + 1 - t)
    for rows in (4, 3, 2, 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - j**rows))
        if rows * bands <= hashes or rows == 1:
            return rows, min(bands, hashes // rows)
    raise AssertionError


def partition_of(n: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.uint8)


class Keys:
    """Band keys of some texts, ordered by key."""

    FIELDS = (("key", np.uint64), ("id", np.int64), ("n", np.uint32), ("band", np.uint8), ("rows", np.uint8))

    def __init__(self, cols: dict[str, np.ndarray], sketch: np.ndarray) -> None:
        self.cols, self.sketch = cols, sketch

    def take(self, at: np.ndarray | slice) -> Keys:
        return Keys({k: v[at] for k, v in self.cols.items()}, self.sketch[at])

    def pack(self) -> bytes:
        """Field after field, so that what repeats compresses."""
        return b"".join([*(self.cols[k].astype(d).tobytes() for k, d in self.FIELDS), np.ascontiguousarray(self.sketch.T).tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Keys:
        size = sum(np.dtype(d).itemsize for _, d in cls.FIELDS) + SKETCH
        n, at, cols = len(data) // size, 0, {}
        for k, d in cls.FIELDS:
            cols[k] = np.frombuffer(data, dtype=d, count=n, offset=at)
            at += n * np.dtype(d).itemsize
        return cls(cols, np.frombuffer(data, dtype=np.uint8, offset=at).reshape(SKETCH, n).T)

    @classmethod
    def join(cls, parts: list[Keys]) -> Keys:
        return cls({k: np.concatenate([p.cols[k] for p in parts]) for k, _ in cls.FIELDS}, np.concatenate([p.sketch for p in parts]))


def compare(k: Keys, i: np.ndarray, j: np.ndarray, plans: list[tuple[int, int]], t: float) -> np.ndarray:
    """Which of the pairs of entries may be links found by this banding.

    The sketch must agree about as often as the pair's own Jaccard threshold says, less 1.6 standard deviations.
    """
    c = k.cols
    ni, nj = c["n"][i].astype(np.float64), c["n"][j].astype(np.float64)
    apart = np.abs(partition_of(ni).astype(np.int16) - partition_of(nj))
    rows, bands = np.array([p[0] for p in plans]), np.array([p[1] for p in plans])
    inside = np.minimum(apart, NEAR)
    ok = (apart <= NEAR) & (rows[inside] == c["rows"][i]) & (c["band"][i] < bands[inside]) & (c["id"][i] != c["id"][j])
    at = np.flatnonzero(ok)
    i, j, q, x = i[at], j[at], np.minimum(ni[at], nj[at]), np.maximum(ni[at], nj[at])
    jac = t * q / (q + x - t * q)
    p = jac + (1 - jac) / 256
    least = SKETCH * p - 1.6 * np.sqrt(SKETCH * p * (1 - p))
    same = np.zeros(len(at), dtype=np.int16)
    for s in range(0, len(at), 1 << 15):
        same[s : s + (1 << 15)] = (k.sketch[i[s : s + (1 << 15)]] == k.sketch[j[s : s + (1 << 15)]]).sum(axis=1)
    may = np.zeros(len(ok), dtype=bool)
    may[at] = same >= np.maximum(np.floor(least), ALIKE)
    return may


def pair_ids(k: Keys, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = k.cols["id"][i], k.cols["id"][j]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def connect(k: Keys, plans: list[tuple[int, int]], t: float) -> list[np.ndarray]:
    """Candidate pairs that join whatever all candidate pairs join: each text meets all that nothing joins to it yet."""
    left, pairs = np.arange(len(k.cols["id"])), [np.zeros((0, 2), np.int64)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            first = np.full(len(left), queue.pop())
            may = compare(k, first, left, plans, t)
            pairs.append(pair_ids(k, first[may], left[may]))
            queue += left[may].tolist()
            left = left[~may]
    return pairs


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of rows, the sizes of the intersections of their sets with those of cols)."""
    sizes = np.array([len(sets[c]) for c in cols])
    keys, where = np.unique(np.concatenate([sets[c] for c in cols]), return_inverse=True)
    df = np.bincount(where, minlength=len(keys))
    posting = np.repeat(np.arange(len(cols), dtype=np.int32), sizes)[np.argsort(where, kind="stable")]
    del where
    first = np.concatenate([[0], np.cumsum(df)])
    many = np.flatnonzero(df >= max(16, len(cols) // 10))  # as a product of dense matrices
    place = np.full(len(keys), -1)
    place[many] = np.arange(len(many))
    width, height = max(1, cells // len(cols)), max(1, cells // len(cols))
    for lo in range(0, len(rows), height):
        part = rows[lo : lo + height]
        mine = np.concatenate([sets[r] for r in part])
        row = np.repeat(np.arange(len(part)), [len(sets[r]) for r in part])
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        hit = keys[at] == mine
        at, row = at[hit], row[hit]
        out = np.zeros(len(part) * len(cols), dtype=np.int64)
        thin = place[at] < 0
        a, r = at[thin], row[thin]
        ends = np.cumsum(df[a])
        s = 0
        while s < len(a):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + cells, side="right")))
            cell = np.repeat(r[s:e], df[a[s:e]]) * len(cols) + posting[tx.ranges(first[a[s:e]], df[a[s:e]])]
            hits, n = np.unique(cell, return_counts=True) if len(cell) * 8 < len(out) else (slice(None), np.bincount(cell, minlength=len(out)))
            out[hits] += n
            s = e
        out = out.reshape(len(part), len(cols))
        for c in range(0, len(many), width):
            w = min(width, len(many) - c)
            left, right = np.zeros((len(part), w), np.float32), np.zeros((len(cols), w), np.float32)
            p = place[at] - c
            inside = (p >= 0) & (p < w)
            left[row[inside], p[inside]] = 1
            for j in range(w):
                q = many[c + j]
                right[posting[first[q] : first[q + 1]], j] = 1
            out += (left @ right.T).astype(np.int64)
        yield part, out


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.6,
    same: float = 0.45,
    absorb: float = 0.85,
    few: int = 32,
    hot: int = 2000,
    block_shingles: int = 2_000_000,
    broadcast_rows: int = 500_000,
    far: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: its class (the id of the class's largest text), its text's links to other texts, its copies.

    A link is a containment of at least ``threshold`` of the smaller shingle set; it is symmetric if at least ``same`` of the
    larger set is shared too. ``n_links`` counts them, ``n_copies`` the other rows with the same text. ``kept`` marks exactly one row of
    each class. ``text_key`` is the hash of the text that tells rows with one id apart.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("tid", F.xxhash64("text"))
    plans = [tune(threshold, d) for d in range(NEAR + 1)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                keys, cut = shingle_sets(buf, off)
                sig = signatures(keys, cut)
                n = np.diff(cut)
                raw = buf.tobytes()
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() if m else None for a, b, m in zip(off[:-1], off[1:], n)]
                cells = [s.tobytes() for s in sig]
                same = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tid", "row")]
                yield pa.record_batch([*same, pa.array(digest, pa.binary()), pa.array(n), pa.array(cells, pa.binary())], names=["doc_id", "tid", "row", "digest", "n", "sig"])
        tx.give_back()

    # row numbers are written with the rest, so a task that is run again cannot change them afterwards
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    signed = written(numbered.mapInArrow(sign, "doc_id long, tid long, row long, digest binary, n long, sig binary"))
    texts = signed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row")).alias("head"),
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("tid").alias("tid"),
    )
    text_id = F.when(F.col("head.id") < NO_ID, F.col("head.id")).otherwise(F.lit(NO_ID) + F.col("head.row"))
    texts = written(texts.select("digest", text_id.alias("id"), F.col("head.row").alias("row"), "copies", "n", "sig", "tid"))
    sums = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_texts = sums.texts
    n_shards = max(1, n_texts // 4000)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {r: max(b for q, b in plans if q == r) for r in {r for r, _ in plans}}
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column("sig")), dtype=np.uint32).reshape(-1, HASHES)
            ids = batch.column("id").to_numpy()
            n = batch.column("n").to_numpy()
            sketch = np.ascontiguousarray((sig[:, HASHES - SKETCH :] & 0xFF).astype(np.uint8))
            parts = []
            for rows, bands in most.items():
                for j in range(bands):
                    key = np.full(len(ids), (rows << 16) + j, dtype=np.uint64)
                    for q in range(rows):
                        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j * rows + q])
                    cols = {"key": key, "id": ids, "n": n, "band": np.full(len(ids), j, np.uint8), "rows": np.full(len(ids), rows, np.uint8)}
                    parts.append(Keys(cols, sketch))
            whole = Keys.join(parts)
            shard = (whole.cols["key"] % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
            some = [s for s in range(n_shards) if cut[s + 1] > cut[s]]
            for s in range(0, len(some), 64):
                packed = [whole.take(order[cut[x] : cut[x + 1]]).pack() for x in some[s : s + 64]]
                yield pa.record_batch([pa.array(some[s : s + 64], pa.int64()), pa.array(packed, pa.binary())], names=["shard", "keys"])

    found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("no", pa.int64()), ("block", pa.binary())])

    def as_rows(pairs: list[np.ndarray], blocks: list[tuple[int, int, bytes]]) -> pa.Table:
        p = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
        keys, nos, packed = zip(*blocks) if blocks else ((), (), ())
        none = lambda k, t: pa.nulls(k, t)
        first = [pa.array(p[:, 0]), pa.array(p[:, 1]), none(len(p), pa.int64()), none(len(p), pa.int64()), none(len(p), pa.binary())]
        last = [none(len(keys), pa.int64()), none(len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(nos, pa.int64()), pa.array(packed, pa.binary())]
        return pa.table([pa.concat_arrays([x, y]) for x, y in zip(first, last)], schema=found)

    def meet(table: pa.Table) -> pa.Table:
        k = Keys.join([Keys.unpack(x.as_py()) for x in table.column("keys")])
        k = k.take(np.lexsort((k.cols["id"], k.cols["key"])))
        key = k.cols["key"]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        work, pairs = [], []
        for r in np.flatnonzero(size > few):
            blocks = []
            for lo in range(cut[r], cut[r + 1], hot):
                block = k.take(slice(lo, min(lo + hot, cut[r + 1])))
                pairs += connect(block, plans, threshold)
                blocks.append(block)
            if len(blocks) > 1:
                work += [(int(key[cut[r]].view(np.int64)), i, b.pack()) for i, b in enumerate(blocks)]
        end = np.repeat(cut[1:], size)
        end[np.repeat(size > few, size)] = 0
        at, step = np.arange(len(key)), 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                return as_rows(pairs, work)
            may = compare(k, at, at + step, plans, threshold)
            pairs.append(pair_ids(k, at[may], at[may] + step))
            step += 1

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                pairs = connect(Keys.join([Keys.unpack(left.as_py()), Keys.unpack(right.as_py())]), plans, threshold)
                p = np.unique(np.concatenate(pairs), axis=0)
                yield pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    met = written(texts.select("id", "n", "sig").mapInArrow(band, "shard long, keys binary").groupBy("shard").applyInArrow(meet, "a long, b long, key long, no long, block binary"))
    blocks = met.filter("block IS NOT NULL").select("key", "no", "block")
    pairs = met.filter("block IS NULL").select("a", "b")
    if not blocks.isEmpty():
        # each block is written once; pairs of blocks exist only on their way from the join to the comparison
        left, right = blocks.select("key", F.col("no").alias("i"), F.col("block").alias("left")), blocks.select("key", F.col("no").alias("j"), F.col("block").alias("right"))
        pairs = pairs.unionAll(left.join(right, "key").filter("i < j").select("left", "right").mapInArrow(meet_blocks, "a long, b long"))
    pairs = written(pairs.distinct())

    # families of candidates, each with as many blocks as its shingles need
    family = components(pairs)
    members = family.join(texts.select("id", "n", "tid"), "id")
    blocks = members.groupBy("comp").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    members = written(members.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    known = members.select("id", F.col("tid").alias("text_tid"), "comp", "block", "blocks")
    if members.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = F.broadcast(known)
    spread = (
        base.join(known, (F.col("tid") == F.col("text_tid")) & ((F.col("doc_id") == F.col("id")) | (F.col("id") >= NO_ID)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "text")
    )
    links_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("tie", pa.bool_()), ("links", pa.int64())])

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        ids, sets, block = table.column("id").to_numpy(), [], table.column("block").to_numpy()
        for _, _, buf, off in tx.text_chunks(table.column("text")):
            keys, cut = shingle_sets(buf, off)
            sets += [keys[a:b] for a, b in zip(cut[:-1], cut[1:])]
        _, only = np.unique(ids, return_index=True)
        n = np.array([len(s) for s in sets])
        only = only[n[only] > 0]
        x, y = key[1].as_py(), key[2].as_py()
        rows, cols = only[block[only] == x], only[block[only] == y]
        # the larger text comes later; of equal ones that with the smaller id
        rank = np.empty(len(ids), dtype=np.int64)
        order = np.lexsort((-ids, n))
        rank[order] = np.arange(len(ids))
        part = partition_of(n).astype(np.int16)
        degree, into = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1)
        parent, ties = np.arange(len(ids)), []
        for some, shared in shared_counts(sets, rows, cols) if len(rows) and len(cols) else ():
            low, high = np.minimum(n[some][:, None], n[cols]), np.maximum(n[some][:, None], n[cols])
            ok = (shared >= threshold * low) & (some[:, None] != cols) & (np.abs(part[some][:, None] - part[cols]) <= NEAR)
            degree[some] += ok.sum(axis=1)
            inside = ok & (shared >= absorb * low)
            larger = rank[cols] > rank[some][:, None]
            into[some] = np.maximum(into[some], np.where(inside & larger, rank[cols], -1).max(axis=1))
            if x != y:
                degree[cols] += ok.sum(axis=0)
                into[cols] = np.maximum(into[cols], np.where(inside & ~larger, rank[some][:, None], -1).max(axis=0))
            both = ok & (shared >= same * high)
            for i in np.flatnonzero(both.any(axis=1)):
                ends = np.append(cols[both[i]], some[i])
                root = parent[ends]
                while (parent[root] != root).any():
                    root = parent[root]
                parent[ends] = root
                roots, at = np.unique(root, return_index=True)
                ties += [(ids[some[i]], ids[e]) for r, e in zip(roots, ends[at]) if r != root[-1]]
                parent[roots] = roots[0]
        del sets
        tx.give_back()
        linked, inner = np.flatnonzero(degree), np.flatnonzero(into >= 0)
        outer = order[into[inner]]
        tie = np.array(ties, dtype=np.int64).reshape(-1, 2)
        none = lambda k, t: pa.nulls(k, t)
        parts = [
            [pa.array(ids[linked]), none(len(linked), pa.int64()), none(len(linked), pa.int64()), none(len(linked), pa.bool_()), pa.array(degree[linked])],
            [pa.array(tie[:, 0]), pa.array(tie[:, 1]), none(len(tie), pa.int64()), pa.array(np.ones(len(tie), bool)), none(len(tie), pa.int64())],
            [pa.array(ids[inner]), pa.array(ids[outer]), pa.array(n[outer]), pa.array(np.zeros(len(inner), bool)), none(len(inner), pa.int64())],
        ]
        return pa.table([pa.concat_arrays([p[c] for p in parts]) for c in range(5)], schema=links_schema)

    links = written(spread.groupBy("comp", "x", "y").applyInArrow(verify, "a long, b long, n long, tie boolean, links long"))
    distinct_texts = texts.select("tid", "id", "n", "copies")
    copied = texts.filter("copies > 1").join(members, "id", "left_anti").select("tid", F.col("id").alias("comp"))
    families = members.select("tid", "comp").unionAll(copied)
    links = links.unionAll(written(far_links(base, distinct_texts, families, shingles, partition_of, NEAR, threshold, same, absorb, sums.n, **(far or {}))))

    both = links.filter("tie").select("a", "b")
    tied = both.select(F.col("a").alias("id")).unionAll(both.select(F.col("b").alias("id"))).distinct()
    into = links.filter("NOT tie").select(F.col("a").alias("id"), F.col("b").alias("into"), "n").join(tied, "id", "left_anti")
    into = into.groupBy("id").agg(F.max(F.struct(F.col("n"), (-F.col("into")).alias("neg"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.neg")).alias("b"))
    joined = components(both.unionAll(into))
    degree = links.filter("links IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    named = texts.join(joined, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    head = named.groupBy("comp").agg(F.max(F.struct(F.col("n"), (-F.col("id")).alias("neg"))).alias("m")).select("comp", (-F.col("m.neg")).alias("class_id"))
    classes = named.join(head, "comp").join(degree, "id", "left").select(
        "digest", F.when(F.col("class_id") < NO_ID, F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("copies") - 1).alias("n_copies"), F.when(F.col("class_id") == F.col("id"), F.col("row")).alias("head_row"),
    )
    rest = signed.filter("digest IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"), F.lit(True).alias("kept"), F.col("tid").alias("text_key")
    )
    out = signed.filter("digest IS NOT NULL").select("doc_id", "digest", "row", "tid").join(classes, "digest")
    kept = F.coalesce(F.col("row") == F.col("head_row"), F.lit(False)).alias("kept")
    return out.select("doc_id", "class_id", "n_links", "n_copies", kept, F.col("tid").alias("text_key")).unionAll(rest)
