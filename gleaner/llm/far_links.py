"""Containment links between texts that no family holds together: of sizes so different that no banding of a signature can find
them, or of different families.

For such a pair the Jaccard threshold may be near zero, and a band of one row needs more hashes than any signature has. So each
shingle is its own band:

1. tasks group texts and send their shingles, sorted and delta-coded, to shards of the hash range. A text goes as its place in its
   group, so that an entry takes as many bytes however many shards there are; what the places stand for goes elsewhere once. A shingle
   that more than ``hot_texts`` texts of a group share goes there as one entry (how many texts, of which sizes), its list of texts elsewhere;
2. shards keep the shingles that a text and a larger one outside its family (or a far larger one) share, and tell the smaller text;
3. a linked larger text has at least k = ``ceil(threshold * n)`` of the m shingles told, so nothing is sought if m < k. The other smaller texts,
   which are few, are held with their told shingles by all tasks, in blocks of ``set_bytes``, and each distinct text is held against them once.
   Such a text (a licence, say) may lie in a share of all documents, so pairs are counted where they are found and never listed,
   but for symmetric links and each smaller text's largest containers.

No pair is lost, whatever the families are: nothing is sampled, and no list is cut. Shingles and families are compared by 48 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .scratch import written

_SMALL, _HOT, _HOT_LIST, _NAMES = 0, 1, 2, 3
MET = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("uids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())), ("pack", pa.binary())])
MET_DDL = "kind int, h long, uids array<long>, ns array<int>, pack binary"
_B48 = np.uint64(16)


def planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of unsigned values, plane by plane."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplanes(data: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8, count=n * size).reshape(size, n).T
    return out.view(np.uint64).ravel()


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of one length with the number of bytes that each value needs."""
    return len(columns[0][0]).to_bytes(8, "little") + b"".join(planes(c, size) for c, size in columns)


def unpack(data: bytes, at: int, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], int]:
    n = int.from_bytes(data[at : at + 8], "little")
    at, out, view = at + 8, [], memoryview(data)
    for size in sizes:
        out.append(unplanes(view[at : at + n * size], n, size))
        at += n * size
    return out, at


def deltas(values: np.ndarray) -> np.ndarray:
    out = values.astype(np.uint64)
    out[1:] = out[1:] - out[:-1]
    return out


def heads(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def rows(kind: int, h: np.ndarray, uids: pa.Array | None = None, ns: pa.Array | None = None, packs: list[bytes] | None = None) -> pa.Table:
    n = len(h)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(h.astype(np.int64)), uids, ns, pa.array(packs, pa.binary()) if packs is not None else None]
    return pa.table([pa.nulls(n, f.type) if c is None else c for c, f in zip(cols, MET)], schema=MET)


def small_rows(uid: np.ndarray, n: np.ndarray, h: np.ndarray, shards: int) -> pa.Table:
    """What the smaller texts are told, a row for each shard of groups."""
    shard = (uid >> 16) % shards
    order = np.argsort(shard, kind="stable")
    cut = np.append(heads(shard[order]), len(order))
    parts = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
    data = [pack((uid[p].view(np.uint64), 8), (n[p], 4), (h[p], 6)) for p in parts]
    return rows(_SMALL, shard[order][cut[:-1]] if len(order) else np.zeros(0, np.int64), packs=data)


class Group:
    """Texts of one task that send their shingles together."""

    def __init__(self, gid: int, hot_texts: int) -> None:
        self.gid, self.hot_texts = gid, hot_texts
        self.codes: list[np.ndarray] = []
        self.tids: list[int] = []
        self.fams: list[int] = []
        self.seen: set[int] = set()
        self.size = 0

    def add(self, tids: np.ndarray, fams: np.ndarray, keys: np.ndarray, doc: np.ndarray) -> None:
        place = np.full(len(tids), -1, dtype=np.int64)
        for i in np.unique(doc).tolist():
            t = int(tids[i])
            if t not in self.seen:
                self.seen.add(t)
                place[i] = len(self.tids)
                self.tids.append(t)
                self.fams.append(int(fams[i]))
        at = place[doc]
        new = at >= 0
        self.codes.append((keys[new] >> _B48 << _B48) | at[new].astype(np.uint64))
        self.size += int(new.sum())

    def send(self, n_shards: int) -> Iterator[pa.RecordBatch]:
        code = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint64)
        self.codes.clear()
        code.sort()
        code = code[heads(code)]
        if not len(code):
            return
        h, doc = code >> _B48, (code & np.uint64(0xFFFF)).astype(np.int64)
        tids, fams = np.array(self.tids, dtype=np.int64), np.array(self.fams, dtype=np.int64)
        n = np.bincount(doc, minlength=len(tids))
        cut = heads(h)
        size = np.diff(np.append(cut, len(h)))
        hot = size > self.hot_texts
        shard_of = lambda x: ((x >> _B48) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
        cold = ~np.repeat(hot, size)
        ch, cd = h[cold], doc[cold]
        to = np.searchsorted(shard_of(ch), np.arange(n_shards + 1))
        hh = h[cut[hot]]
        least, most = np.minimum.reduceat(n[doc], cut)[hot], np.maximum.reduceat(n[doc], cut)[hot]
        hot_to = np.searchsorted(shard_of(hh), np.arange(n_shards + 1))
        some = np.flatnonzero((np.diff(to) > 0) | (np.diff(hot_to) > 0))
        gid = self.gid.to_bytes(8, "little")
        for lo in range(0, len(some), 64):
            data = []
            for s in some[lo : lo + 64]:
                a, b, x, y = to[s], to[s + 1], hot_to[s], hot_to[s + 1]
                d = cd[a:b]
                own = fams[d]
                data.append(
                    gid
                    + pack((deltas(ch[a:b]), 6), (d, 2), (n[d], 4))
                    + pack((np.packbits(own != 0), 1))
                    + pack((own[own != 0], 6))
                    + pack((hh[x:y], 6), (least[x:y], 4), (most[x:y], 4), (size[hot][x:y], 4))
                )
            yield pa.record_batch([pa.array(some[lo : lo + 64]), pa.array(np.zeros(len(data), np.int64)), pa.array(data, pa.binary())], names=["shard", "sub", "pack"])
        d = doc[~cold]
        data = gid + pack((tids.view(np.uint64), 8), (n, 4), (fams, 6)) + pack((hh, 6), (size[hot], 4)) + pack((d, 2))
        yield pa.record_batch([pa.array([-1]), pa.array([self.gid]), pa.array([data], pa.binary())], names=["shard", "sub", "pack"])


def far_links(
    base: DataFrame,
    texts: DataFrame,
    families: DataFrame,
    shingles: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    partition_of: Callable[[np.ndarray], np.ndarray],
    near: int,
    threshold: float,
    same: float,
    absorb: float,
    n_shingles: int,
    shard_entries: int = 1_000_000,
    group_entries: int = 1_000_000,
    shard_texts: int = 8_000,
    hot_texts: int = 64,
    known_rows: int = 4_000_000,
    set_bytes: int = 32_000_000,
) -> DataFrame:
    """(a, b, n, tie, links): the links of texts more than ``near`` partitions apart or not of one family, each as a row for either end.

    base has (doc_id, tid, text), texts (tid, id, n, copies) with one row for each distinct text; tid is a hash of the text. families has (tid, comp)
    of texts that are in a family or have copies. ``shingles`` gives the hashes of a block of texts and the text of each. In a row of the
    smaller text b is the larger one if it holds ``absorb`` of it; a row with ``tie`` stands for a pair that shares ``same`` of the larger set.
    Families of at most ``known_rows`` rows are sent to all tasks (16 bytes a row), others are joined.
    """
    n_shards = max(1, n_shingles // shard_entries)
    n_small = max(1, texts.count() // shard_texts)
    # the least size of a text that is far larger than one of each partition
    sizes = np.array([2 ** ((p + near + 1) / 2) for p in range(64)])
    need = np.ceil(sizes - 1e-9).astype(np.int64)
    need += partition_of(need).astype(np.int64) <= np.arange(64) + near
    least_far = lambda n: need[partition_of(n)]

    fam_of = lambda comp: ((tx.mix(comp.view(np.uint64)) >> _B48) | np.uint64(1)).astype(np.int64)
    few = families.limit(known_rows + 1).count() <= known_rows
    if few:
        got = families.toArrow()
        ft, fc = got.column("tid").to_numpy(), got.column("comp").to_numpy()
        order = np.argsort(ft)
        known_fams = base.sparkSession.sparkContext.broadcast((ft[order], fam_of(fc[order])))
        del got, ft, fc, order
        read = base.select("tid", "text", F.lit(0).cast("long").alias("comp"), F.lit(True).alias("no"))
    else:  # in an order that a task which runs again meets too
        read = base.join(families, "tid", "left").select("tid", "text", F.coalesce("comp", F.lit(0)).alias("comp"), F.col("comp").isNull().alias("no"))
        read = read.sortWithinPartitions("tid")

    def families_of(batch: pa.RecordBatch) -> np.ndarray:
        """A number for the family of each row, 0 for none."""
        tids = batch.column("tid").to_numpy()
        if not few:
            return np.where(batch.column("no").to_numpy(zero_copy_only=False), 0, fam_of(batch.column("comp").to_numpy()))
        all_tids, all_fams = known_fams.value
        if not len(all_tids):
            return np.zeros(len(tids), np.int64)
        at = np.minimum(np.searchsorted(all_tids, tids), len(all_tids) - 1)
        return np.where(all_tids[at] == tids, all_fams[at], 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 20
        group = Group(gid, hot_texts)
        for batch in batches:
            tids, fams = batch.column("tid").to_numpy(), families_of(batch)
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                for a in range(lo, hi, 60_000):
                    b = min(a + 60_000, hi)
                    if group.size > group_entries or len(group.tids) + b - a > 65536:
                        yield from group.send(n_shards)
                        gid += 1
                        group = Group(gid, hot_texts)
                    part = off[a - lo : b - lo + 1]
                    group.add(tids[a:b], fams[a:b], *shingles(buf[part[0] : part[-1]], part - part[0]))
        yield from group.send(n_shards)
        tx.give_back()

    def group_rows(table: pa.Table) -> pa.Table:
        """The texts of groups, for those that are told and for names, and the lists of their hot shingles."""
        out = []
        for cell in table.column("pack"):
            data = cell.as_py()
            gid = int.from_bytes(data[:8], "little")
            (tid, n, fam), at = unpack(data, 8, (8, 4, 6))
            (h, size), at = unpack(data, at, (6, 4))
            d = unpack(data, at, (2,))[0][0].astype(np.int64)
            out.append(rows(_NAMES, np.array([gid % n_small]), packs=[gid.to_bytes(8, "little") + pack((tid, 8), (n, 4), (fam, 6))]))
            off = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
            out.append(rows(_HOT_LIST, h, lists(gid << 16 | d, off, pa.int64()), lists(n.astype(np.int32)[d], off, pa.int32())))
        return pa.concat_tables(out)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return group_rows(table)
        hs, us, ns, fs, hot = [], [], [], [], []
        for cell in table.column("pack"):
            data = cell.as_py()
            (diff, which, n), at = unpack(data, 8, (6, 2, 4))
            (bits,), at = unpack(data, at, (1,))
            (some,), at = unpack(data, at, (6,))
            hs.append(np.cumsum(diff, dtype=np.uint64))
            us.append(int.from_bytes(data[:8], "little") << 16 | which.astype(np.int64))
            ns.append(n.astype(np.int32))
            fam = np.zeros(len(n), np.int64)
            fam[np.unpackbits(bits.astype(np.uint8), count=len(n)).view(bool)] = some.astype(np.int64)
            fs.append(fam)
            hot.append(np.stack(unpack(data, at, (6, 4, 4, 4))[0]).astype(np.int64))
        h, uid, n, fam = np.concatenate(hs), np.concatenate(us), np.concatenate(ns), np.concatenate(fs)
        del hs, us, ns, fs
        heat = np.concatenate(hot, axis=1)
        heat = heat[:, np.argsort(heat[0], kind="stable")]
        cut = heads(heat[0])
        hot_h = heat[0][cut].astype(np.uint64)
        hot_most, hot_n = (np.maximum.reduceat(heat[2], cut), np.add.reduceat(heat[3], cut)) if len(cut) else (np.zeros(0, np.int64),) * 2
        # entries of shingles that several texts have, by shingle and size
        order = np.argsort(h)
        s = h[order]
        same_h = np.zeros(len(s) + 1, dtype=bool)
        same_h[1:-1] = s[1:] == s[:-1]
        several = same_h[1:] | same_h[:-1]
        if len(hot_h):
            several |= hot_h[np.minimum(np.searchsorted(hot_h, s), len(hot_h) - 1)] == s
        order = order[several]
        h, uid, n, fam = h[order], uid[order], n[order].astype(np.int64), fam[order]
        del s, same_h, several
        order = np.lexsort((uid, n, h))
        h, uid, n, fam = h[order], uid[order], n[order], fam[order]
        del order
        every = np.union1d(h, hot_h)
        g = np.searchsorted(every, h)
        first = np.searchsorted(g, np.arange(len(every) + 1))
        most, more = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        here = np.flatnonzero(np.diff(first))
        most[here] = n[first[here + 1] - 1]
        at = np.searchsorted(every, hot_h)
        most[at] = np.maximum(most[at], hot_most)
        more[at] = hot_n
        # of a shingle's texts, as sizes ascend: is there one of another family after it, or before it
        other = np.zeros(len(h), np.int64)
        other[1:] = (g[1:] == g[:-1]) & ((fam[1:] != fam[:-1]) | (fam[1:] == 0))
        other = np.cumsum(other)
        end = first[g + 1]
        by_size = g * 2**34 + n
        equal = np.searchsorted(by_size, by_size)  # the first of its size: of texts of one size each is told
        small = np.flatnonzero((other[end - 1] > other[equal]) | (n[end - 1] >= least_far(n)) | (more[g] > 0))
        ends = np.arange(len(at) + 1)
        out = [
            small_rows(uid[small], n[small], h[small], n_small),
            rows(_HOT, every[at], lists(hot_n, ends, pa.int64()), lists(most[at].astype(np.int32), ends, pa.int32())),
        ]
        del h, uid, n, fam, other, end, by_size, equal
        tx.give_back()
        return pa.concat_tables(out)

    sent = read.mapInArrow(send, "shard long, sub long, pack binary")
    met = written(sent.groupBy("shard", "sub").applyInArrow(meet, MET_DDL))
    hot = met.filter(F.col("kind") == _HOT).select("h", F.col("ns")[0].alias("most"))
    told = met.filter(F.col("kind").isin(_SMALL, _NAMES)).select(F.col("h").alias("shard"), "pack", (F.col("kind") == _NAMES).alias("names"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("uids").value_lengths().to_numpy()
            uid, n = batch.column("uids").flatten().to_numpy(), batch.column("ns").flatten().to_numpy().astype(np.int64)
            h, most = (np.repeat(batch.column(c).to_numpy(), size) for c in ("h", "most"))
            some = np.flatnonzero(most >= n)
            got = small_rows(uid[some], n[some], h[some].astype(np.uint64), n_small)
            yield from got.select(["h", "pack"]).rename_columns(["shard", "pack"]).combine_chunks().to_batches()

    hot_list = met.filter(F.col("kind") == _HOT_LIST)
    if not hot.isEmpty():
        hot_told = hot_list.select("h", "uids", "ns").join(hot, "h").mapInArrow(tell, "shard long, pack binary")
        told = told.unionAll(hot_told.withColumn("names", F.lit(False)))

    def choose(table: pa.Table) -> pa.Table:
        parts, names = [], {}
        for cell, named in zip(table.column("pack"), table.column("names").to_pylist()):
            data = cell.as_py()
            if named:
                names[int.from_bytes(data[:8], "little")] = unpack(data, 8, (8, 4, 6))[0]
            else:
                parts.append(unpack(data, 0, (8, 4, 6))[0])
        uid, n, h = (np.concatenate([np.zeros(0, np.uint64), *(p[c] for p in parts)]).view(np.int64) for c in range(3))
        order = np.lexsort((h, uid))
        uid, n, h = uid[order], n[order], h[order]
        keep = np.ones(len(uid), bool)
        keep[1:] = (uid[1:] != uid[:-1]) | (h[1:] != h[:-1])
        uid, n, h = uid[keep], n[keep], h[keep]
        cut = heads(uid)
        size = np.diff(np.append(cut, len(uid)))
        alive = size >= np.ceil(threshold * n[cut] - 1e-9)
        sets = [h[a : a + k].tobytes() for a, k in zip(cut[alive], size[alive])]
        q, n = uid[cut[alive]], n[cut[alive]]
        tid, fam = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for gid in np.unique(q >> 16).tolist():
            mine = q >> 16 == gid
            tid[mine], fam[mine] = (names[gid][c].view(np.int64)[q[mine] & 0xFFFF] for c in (0, 2))
        return pa.table([*map(pa.array, (tid, fam, n)), pa.array(sets, pa.binary())], names=["q", "fam", "n", "set"])

    chosen = written(told.groupBy("shard").applyInArrow(choose, "q long, fam long, n long, set binary").dropDuplicates(["q"]))
    bytes_all = chosen.agg(F.coalesce(F.sum(F.length("set")), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-bytes_all // set_bytes))
    copied = texts.filter("copies > 1").select("tid")
    if copied.limit(500_001).count() <= 500_000:
        copied = F.broadcast(copied)
    once = read.join(copied, "tid", "left_anti").unionAll(read.join(copied, "tid", "left_semi").dropDuplicates(["tid"]).select(*read.columns))

    def holders(block: int) -> DataFrame:
        """Numbers of links of both ends, and pairs that may join a class, for a block of the smaller texts."""
        got = chosen.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow()
        q, q_fam, q_n = (got.column(c).to_numpy() for c in ("q", "fam", "n"))
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in got.column("set")]
        of = np.repeat(np.arange(len(q), dtype=np.int32), [len(x) for x in sets])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        first = heads(flat)
        del got, sets, order
        shared = base.sparkSession.sparkContext.broadcast((q, q_fam, q_n, flat[first], np.append(first, len(flat)), of))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, q_fam, q_n, every, first, of = shared.value
            q_far, q_least = least_far(q_n), np.ceil(threshold * q_n - 1e-9)
            linked, best = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            none = lambda n, t: pa.nulls(n, t)

            def ends(tid: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
                n = len(tid)
                cols = [pa.array(tid), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.bool_()), pa.array(links)]
                return pa.record_batch(cols, names=["q", "d", "inside", "tie", "links"])

            for batch in batches if len(q) else ():
                tids, fams = batch.column("tid").to_numpy(), families_of(batch)
                for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                    keys, doc = shingles(buf, off)
                    keys >>= _B48
                    order = np.lexsort((keys, doc))
                    keys, doc = keys[order], doc[order]
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                    keys, doc = keys[new], doc[new]
                    size = np.bincount(doc, minlength=hi - lo)
                    at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
                    hit = every[at] == keys
                    at, doc = at[hit], doc[hit]
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                    total = np.concatenate([[0], np.cumsum(first[at + 1] - first[at])])[cut]
                    s = 0
                    while s < hi - lo:  # as many texts as have about a million entries
                        e = max(s + 1, int(np.searchsorted(total, total[s] + (1 << 20), side="right")) - 1)
                        a, d = at[cut[s] : cut[e]], doc[cut[s] : cut[e]]
                        s = e
                        long = first[a + 1] - first[a]
                        pair, has = np.unique(np.repeat(d, long) * len(q) + of[tx.ranges(first[a], long)], return_counts=True)
                        d, i = np.divmod(pair, len(q))
                        n, t = size[d], tids[lo + d]
                        ok = (has >= q_least[i]) & ((n > q_n[i]) | ((n == q_n[i]) & (t > q[i])))
                        ok &= (q_fam[i] == 0) | (q_fam[i] != fams[lo + d]) | (n >= q_far[i])
                        ok &= t != q[i]
                        d, i, n, t, has = d[ok], i[ok], n[ok], t[ok], has[ok]
                        linked += np.bincount(i, minlength=len(q))
                        some, links = np.unique(t, return_counts=True)
                        yield ends(some, links)
                        inside, tie = has >= absorb * q_n[i], has >= same * n
                        np.maximum.at(best, i[inside], n[inside])
                        inside &= (n == best[i]) | (n == q_n[i])
                        p = np.flatnonzero(inside | tie)
                        cols = [pa.array(q[i[p]]), pa.array(t[p]), pa.array(inside[p]), pa.array(tie[p]), none(len(p), pa.int64())]
                        yield pa.record_batch(cols, names=["q", "d", "inside", "tie", "links"])
            some = np.flatnonzero(linked)
            yield ends(q[some], linked[some])
            tx.give_back()

        return written(once.mapInArrow(scan, "q long, d long, inside boolean, tie boolean, links long"))

    found = holders(0)
    for block in range(1, blocks):
        found = found.unionAll(holders(block))
    small, large = texts.select(F.col("tid").alias("q"), F.col("id").alias("a"), F.col("n").alias("m")), texts.select(F.col("tid").alias("d"), F.col("id").alias("b"), "n")
    nothing = [F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("tie")]
    ends = found.filter("d IS NULL").groupBy("q").agg(F.sum("links").alias("links")).join(small, "q").select("a", *nothing, "links")
    pairs = found.filter("d IS NOT NULL").join(small, "q").join(large, "d")
    turned = (F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))  # of equal sizes the one with the smaller id counts as the larger
    pairs = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "n", "inside", "tie")
    no_links = F.lit(None).cast("long").alias("links")
    inside = pairs.filter("inside").select("a", "b", "n", F.lit(False).alias("tie"), no_links)
    ties = pairs.filter("tie").select("a", "b", F.lit(None).cast("long").alias("n"), F.lit(True).alias("tie"), no_links)
    return ends.unionAll(inside).unionAll(ties)
