"""Exact removal of repeated word windows by fixed-block anchors.

A window of ``window`` words always holds one whole block of ``window // 2`` words that starts at a multiple of that
length in the other document. So the non-overlapping blocks of every document are the index, every rolling
window of that length is a probe, and what both sides of a hit can extend to is all that has to be compared.

Documents live in cells: a cell is a bounded share of the text, chosen by a hash of id and text, so that neither one id nor rows without one
fill a cell. Text moves once, to its cell;
three uses of that one exchange share it. All the rest that moves are sorted, delta-coded hash lists between cells and
hash buckets. A hash counts once for each cell that has it, however often it occurs there, so that a passage found in
a third of all documents is one entry for each cell and not one for each document.

1. cells send the distinct hashes of all rolling windows, marked where the window is a block or occurs in two documents;
2. buckets reply with hashes that are a block somewhere and occur in two documents;
3. cells extend each hit to all windows around it and send the hashes of these windows with their smallest document;
4. buckets reply with hashes which have a smaller document in another cell;
5. cells remove the words covered by windows with a smaller document, here or elsewhere.

Full windows are compared by 64 bits and by 32 of a second hash of the same words, in which other words clash.

Defined cases: null and empty texts have no words; documents shorter than a window lose nothing; a null id counts as
larger than all others; rows with the same id are one document and do not remove each other's words, but repeats in
other documents do; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
LISTS = "bucket long, cell long, planes binary, docs binary, n long"
BIG = np.int64(2**63 - 1)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = 0x165667B19E3779F9


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as byte planes of their differences; the high planes are nearly all zero."""
    diff = values.astype(np.uint64)
    diff[1:] = diff[1:] - diff[:-1]
    return np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_plain(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


class Cell:
    """The documents of one cell, ordered by id, with the hashes of their windows."""

    def __init__(self, table: pa.Table, window: int) -> None:
        ids = np.array([BIG if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order)) if len(order) else table
        self.ids, self.window, self.block = ids[order], window, window // 2
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, _, buf, off in tx.text_chunks(self.table.column("text")):
            starts, ends, word_off = tx.word_spans(buf, off)
            hashes.append(tx.span_hashes(buf, starts, ends))
            counts.append(np.diff(word_off))
            self.spans.append((buf, starts, ends))
        self.words = np.concatenate(hashes)
        self.word_off = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.n_words = np.diff(self.word_off)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of n words, and their hashes."""
        grams = tx.ngram_hashes(self.words, n)
        at = np.flatnonzero(tx.window_mask(self.word_off, n, len(self.words))[: len(grams)])
        return at, tx.mix(grams[at])

    def checks(self, start: np.ndarray) -> np.ndarray:
        """32 bits of another hash of the full windows that start there."""
        words = np.concatenate([np.zeros(0, np.uint64), *(tx.span_hashes(*span, salt=_OTHER) for span in self.spans)])
        return tx.mix(tx.ngram_hashes(words, self.window)[start]) >> np.uint64(32)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Smallest row with the id of the document that holds each word."""
        return np.searchsorted(self.ids, self.ids)[np.searchsorted(self.word_off, at, side="right") - 1]

    def probes(self) -> np.ndarray:
        """Distinct 62-bit hashes of rolling windows; the low bits say: is a block, occurs in two documents."""
        at, h = self.windows(self.block)
        doc = np.searchsorted(self.word_off, at, side="right") - 1
        aligned = (at - self.word_off[doc]) % self.block == 0
        key = h >> np.uint64(2) << np.uint64(2)
        order = np.argsort(key)
        key, aligned, doc = key[order], aligned[order], np.searchsorted(self.ids, self.ids)[doc[order]]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(cut):
            return key
        block = np.logical_or.reduceat(aligned, cut)
        several = np.maximum.reduceat(doc, cut) != np.minimum.reduceat(doc, cut)
        return key[cut] | block.astype(np.uint64) | (several.astype(np.uint64) << np.uint64(1))


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    where = np.searchsorted(sorted_set, values)
    where[where == len(sorted_set)] = 0
    return sorted_set[where] == values


def first_docs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the place of the first of each; documents ascend with the rows of a cell, so it is in the smallest."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    return h[first], order[first]


def both(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """One number for the two hashes of a window, good among the windows of one cell."""
    return tx.mix(h + check * _SALT)


def checks_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint32)[-n:].astype(np.uint64) if n else np.zeros(0, np.uint64)


def dedup_windows(
    docs: DataFrame, window: int = 50, cell_bytes: int = 8 << 20, bucket_words: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Per document the words left after removing each one covered by a window that also starts in a smaller document.

    ``cell_bytes`` and ``bucket_words`` bound what one task holds; ``with_text`` false leaves kept_text null.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n_cells = max(1, -(-size // cell_bytes))
    n_buckets = max(1, -(-size // (6 * bucket_words)))
    cells = base.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_cells))).repartition(n_cells, "cell")

    def split(cell: int, keys: np.ndarray, chosen: np.ndarray, docs: tuple[np.ndarray, np.ndarray] | None, schema: pa.Schema) -> pa.Table:
        """Rows for each bucket of ascending keys."""
        order = np.argsort(chosen, kind="stable")
        cut = np.searchsorted(chosen[order], np.arange(n_buckets + 1))
        rows = []
        for b in range(n_buckets):
            pick = order[cut[b] : cut[b + 1]]
            if len(pick):
                rows.append((b, cell, pack_sorted(keys[pick]), pack_plain(docs[0][pick]) + docs[1][pick].astype(np.uint32).tobytes() if docs is not None else b"", len(pick)))
        return pa.table(list(map(list, zip(*rows))) if rows else [[]] * 5, schema=schema)

    lists = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("planes", pa.binary()), ("docs", pa.binary()), ("n", pa.int64())])

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return (tx.mix(h ^ _SALT) % np.uint64(n_buckets)).astype(np.int64)

    def send_probes(key: tuple, table: pa.Table) -> pa.Table:
        marked = Cell(table, window).probes()
        top = marked >> np.uint64(2)
        # 30 bits beside those of the bucket are enough to find hits: a false one only adds windows to compare
        short = (top >> np.uint64(32)) << np.uint64(2) | (marked & np.uint64(3))
        chosen = (top % np.uint64(n_buckets)).astype(np.int64)
        return split(key[0].as_py(), short, chosen, None, lists)

    def gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = [unpack_sorted(x.as_py()) for x in table.column("planes")]
        return np.concatenate(keys), np.repeat(np.arange(len(keys)), list(map(len, keys)))

    def reply(table: pa.Table, key: int, keys: np.ndarray, owner: np.ndarray, check: np.ndarray | None = None) -> pa.Table:
        cells = table.column("cell").to_numpy()
        order = np.lexsort((keys, owner))
        cut = np.searchsorted(owner[order], np.arange(len(cells) + 1))
        rows = []
        for i in range(len(cells)):
            pick = order[cut[i] : cut[i + 1]]
            if len(pick):
                rows.append((key, int(cells[i]), pack_sorted(keys[pick]), check[pick].astype(np.uint32).tobytes() if check is not None else b"", len(pick)))
        return pa.table(list(map(list, zip(*rows))) if rows else [[]] * 5, schema=lists)

    def find_hits(key: tuple, table: pa.Table) -> pa.Table:
        marked, owner = gather(table)
        h = marked >> np.uint64(2)
        order = np.argsort(h)
        s, m = h[order], marked[order]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        block = np.bitwise_or.reduceat(m & np.uint64(1), cut) > 0
        n = np.diff(np.append(cut, len(s)))
        several = (np.bitwise_or.reduceat(m & np.uint64(2), cut) > 0) | (n > 1)
        good = np.repeat(block & several, n)
        back = np.zeros(len(h), dtype=bool)
        back[order] = good
        return reply(table, key[0].as_py(), h[back], owner[back])

    def hit_set(table: pa.Table) -> list[tuple[int, np.ndarray]]:
        return [(b.as_py(), np.unique(unpack_sorted(x.as_py()))) for b, x in zip(table.column("bucket"), table.column("planes"))]

    def send_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([[]] * 5, schema=lists)
        cell = Cell(left, window)
        row, _, h, check = candidates(cell, right)
        _, first = first_docs(both(h, check))
        first = first[np.argsort(h[first])]
        return split(key[0].as_py(), h[first], bucket_of(h[first]), (cell.ids[row[first]], check[first]), lists)

    def candidates(cell: Cell, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of the document, start word, hash, check) of the windows around the hits."""
        at, h = cell.windows(cell.block)
        top = h >> np.uint64(2)
        chosen = (top % np.uint64(n_buckets)).astype(np.int64)
        found = np.zeros(len(at), dtype=bool)
        order = np.argsort(chosen, kind="stable")
        cut = np.searchsorted(chosen[order], np.arange(n_buckets + 1))
        for b, hits in hit_set(right):
            pick = order[cut[b] : cut[b + 1]]
            found[pick] = member(top[pick] >> np.uint64(32), hits)
        marks = np.zeros(len(cell.words) + 1, dtype=np.int64)
        hit = at[found]
        np.add.at(marks, np.maximum(hit - (window - cell.block), 0), 1)
        np.add.at(marks, hit + 1, -1)
        grams = tx.ngram_hashes(cell.words, window)
        ok = (np.cumsum(marks)[:-1] > 0) & tx.window_mask(cell.word_off, window, len(cell.words))
        start = np.flatnonzero(ok[: len(grams)])
        return cell.doc_of(start), start, tx.mix(grams[start]), cell.checks(start)

    def find_smaller(key: tuple, table: pa.Table) -> pa.Table:
        h, owner = gather(table)
        data = [(x.as_py(), n) for x, n in zip(table.column("docs"), table.column("n").to_pylist())]
        docs = np.concatenate([unpack_plain(x[: 8 * n]) for x, n in data])
        check = np.concatenate([checks_of(x, n) for x, n in data])
        order = np.lexsort((check, h))
        s, d, c = h[order], docs[order], check[order]
        cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
        least = np.repeat(np.minimum.reduceat(d, cut), np.diff(np.append(cut, len(s))))
        back = np.zeros(len(h), dtype=bool)
        back[order] = least < d
        return reply(table, key[0].as_py(), h[back], owner[back], check[back])

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([[]] * 5, schema=result)
        tag = np.array(right.column("step").to_pylist(), dtype=np.int64)
        hits = right.filter(pa.array(tag == 2))
        cell = Cell(left, window)
        gone = np.zeros(len(cell.words), dtype=bool)
        if hits.num_rows:
            row, start, h, check = candidates(cell, hits)
            full, told = both(h, check), right.filter(pa.array(tag == 4))
            smaller = [both(unpack_sorted(x.as_py()), checks_of(c.as_py(), n)) for x, c, n in zip(told.column("planes"), told.column("docs"), told.column("n").to_pylist())]
            bad = member(full, np.unique(np.concatenate(smaller)) if smaller else np.zeros(0, np.uint64))
            keys, first = first_docs(full)
            bad |= row > row[first[np.searchsorted(keys, full)]]
            marks = np.zeros(len(cell.words) + 1, dtype=np.int64)
            marks[start[bad]] += 1
            marks[start[bad] + window] -= 1  # starts are distinct, and so are ends
            gone = np.cumsum(marks)[:-1] > 0
        removed = tx.per_doc(gone.astype(np.int64), cell.word_off)
        sha, kept = [], []
        for i, text in enumerate(cell.table.column("text")):
            words = text.as_py().encode("utf-8").split()
            if removed[i]:
                stay = ~gone[cell.word_off[i] : cell.word_off[i + 1]]
                words = [w for w, ok in zip(words, stay.tolist()) if ok]
            body = b" ".join(words)
            sha.append(hashlib.sha256(body).hexdigest())
            kept.append(body if with_text else None)
        out = [cell.table.column("doc_id"), pa.array(cell.n_words), pa.array(removed), pa.array(sha), pa.array(kept, type=pa.binary()).cast(pa.string())]
        return pa.table(out, schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    probes = cells.groupBy("cell").applyInArrow(send_probes, LISTS)
    hits = probes.groupBy("bucket").applyInArrow(find_hits, LISTS)
    sent = cells.groupBy("cell").cogroup(hits.groupBy("cell")).applyInArrow(send_windows, LISTS)
    smaller = sent.groupBy("bucket").applyInArrow(find_smaller, LISTS)
    replies = hits.withColumn("step", F.lit(2)).unionAll(smaller.withColumn("step", F.lit(4)))
    return cells.groupBy("cell").cogroup(replies.groupBy("cell")).applyInArrow(remove, SCHEMA)
