"""Concatenate and cut: documents as one token stream, cut into fixed windows.

Pass one tokenises each document once and writes its ids with their place in the partition's stream. Only one total for
each partition reaches the driver; its prefix sums turn local places into places in the whole stream. Pass two cuts that
stream every ``seq_len`` ids and emits one boundary record for each piece; nothing is shuffled. Only the last window has
padding.

Defined cases: null and empty texts hold the end id only; an empty table gives no piece; repeated rows are packed as
often as they occur; a document of any length is cut into as many pieces as it needs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .scratch import written
from .word_bpe import word_bpe

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def token_stream(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, n, doc_id, ids): little-endian 16-bit ids with the end id, and their place in the partition's stream."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, place = word_bpe(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, hi, buf, off in tx.text_chunks(batch.column("text")):
                starts, ends, word_off = tx.word_spans(buf, off)
                ids, counts = bpe.ids(buf, starts, ends)
                cum = np.concatenate([[0], np.cumsum(counts)])[word_off]
                full = np.insert(ids, cum[1:], end_id).astype("<u2")
                at = cum + np.arange(len(cum))
                cells = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(full)])
                yield pa.record_batch(
                    [pa.array(np.full(hi - lo, part)), pa.array(place + at[:-1]), pa.array(np.diff(at)), doc_ids.slice(lo, hi - lo), cells],
                    names=["part", "place", "n", "doc_id", "ids"],
                )
                place += int(at[-1])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(tokenise, "part long, place long, n long, doc_id long, ids binary")


def concat_and_cut(
    docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece; ``ids`` are its little-endian 32-bit ids. Every id of a document is in exactly one piece."""
    stream = written(token_stream(docs, tokenizer, end_id, id_col, text_col))
    totals = stream.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("n")).collect()
    base, total = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        base[r.part] = total
        total += r.n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("ids")
            off = np.frombuffer(cells.buffers()[1], dtype=np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64) // 2
            ids = np.frombuffer(cells.buffers()[2], dtype="<u2")[off[0] : off[-1]].astype("<u4")
            off -= off[0]
            part = batch.column("part").to_numpy()
            begin = batch.column("place").to_numpy() + np.array([base[p] for p in part], dtype=np.int64)
            n = np.diff(off)
            pieces = (begin + n - 1) // seq_len - begin // seq_len + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = tx.ranges(begin // seq_len, pieces)
            first = np.maximum(seq * seq_len, begin[row])
            size = np.minimum((seq + 1) * seq_len, (begin + n)[row]) - first
            at = np.concatenate([[0], np.cumsum(size)])
            for lo in range(0, len(row), 4096):
                hi = min(lo + 4096, len(row))
                body = pa.py_buffer(ids[at[lo] : at[hi]])
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * (at[lo : hi + 1] - at[lo])).astype(np.int32)), body])
                r = row[lo:hi]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(r)),
                        pa.array((first - begin[row])[lo:hi]),
                        pa.array(size[lo:hi]),
                        blob,
                        pa.array(n[r]),
                        pa.array(seq[lo:hi]),
                        pa.array((first - seq * seq_len)[lo:hi]),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return stream.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, seq_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): whole windows, the last one padded. A group has at most ``seq_len`` pieces."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        body = b"".join(x.as_py() for x in table.column("ids"))
        ids = np.full(seq_len, pad_id, dtype=np.int32)
        ids[: len(body) // 4] = np.frombuffer(body, dtype="<u4")
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [ids.tolist()], "n_tokens": [len(body) // 4]}, schema=schema)

    schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])
    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>, n_tokens long")
