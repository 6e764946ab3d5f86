"""Language identification with hyperdimensional profiles.

Every letter class has a random +1/-1 vector. An n-gram vector binds (multiplies) the vectors of its letters, each
permuted (rolled) by its place, and a text is the bundle (sum) of its n-gram vectors. A language's prototype is the
bundle of its training texts, centred by the mean of all prototypes; a text gets the language of the prototype
with the largest cosine.

Since bundles are linear, the products of all n-gram vectors with the prototypes form one table of fixed size
(``CLASSES ** 3`` rows), and the product of a text's bundle with a prototype is a sum of table entries. The bundle's own
length is the same for every language; it is taken from the n-gram counts, as n-gram vectors are nearly orthogonal.

Training counts n-grams of all training texts per language, summed inside each task before the shuffle; a task then bundles
the at most ``CLASSES ** 3`` counts of a language, and only prototypes come to the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training row every text is
``und``; very long texts are read whole; an empty table gives an empty result; repeated rows are judged alike; ties go to the
first language by name; columns named doc_id, lang_pred or score are replaced by ours, other columns are kept if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

CLASSES = 96
DIM = 1024
HELD = 16  # languages whose counts a task holds at a time
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part


_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Letter class of each code point: 0 is no letter, 1-26 the basic letters, the others by code point, far ones hashed."""
    if not _table:
        out = np.zeros(0x110000, dtype=np.uint8)
        for cp in range(0x80, 0x110000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                cp2 = ord(low[0])
                out[cp] = cp2 - 96 if 97 <= cp2 <= 122 else 27 + (cp2 * 2654435761 >> 7) % (CLASSES - 27) if cp2 >= 0x100 else 27 + (cp2 - 0xC0) % (CLASSES - 27)
        out[97:123] = np.arange(1, 27)
        out[65:91] = np.arange(1, 27)
        _table.append(out)
    return _table[0]


def trigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all letter trigrams, the first of each text, and the number of letters of each text."""
    joined = "\x00".join(texts) + "\x00"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    c = class_table()[cp]
    off = np.concatenate([[0], np.cumsum(lens)])
    letters = tx.per_doc((c > 0).astype(np.int64), off)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    k = c[keep].astype(np.int32)
    codes = np.zeros(len(k), dtype=np.int32)
    codes[2:] = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
    # a text starts after a gap, whatever stands before it
    for step in (0, 1):
        i = at[:-1] + step
        i = i[i < at[1:]]
        codes[i] = k[i] if step == 0 else k[i - 1] * CLASSES + k[i]
    return codes, at, letters


def text_blocks(batch: pa.RecordBatch, limit: int = tx.CHUNK) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of a batch in blocks of a bounded number of characters."""
    texts = batch.column("text").to_pylist()
    lo, size = 0, 0
    for i, t in enumerate(texts):
        texts[i] = t = t or ""
        if size and size + len(t) > limit // 2:
            yield lo, i, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def letter_vectors(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(CLASSES, dim))


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """N-gram vectors: the letters' vectors, rolled by place and multiplied."""
    a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def train_counts(train: DataFrame) -> DataFrame:
    """(lang, code, n) over all training texts."""

    def told(lang: str, got: np.ndarray) -> pa.RecordBatch:
        code = np.flatnonzero(got)
        return pa.record_batch([pa.array([lang] * len(code), type=pa.string()), pa.array(code), pa.array(got[code])], names=["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lo, hi, texts in text_blocks(batch):
                codes, at, _ = trigram_codes(texts)
                owner = np.repeat(np.arange(hi - lo), np.diff(at))
                for lang in set(langs[lo:hi]):
                    mine = (langs[lo:hi] == lang)[owner]
                    got = np.bincount(codes[mine], minlength=CLASSES**3)
                    sums[lang] = sums[lang] + got if lang in sums else got
            if len(sums) > HELD:
                yield from map(told, sums, sums.values())
                sums = {}
        yield from map(told, sums, sums.values())

    return train.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, dim: int = DIM, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages, and the table of products of n-gram vectors with unit prototypes."""
    vectors = letter_vectors(seed, dim)

    def bundle(key: tuple, table: pa.Table) -> pa.Table:
        code, n = table.column("code").to_numpy(), table.column("n").to_numpy().astype(np.float64)
        order = np.argsort(code)
        code, n = code[order], n[order] / n.sum()
        total = np.zeros(dim)
        for lo in range(0, len(code), 2048):
            total += n[lo : lo + 2048] @ bind(code[lo : lo + 2048], vectors)
        return pa.table([[key[0].as_py()], [total.tobytes()]], names=["lang", "bundle"])

    # one vector a language comes to the driver
    got = {r.lang: np.frombuffer(bytes(r.bundle)) for r in train_counts(train).groupBy("lang").applyInArrow(bundle, "lang string, bundle binary").collect()}
    langs = sorted(got)
    protos = np.array([got[lang] for lang in langs]).reshape(len(langs), dim)
    if len(langs) > 1:
        protos -= protos.mean(axis=0)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    table = np.zeros((CLASSES**3, len(langs)), dtype=np.float32)
    for lo in range(0, CLASSES**3, 2048):
        codes = np.arange(lo, min(lo + 2048, CLASSES**3))
        table[codes] = bind(codes, vectors) @ protos.T.astype(np.float32)
    return langs, table / np.sqrt(dim)


def identify(
    docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 20.0, keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, lang_pred, score, and the columns of ``keep``) for each document; train has (text, lang)."""
    langs, table = fit(train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    # the table has a fixed number of rows, one column a language
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))
    extra = [c for c in keep or [] if c not in ("doc_id", "text", "lang_pred", "score")]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    fields = [f for f in base.schema.fields if f.name in extra or (f.name == "text" and "text" in (keep or []))]
    schema = base.select("doc_id").schema
    for f in fields:
        schema = schema.add(f)
    schema = schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            for lo, hi, texts in text_blocks(batch):
                codes, at, letters = trigram_codes(texts)
                sure = np.zeros((hi - lo, max(len(langs), 1)))
                for j in range(len(langs)):
                    sure[:, j] = tx.per_doc(table[:, j][codes].astype(np.float64), at)
                owner = np.repeat(np.arange(hi - lo), np.diff(at))
                norm = np.sqrt(_square_counts(codes, owner, hi - lo))
                sure /= np.maximum(norm, 1e-9)[:, None]
                best = sure.argmax(axis=1)
                odds = np.exp(sharpness * (sure - sure.max(axis=1, keepdims=True)))
                p = np.round(1 / odds.sum(axis=1), 6)
                none = (letters == 0) | (len(langs) == 0)
                pred = np.array([*langs, "und"], dtype=object)[np.where(none, len(langs), best)]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, hi - lo)]
                    + [batch.column(f.name).slice(lo, hi - lo) for f in fields]
                    + [pa.array(pred, type=pa.string()), pa.array(np.where(none, 0.0, p))],
                    names=["doc_id", *[f.name for f in fields], "lang_pred", "score"],
                )

    return base.mapInArrow(score, schema)


def _square_counts(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text the sum of squared n-gram counts."""
    keys = np.sort(owner.astype(np.int64) * CLASSES**3 + codes)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    size = np.diff(cut)
    return np.bincount(keys[cut[:-1]] // CLASSES**3, weights=size.astype(np.float64) ** 2, minlength=n) if len(size) else np.zeros(n)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from all documents outside the held-out quarter and judge every document."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = named.filter(~F.coalesce(held_out("doc_id", 4, 2), F.lit(False)))
    out = identify(named, train)
    return out.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
