"""Words and lines that clash under any polynomial hash modulo a power of two."""

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import containment, registry
from gleaner.llm import textops as tx
from gleaner.llm.packing import concat_and_cut
from gleaner.llm.quality_rules import base_block
from gleaner.llm.substring_dedup import dedup_windows
from gleaner.llm.token_count import MARK, count_tokens, piece_vocabulary

from .brute import quality
from .test_packing import check
from .test_substring_dedup import brute, got
from .test_token_count import library


def twins(n, a="a", b="b"):
    """Two Thue-Morse words of n letters."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [8, 16, 256, 512, 1024, 4096])
def test_span_hashes(n):
    a, b = twins(n)
    for _, _, buf, off in tx.text_chunks(pa.array([f"{a} {b} {a}"])):
        starts, ends, _ = tx.word_spans(buf, off)
        h = tx.span_hashes(buf, starts, ends)
        assert h[0] == h[2] != h[1]
        assert tx.same_bytes(buf, starts[[0, 0]], buf, starts[[1, 2]], (ends - starts)[[0, 0]]).tolist() == [False, True]
    for _, _, buf, off in tx.text_chunks(pa.array([f"{a}\n{b}\n{a}"])):
        assert base_block(buf, off).stats["n_dup_lines"].tolist() == [1]


def test_spans_at_any_place():
    rng = np.random.default_rng(1)
    raw = rng.integers(33, 127, 3000).astype(np.uint8)
    starts = rng.integers(0, 2000, 400)
    ends = starts + rng.integers(1, 300, 400)
    h = tx.span_hashes(raw, starts, ends)
    for i in range(0, 400, 7):
        alone = raw[starts[i] : ends[i]]
        assert tx.span_hashes(alone, np.array([0]), np.array([len(alone)]))[0] == h[i]
    assert len(np.unique(h)) == len({raw[s:e].tobytes() for s, e in zip(starts, ends)})


def test_equality_by_bytes(monkeypatch):
    """With a hash of very few values the results stay the same."""
    monkeypatch.setattr(tx, "span_hashes", lambda buf, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    memo = tx.Memo(1000, (np.int64,))
    for text in ("abc de fgh abc xyz longer words longer wards de", "xyz abc ab fgh words wards new"):
        for _, _, buf, off in tx.text_chunks(pa.array([text])):
            s, e, _ = tx.word_spans(buf, off)
            work = lambda s, e: [np.array([sum(buf[a:b].tolist()) for a, b in zip(s, e)])]
            assert memo.values_of(buf, s, e, work)[0].tolist() == [sum(w.encode()) for w in text.split()]
    text = "one line\ntwo line\none line\nsix line\n\nsix line\n1234567"
    for _, _, buf, off in tx.text_chunks(pa.array([text, text])):
        assert base_block(buf, off).stats["n_dup_lines"].tolist() == [quality(text)[3]] * 2


def test_operators(spark):
    a, b = twins(2048)
    a2, b2 = twins(1024)
    line = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{a} {b}"), (2, f"{b} {a2}\n{b2}"), (3, f"{line} {a2}"), (4, f"{line} {b2}"), (5, f"x {line} {a2}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, concat_and_cut(df, registry.tokenizer_path("word_bpe_49k.json")).collect(), 2048)
    assert got(dedup_windows(df)) == brute(rows)
    path = registry.tokenizer_path("piece_bpe_32k.model")
    tok = library(piece_vocabulary(path))
    assert MARK and {r.doc_id: r.n_tokens for r in count_tokens(df, path).collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    for _, _, buf, off in tx.text_chunks(pa.array([t for _, t in rows])):
        keys, cut = containment.shingle_sets(buf, off)
        sets = [set(keys[x:y].tolist()) for x, y in zip(cut[:-1], cut[1:])]
    assert sets[2] != sets[3] and len(sets[2] & sets[3]) == 45 and len({frozenset(s) for s in sets}) == 5
