import zlib

import numpy as np

from gleaner.llm import registry
from gleaner.llm.packing import concat_and_cut, sequences

EDGE = [None, "", "a", "Don't it's <|endoftext|>a ÀÉ×÷ œuvre İ ΣΑΣ", "naïve é\x1cb x\x85y z", "a1234b!!! ##foo##", "漢字 кири", "z" * 300, "word " * 5000, "a", "é ̈a"]


def tokens(text):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    if "t" not in tokens.__dict__:
        tokens.t = Tokenizer.from_file(path)
    return tokens.t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces, seq_len):
    want = {i: tokens(t) for i, t in rows}
    by, seqs = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by.keys() == want.keys()
    for i, ps in by.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
        assert sum(p.length for p in ps) == len(want[i]) == ps[0].doc_tokens
        for p in ps:
            raw = np.array(want[i][p.start : p.start + p.length], dtype="<u4").tobytes()
            assert zlib.crc32(raw) == (p.ids_crc32 if "ids_crc32" in p else zlib.crc32(p.ids))
    for k, parts in seqs.items():
        parts.sort()
        end = 0
        for at, n in parts:
            assert at == end
            end += n
        assert end == seq_len or k == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))


def test_edge_cases(spark):
    rows = list(enumerate(EDGE))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, offset long")
    path = registry.tokenizer_path("word_bpe_49k.json")
    pieces = concat_and_cut(df, path, seq_len=64)
    check(rows, pieces.collect(), 64)
    whole = {r.sequence_id: r for r in sequences(pieces, 64).collect()}
    assert all(len(r.ids) == 64 for r in whole.values())
    assert sum(r.n_tokens for r in whole.values()) == sum(len(tokens(t)) for _, t in rows)
    assert concat_and_cut(df.limit(0), path).count() == 0
    same = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(p.length for p in concat_and_cut(same, path).collect()) == 8


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], registry.QUERIES["op2_concat_and_cut"](spark, sf_dir).collect(), 2048)
