import random

import numpy as np
import pyarrow as pa

from gleaner.llm import registry
from gleaner.llm import textops as tx
from gleaner.llm.token_count import MARK, UnigramCounter, count_tokens, mark_spans, piece_vocabulary

EDGE = [None, "", " ", "  a  b ", "a", "\n\n x", "▁a▁ b", "<0x41>", "naïve 漢字 🙂🙂 x", "z" * 3000, "a" + " " * 50, "word " * 4000, "é", "the the"]


def library(vocab):
    from tokenizers import Tokenizer, models, pre_tokenizers

    whole = [("<unk>", 0.0), *[(f"<0x{b:02X}>", -1e6) for b in range(256)]]
    seen = {p for p, _ in whole}
    whole = [*[(p, dict(vocab).get(p, s)) for p, s in whole], *[(p, s) for p, s in vocab if p not in seen]]
    tok = Tokenizer(models.Unigram(whole, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return tok


def test_against_library(spark, sf_dir):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    tok = library(piece_vocabulary(path))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in registry.QUERIES["op5_unigram_count"](spark, sf_dir).collect()}
    assert got == want
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(EDGE)], "doc_id long, text string, n_tokens int")
    for r in count_tokens(df, path).collect():
        assert r.n_tokens == len(tok.encode(EDGE[r.doc_id] or "", add_special_tokens=False).ids), r
    assert count_tokens(df.limit(0), path).count() == 0


def test_ties_and_unknowns():
    rng = random.Random(5)
    for _ in range(20):
        pieces = {"".join(rng.choice(["a", "b", "é", MARK]) for _ in range(rng.randint(1, 4))) for _ in range(25)}
        vocab = [(p, -float(rng.randint(1, 4))) for p in sorted(pieces) if MARK not in p[1:]]
        low = min(s for _, s in vocab)
        vocab += [(f"<0x{b:02X}>", low) for b in range(256)]
        tok, counter = library([*vocab, ("<unk>", low)]), UnigramCounter(vocab)
        texts = ["".join(rng.choice("abéc ") for _ in range(rng.randint(0, 30))) for _ in range(40)]
        for _, _, buf, off in tx.text_chunks(pa.array(texts)):
            starts, ends, doc = mark_spans(buf, off)
            n, _ = counter.count(buf, starts, ends)
            got = np.bincount(doc, weights=n, minlength=len(texts)).astype(int).tolist()
        assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
