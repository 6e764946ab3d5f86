import zlib

import numpy as np

from gleaner.llm import language_id as li
from gleaner.llm import registry


def test_bundles_match_direct_vectors():
    texts = ["Ab cd!", "", "été à la", "x"]
    codes, at, letters = li.trigram_codes(texts)
    table = li.class_table()
    for i, t in enumerate(texts):
        c = [int(table[ord(x)]) for x in t + "\x00"]
        kept = [x for j, x in enumerate(c) if x or j == 0 or c[j - 1]]
        want, padded = [], [0, 0, *kept]
        for j in range(len(kept)):
            want.append((padded[j] * li.CLASSES + padded[j + 1]) * li.CLASSES + padded[j + 2])
        got = codes[at[i] : at[i + 1]].tolist()
        assert got == want or not t
        assert letters[i] == sum(x.isalpha() for x in t)


def test_cosine_table_equals_vectors(spark):
    rows = [("the cat and the hat", "en"), ("le chat et la souris", "fr")] * 3
    langs, table = li.fit(spark.createDataFrame(rows, "text string, lang string"), dim=256)
    codes, at, _ = li.trigram_codes(["the rat"])
    vec = li.bind(codes, li.letter_vectors(7, 256)).sum(axis=0)
    protos = []
    for lang in langs:
        c, a, _ = li.trigram_codes([t for t, x in rows if x == lang])
        protos.append(li.bind(c, li.letter_vectors(7, 256)).mean(axis=0))
    protos = np.array(protos) - np.mean(protos, axis=0)
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    assert np.allclose(protos @ vec / 16, table[codes].sum(axis=0), atol=1e-2)


def test_held_out_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op6_language_profiles"](spark, sf_dir).collect()}
    right = n = 0
    for r in docs.collect():
        out = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert got[r.doc_id].held_out == out and 0 <= got[r.doc_id].score <= 1
        if out:
            n, right = n + 1, right + (got[r.doc_id].lang_pred == r.lang)
    assert right / n > 0.95
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "the and of it is", "en"), (5, "le la et que", None), (None, "the", "en"), (4, "the and of it is", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = li.language_id(df).collect()
    assert len(out) == 7 and all(r.lang_pred == "und" for r in out if r.doc_id in (1, 2, 3))
    assert li.language_id(df.limit(0)).count() == 0
