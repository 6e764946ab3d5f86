import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import textops as ops
from gleaner.llm import toxicity as tox
from gleaner.llm.toxicity import toxicity_held_out


def corpus(n=900):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "so"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zork", "vile", "qux"]))
        docs.append((i, " ".join(w)))
        if i % 3 == 0 or i % 7:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    truth = {i: i % 6 == 0 for i, _ in docs}
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity_held_out(df, lab).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert sum(bool(r.predicted) == truth[r.doc_id] for r in held) / len(held) > 0.95
    # held-out labels and other columns are never read
    flipped = [(i, q, 1 - t if i in {r.doc_id for r in held} else t) for i, q, t in labels]
    again = toxicity_held_out(df.selectExpr("*", "'x' AS lang"), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {(r.doc_id, round(r.score, 6)) for r in again} == {(r.doc_id, round(r.score, 6)) for r in out}


def test_counts_grow_with_the_labels(spark):
    # max_docs bounds the curve only: the counts hold every labelled training document
    docs, labels = corpus(300)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []

    def spy(train):
        counts = count(train)
        seen.append({tuple(r) for r in counts.select("before", "word", "t", "o").collect()})
        return counts

    count = tox.count_expressions
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tox, "count_expressions", spy)
        for options in ({}, {"max_docs": 20}, {"max_docs": 20, "broadcast_rows": 0}):
            assert toxicity_held_out(df, lab, **options).count() == len(docs)
    assert seen[0] and seen[1] == seen[0] and seen[2] == seen[0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "a b", 2.0), (3, "a", 2.0), (3, "a", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity_held_out(docs, none).collect()} == {(0.0, 0)}
    both = spark.createDataFrame([(1, 0, 0), (3, 0, 1), (3, 1, 0), (9, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity_held_out(docs, both).count() == 5
    assert toxicity_held_out(docs.limit(0), both).count() == 0


def brute_features(train, texts, min_count, discount=0.75, span=8):
    """The same model from its definition, in dictionaries of words."""
    plain = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower() if (t or "").isascii() else (t or ""))
    contexts = [defaultdict(set), defaultdict(set)]
    for text, toxic in train:
        w = plain(text)
        for i in range(1, len(w)):
            contexts[0 if toxic else 1][w[i - 1], w[i]].add(w[i - 2] if i > 1 else None)
    pairs = set(contexts[0]) | set(contexts[1])
    n = {p: [len(c.get(p, ())) for c in contexts] for p in pairs}
    before = [Counter(w for b, w in c) for c in contexts]
    every = Counter(w for b, w in pairs)
    total = [max(sum(c.values()), 1) for c in before]
    kept = {w for w in every if before[0][w] + before[1][w] >= min_count}
    own = {w: [max(before[k][w] - discount, 0) / total[k] for k in (0, 1)] for w in kept}
    rest = [1 - sum(own[w][k] for w in kept) for k in (0, 1)]
    share = sum(every.values()) + len(every) + 1
    p = {w: [own[w][k] + rest[k] * every[w] / share for k in (0, 1)] for w in kept}
    entries = {q for q in pairs if sum(n[q]) >= min_count and q[0] in kept and q[1] in kept}
    after = {b: [max(sum(n[q][k] for q in pairs if q[0] == b), 1) for k in (0, 1)] for b in kept}
    bi = {q: [max(n[q][k] - discount, 0) / after[q[0]][k] for k in (0, 1)] for q in entries}
    back = {b: [min(max(1 - sum(bi[q][k] for q in entries if q[0] == b), 1e-6), 1) for k in (0, 1)] for b in kept}
    log = lambda x: math.log(x[0] / x[1])
    out = []
    for text in texts:
        w, llr = plain(text), []
        for i, x in enumerate(w):
            b = w[i - 1] if i else None
            if (b, x) in entries:
                llr.append(log([bi[b, x][k] + back[b][k] * p[x][k] for k in (0, 1)]))
            else:
                llr.append((log(p[x]) if x in kept else log(rest)) + (log(back[b]) if b in kept else 0))
        out.append((sum(llr) / max(len(llr), 1), max((sum(llr[i : i + span]) / span for i in range(len(llr))), default=0)))
    return out


def test_model_against_brute_force(spark):
    rng = random.Random(9)
    say = lambda k: " ".join(rng.choice(WORDS[k]) for _ in range(rng.randint(1, 25)))
    WORDS = {0: "the of and a to in bad vile awful you are".split(), 1: "the of and a to in good calm day you are".split()}
    train = [(say(i % 2), int(i % 2 == 0)) for i in range(120)]
    df = spark.createDataFrame(train, "text string, toxic int")
    model = tox.KneserNey(tox.count_expressions(df), min_count=4)
    texts = [say(i % 2) + (" unseen words here" if i % 3 else "") for i in range(30)] + ["", "the"]
    for _, _, buf, off in ops.text_chunks(pa.array(texts)):
        got = model.features(buf, off)
    assert np.allclose(got, brute_features(train, texts, 4), atol=1e-9)
