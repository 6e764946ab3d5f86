import numpy as np

from gleaner.llm import registry
from gleaner.llm import weak_labels as wl

from .brute import quality, words


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(4)
    m, n = len(wl.LABELLERS), 40_000
    truth = rng.random(n) < 0.8
    right = np.linspace(0.6, 0.95, m)
    votes = np.where(rng.random((n, m)) < right, truth[:, None], ~truth[:, None]) + 1
    votes[rng.random((n, m)) < 0.2] = 0
    codes, counts = np.unique(votes @ 3 ** np.arange(m - 1, -1, -1), return_counts=True)
    prior, table = wl.estimate(wl.decode(codes), counts.astype(float))
    assert abs(prior - 0.8) < 0.02
    for j in range(m):
        for c in (0, 1):
            said = table[j, c, 1:] / table[j, c, 1:].sum()
            assert abs(said[c] - right[j]) < 0.03
    assert ((wl.posterior(votes, prior, table) > 0.5) == truth).mean() > 0.95


def test_accuracy_against_labels_never_read(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op3_weak_labels"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").max("quality").collect()
    good = [got[i].kept for i, q in labels if q]
    bad = [got[i].kept for i, q in labels if not q]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.35


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 20_000), (5, "#$% ### ***"), (None, "A plain line of words."), (5, "#$% ### ***")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, votes int")
    out = wl.weak_label_quality(df).collect()
    assert len(out) == len(rows)
    assert all(r.score == 0 and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert len({(r.score, r.votes) for r in out if r.doc_id == 5}) == 1
    assert wl.weak_label_quality(df.limit(0)).count() == 0


def brute_votes(text):
    """Votes of all labellers in their order, a text at a time: 0 nothing, 1 bad, 2 good."""
    raw, w = (text or "").encode(), words(text)
    n, chars, symbols, dup, rep = quality(text)
    n_lines = sum(bool(words(line)) for line in (text or "").split("\n"))
    per = lambda k: k / max(n, 1)
    share = lambda ok: sum(map(ok, raw)) / max(len(raw), 1)
    letter = lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 128
    ends = [x.encode()[-1:] for x in w]
    tail = b"#*$%&|<>{}\\~^@=_!?"
    sums = [
        (per(symbols), lambda x: x > 0.15, lambda x: x < 0.02),
        (share(lambda b: 65 <= b < 91), lambda x: x > 0.3, lambda x: x < 0.1),
        (per(rep), lambda x: x > 0.4, lambda x: x < 0.15),
        (per(chars), lambda x: x < 2.5 or x > 11, lambda x: 3 < x < 9),
        (per(sum(e in (b".", b"!", b"?") for e in ends)), lambda x: x < 0.015 or x > 0.5, lambda x: 0.03 < x < 0.3),
        (dup / max(n_lines, 1), lambda x: x > 0.3, lambda x: x == 0 and n_lines > 1),
        (share(letter), lambda x: x < 0.65, lambda x: x > 0.75),
        (per(sum(not any(map(letter, x.encode())) for x in w)), lambda x: x > 0.1, lambda x: x < 0.05),
        (per(sum(e in tail for e in ends)), lambda x: x > 0.25, lambda x: x < 0.08),
        (per(sum(a == b for a, b in zip(w, w[1:]))), lambda x: x > 0.1, lambda x: x < 0.02),
        (n, lambda x: x < 20, lambda x: x > 60),
    ]
    return [1 if bad(x) else 2 if good(x) else 0 for x, bad, good in sums]


def test_votes_and_posteriors_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op3_weak_labels"](spark, sf_dir).collect()}
    votes = np.array([brute_votes(t) for _, t in docs])
    prior, table = wl.estimate(votes, np.ones(len(votes)))  # every document on its own, not patterns with their numbers
    post = wl.posterior(votes, prior, table)
    for (i, _), v, p in zip(docs, votes, post):
        assert got[i].votes == int("".join(map(str, v)), 3) and abs(got[i].posterior - p) < 1e-6
