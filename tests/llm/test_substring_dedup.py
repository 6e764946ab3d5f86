import hashlib
import random

from gleaner.llm import registry
from gleaner.llm.substring_dedup import dedup_windows

from .brute import words


def brute(rows, w=50):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        x = words(t)
        for i in range(len(x) - w + 1):
            g = tuple(x[i : i + w])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, t in rows:
        x = words(t)
        gone = {i + k for i in range(len(x) - w + 1) if first[tuple(x[i : i + w])] < key(d) for k in range(w)}
        body = " ".join(a for i, a in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_planted_repeats(spark):
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    p, q, r = say(60), say(50), say(49)
    rows = [(i, " ".join(say(rng.randrange(5)) + p[i % 7 :] + say(rng.randrange(40)) + q + r + say(i))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " ".join(q)), (103, " ".join(r)), (104, " ".join(p + p + p)), (None, " ".join(q)), (None, " ".join(q))]
    rows += [(105, "a " * 400), (106, "a " * 300), (107, "\x0b".join(q)), (108, " ".join(say(20_000) + q)), (7, rows[7][1]), (200, rows[7][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, cell int")
    assert got(dedup_windows(df, cell_bytes=20_000, bucket_words=2_000)) == brute(rows)
    assert got(dedup_windows(df)) == brute(rows)
    assert dedup_windows(df.limit(0)).count() == 0
    kept = {r.doc_id: r.kept_text for r in dedup_windows(df).collect()}
    assert kept[102] == "" and kept[103] == " ".join(r)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(registry.QUERIES["op4_block_anchors"](spark, sf_dir)) == want
    assert sum(r[2] for r in want) > 0
