import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from gleaner.llm import containment as ct
from gleaner.llm import registry
from gleaner.llm.components import components

from .brute import words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows, t=0.6):
    first = {}
    for i, text in rows:
        if words(text):
            first[text] = min(first.get(text, i), i)
    sets = {i: shingles(text) for text, i in first.items()}
    inv, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    for ids in inv.values():
        for n, a in enumerate(sorted(ids)):
            for b in sorted(ids)[n + 1 :]:
                shared[a, b] += 1
    return {(a, b) for (a, b), n in shared.items() if n >= t * min(len(sets[a]), len(sets[b]))}


def far(texts, a, b):
    part = lambda i: int(ct.partition_of(len(shingles(texts[i]))))
    return abs(part(a) - part(b)) > ct.NEAR


def test_links_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_links(rows)
    degree = defaultdict(int)
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    got = {r.doc_id: r for r in registry.QUERIES["op10_containment"](spark, "/root/testdata/sf0.01").collect()}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    found = sum(got[i].n_links for i in first.values())
    assert all(got[i].n_links <= degree[i] for i in first.values())
    assert found >= 0.97 * sum(degree.values()) > 0
    assert all(got[i].class_id == got[first[t]].class_id for i, t in rows)
    assert sum(far(dict(rows), a, b) for a, b in want) > 0
    small = ct.near_duplicates(docs, few=2, hot=3, block_shingles=500, broadcast_rows=0).drop("text_key").collect()
    assert {tuple(r) for r in small} == {tuple(r) for r in got.values()}


@pytest.mark.parametrize("hot", [2, 64])
def test_far_links_are_complete(spark, hot):
    rng = random.Random(hot)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    common = say(30)
    parts = [say(n) for n in (5, 6, 7, 9, 12, 20, 40, 80)]
    rows = [(i, " ".join(p)) for i, p in enumerate(parts)]
    rows += [(20 + i, " ".join(common + say(10 + i))) for i in range(12)] + [(40, " ".join(common)), (41, " ".join(common[:8]))]
    for i in range(60):
        inner = sum((p if rng.random() < 0.5 else [*p[: len(p) * 2 // 3], "x"] for p in rng.sample(parts, 3)), [])
        rows.append((100 + i, " ".join(say(rng.randrange(300)) + inner + say(200) + (common if i % 2 else []))))
    rows += [(300, rows[-1][1]), (300, rows[-2][1]), (None, rows[-3][1]), (301, None)]
    texts = {i: t for i, t in reversed(rows) if i is not None}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {p for p in brute_links([r for r in rows if r[0] is not None and r[0] < 300]) if far(texts, *p)}
    degree = Counter(x for p in want for x in p)
    assert len(want) > 150
    got = {r.doc_id: r.n_links for r in ct.near_duplicates(df, far={"shard_entries": 900, "group_entries": 2000, "shard_texts": 7, "hot_texts": hot}).collect() if r.doc_id is not None and r.doc_id < 300}
    near = Counter(x for p in brute_links([r for r in rows if r[0] is not None and r[0] < 300]) if not far(texts, *p) for x in p)
    assert all(got[i] == degree[i] for i in texts if i < 300 and not near[i])
    assert all(degree[i] <= got[i] <= degree[i] + near[i] for i in texts if i < 300)


def test_repeated_rows_and_ids(spark):
    t, u = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(4, t), (4, t), (5, t), (None, t), (None, u), (None, u), (6, "a b"), (6, "a c"), (7, t + " " + u), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ct.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got if r.kept] == [7, 6, 6, 8, 8] or sorted(r.doc_id for r in got if r.kept) == [6, 6, 7, 8, 8]
    alone = ct.near_duplicates(df.filter("doc_id IS NULL OR doc_id < 6")).collect()
    assert sorted((str(r.doc_id), r.class_id) for r in alone if r.kept) == [("4", 4), ("None", None)]
    assert sum(r.class_id == 4 for r in alone) == 4


def test_all_links_of_a_large_group(spark):
    say = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*say[:i], f"x{i}", *say[i + 1 :]])) for i in range(60)] + [(100, " ".join(say[:30])), (101, "lone text")]
    degree = defaultdict(int)
    for a, b in brute_links(rows):
        degree[a] += 1
        degree[b] += 1
    assert degree[0] >= 59
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"few": 2, "hot": 7, "block_shingles": 600}):
        got = {r.doc_id: r.n_links for r in ct.near_duplicates(df, **options).collect()}
        assert [got[i] for i in range(60)] == [degree[i] for i in range(60)] and got[101] == 0


def test_edges(spark):
    say = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None), (2, ""), (3, say), (4, say), (5, say.replace("w50", "x")), (6, "two words"), (7, "two words"), (8, say + " " + " ".join(f"v{i}" for i in range(400))), (9, "lone text")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r for r in ct.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert got[1].class_id == 1 and got[2].class_id == 2 and got[9].class_id == 9 and got[9].kept
    assert got[3].class_id == got[4].class_id == got[5].class_id and got[3].n_copies == 1 and got[3].n_links >= 1
    assert got[6].class_id == got[7].class_id == 6 and got[6].kept and not got[7].kept
    assert got[8].kept and sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})
    assert ct.near_duplicates(df.limit(0)).count() == 0


def test_tuning_and_sets():
    for d in range(4):
        rows, bands = ct.tune(0.6, d)
        j = 0.6 / (2 ** ((d + 1) / 2) + 0.4)
        assert 1 - (1 - j**rows) ** bands >= 0.94 and rows * bands <= ct.HASHES
    for _, _, buf, off in ct.tx.text_chunks(pa.array(["a b c d e f a b c d e", "a", None, "a b c d e"])):
        keys, cut = ct.shingle_sets(buf, off)
        assert [int(x) for x in cut[1:] - cut[:-1]] == [6, 1, 0, 1] and keys[cut[3]] in keys[: cut[1]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (100, 102), (7, 300)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 300: 0, 100: 100, 101: 100, 102: 100}


def test_shingles_take_as_many_bytes_for_any_number_of_shards():
    import zlib

    import numpy as np

    from gleaner.llm.far_links import Group

    def sent(n_shards):
        rng, group = np.random.default_rng(1), Group(7, 64)
        group.add(np.arange(500) << 40, np.arange(500) % 9, rng.integers(0, 2**63, 100_000).astype(np.uint64), np.repeat(np.arange(500), 200))
        return sum(len(zlib.compress(x.as_py(), 1)) for batch in group.send(n_shards) for x in batch.column("pack"))

    assert sent(200) < 1.2 * sent(1)


def test_texts_that_share_a_little_are_no_family():
    import numpy as np

    text = lambda k: " ".join([*(f"c{i}" for i in range(12)), *(f"{k}w{i}" for i in range(30 + 40 * (k % 5)))])
    docs = [text(k) for k in range(400)]
    _, _, buf, off = next(iter(ct.tx.text_chunks(pa.array(docs))))
    keys, cut = ct.shingle_sets(buf, off)
    sig = ct.signatures(keys, cut)
    n = len(docs)
    first = {"key": np.zeros(n, np.uint64), "id": np.arange(n), "n": np.diff(cut), "band": np.zeros(n, np.uint8)}
    for rows, _ in {ct.tune(0.6, d) for d in range(ct.NEAR + 1)}:
        k = ct.Keys(first | {"rows": np.full(n, rows, np.uint8)}, (sig[:, ct.HASHES - ct.SKETCH :] & 0xFF).astype(np.uint8))
        i, j = np.triu_indices(n, 1)
        assert ct.compare(k, i, j, [ct.tune(0.6, d) for d in range(ct.NEAR + 1)], 0.6).mean() < 1e-3


def test_every_link_is_found_without_any_family(spark, monkeypatch):
    monkeypatch.setattr(ct, "ALIKE", ct.SKETCH + 1)  # no two texts are candidates, so all links come from the shards
    say = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*say[:i], f"x{i}", *say[i + 1 :]])) for i in range(0, 60, 4)] + [(i, " ".join(say[: i - 75])) for i in range(90, 120, 5)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (None, rows[1][1]), (300, "lone text of a few words")]
    degree = Counter(x for p in brute_links([r for r in rows if r[0] is not None]) for x in p)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: degree[0 if i in (200, 201) else i] for i, _ in rows if i is not None}
    for options in ({}, {"known_rows": 0, "group_entries": 300, "shard_entries": 200, "shard_texts": 3, "set_bytes": 2000}):
        got = {r.doc_id: r for r in ct.near_duplicates(df, far=options).collect() if r.doc_id is not None}
        assert {i: r.n_links for i, r in got.items()} == want
        assert len({got[i].class_id for i in range(0, 60, 4)}) == 1


def test_shuffles_go_when_a_table_is_written(spark, tmp_path):
    import time
    from pathlib import Path

    from gleaner.llm import scratch

    where = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {str(x) for x in where.rglob("shuffle_*.data")}
    before = files()
    scratch.written(spark.range(200_000).repartition(7).groupBy("id").count())
    for _ in range(50):
        if not files() <= before:
            time.sleep(0.1)
    assert files() <= before
