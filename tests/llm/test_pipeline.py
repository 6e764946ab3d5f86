import numpy as np
import pytest

import corpus_pipeline as cp
from gleaner.llm import pii, registry, scratch
from gleaner.llm.containment import near_duplicates
from gleaner.llm.decontamination import contaminated_pairs

from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    left = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == cp.COLUMNS
        before = {r.doc_id: r for r in docs.collect()}
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = out.collect()
        left[name] = len(after)
        if name == "language":
            assert all(sum(c.isalpha() for c in before[i].text) < 40 for i in set(before) - {r.doc_id for r in after})
            assert sum(r.lang == before[r.doc_id].lang for r in after) >= 0.97 * len(after)
        elif name == "near_dedup":
            judged = near_duplicates(docs).collect()
            assert {r.doc_id for r in after} == {r.doc_id for r in judged if r.kept}
            assert len(after) == len({r.class_id for r in judged}) < len(before)
            assert len({r.text for r in after}) == len(after)
        elif name == "decontamination":
            bad = {r.doc_id for r in contaminated_pairs(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in after} == set(before) - bad
        elif name == "pii":
            for r in after:
                spans = pii.find(before[r.doc_id].text)
                assert all(before[r.doc_id].text[a:b] not in r.text for a, b, _, _ in spans)
                assert r.n_chars == len(r.text) if spans else r.text == before[r.doc_id].text
        else:
            check([(i, r.text) for i, r in before.items()], after, 2048)
        docs = out
    assert n >= left["language"] >= left["near_dedup"] >= left["decontamination"] == left["pii"] > 0.6 * n


def test_run_and_edges(spark, tmp_path):
    pieces = cp.run(spark, SF).collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert np.array_equal(sorted({p.sequence_id for p in pieces}), np.arange(max(p.sequence_id for p in pieces) + 1))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "12", "en", "s", 2), (4, "the and of it was", "en", None, None), (4, "the and of it was", "en", None, None), (None, "le la et que dans les", "fr", "s", 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for frame in (df, df.limit(0)):
        folder = tmp_path / f"t{frame.count()}"
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        docs = frame
        for _, stage in cp.STAGES:
            out = stage(spark, docs, str(folder))
            docs = spark.createDataFrame(out.collect(), out.schema)
        pieces = docs.collect()
        assert {p.doc_id for p in pieces} == ({4, None} if frame is df else set())
        assert sum(p.start == 0 for p in pieces) == (2 if frame is df else 0)  # one row of those that repeat id and text


def test_near_dedup_keeps_one_row_of_each_class(spark, tmp_path):
    say, other = " ".join(f"w{i}" for i in range(90)), " ".join(f"v{i}" for i in range(90))
    rows = [(1, say), (1, say), (2, say), (None, say), (None, other), (None, other), (5, say.replace("w40", "x")), (6, "a b"), (6, "c d"), (7, say + " " + other + " end")]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", len(t), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    df.write.parquet(str(tmp_path / "t"))
    out = cp.near_dedup(spark, spark.read.parquet(str(tmp_path / "t")), SF)
    assert out.columns == cp.COLUMNS
    assert sorted((r.doc_id, r.text[:3]) for r in out.collect()) == [(6, "a b"), (6, "c d"), (7, "w0 ")]
    few = cp.near_dedup(spark, spark.read.parquet(str(tmp_path / "t")).filter("doc_id IS NULL OR doc_id < 7"), SF).collect()
    assert sorted((str(r.doc_id), r.text[:2]) for r in few) == [("1", "w0"), ("6", "a "), ("6", "c "), ("None", "v0")]


def test_every_stage_begins_with_trimmed_heaps(spark, monkeypatch):
    class TrimmedError(Exception):
        pass

    def trim_heaps(_):
        raise TrimmedError

    monkeypatch.setattr(scratch, "trim_heaps", trim_heaps)
    for _, stage in cp.STAGES:
        with pytest.raises(TrimmedError):
            stage(spark, None, SF)


def test_trim_heaps_collects_in_tasks_and_driver(spark):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collections()
    scratch.trim_heaps(spark)
    assert collections() >= before + 2  # tasks and driver share a JVM here; collections asked for at once may be one


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is cp.run and [k for k in registry.QUERIES if k.startswith("op")] and cp.ORACLE_SQL is None
