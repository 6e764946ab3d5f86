import pytest

from gleaner.llm.quality_rules import quality_cascade

from .brute import quality

EDGE = [None, "", " ", "\n\n", "a", "a b c a b c", "x\ny\nx\n x\nx", "é ü #|<", "w " * 3000, "\x0b\x0ca\x1cb", "a\nb", "b"]


def check(rows, got):
    by = {r.doc_id: r for r in got}
    assert len(by) == len(rows)
    for i, text in rows:
        r, want = by[i], quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, text and text[:80])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_edge_cases(spark):
    rows = list(enumerate(EDGE))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n_words long")
    check(rows, quality_cascade(df).collect())
    assert quality_cascade(df.limit(0)).count() == 0
    blank = [(0, None), (1, ""), (2, "")]
    check(blank, quality_cascade(spark.createDataFrame(blank, "doc_id long, text string").coalesce(1)).collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality_cascade(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert 0.5 < sum(r.kept for r in got) / len(got) < 1


def test_order_does_not_change_the_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = ({(r.doc_id, r.kept) for r in quality_cascade(docs, sample_rows=n).collect()} for n in (1, 200))
    assert one == two
