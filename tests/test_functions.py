import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.functions import html, metrics, nodes, parser

PAGE = """<html><head><title>T</title></head><body><div id=a class="x y"><p>one<p>two <b>bold</b><br>three<ul><li>i<li class=m>j<li>k<li>l<li class=m>n</ul></div>
<table><tr><td>1<td>2<tr><td>3</table><script>var a="</p>";</script><a href="/z?q=1">link</a><img src="i.png"></body></html>"""


def test_tree_and_selectors():
    root = html.parse(PAGE)
    assert [n.text() for n in html.find_all(root, "p")] == ["one", "two bold three"]
    assert [n.text() for n in html.find_all(root, "div#a > ul > li.m")] == ["j", "n"]
    assert len(html.find_all(root, "tr")) == 2 and len(html.find_all(root, "td")) == 3
    assert html.find_only(root, "a[href^='/z']").attr("href") == "/z?q=1"
    assert [n.tag for n in html.children(html.find_only(root, "#a"), "*")] == ["p", "p", "ul"]
    assert html.find_only(root, "b").breadcrumb() == ["html", "body", "div", "p", "b"]
    assert [n.text() for n in html.find_all(root, "title, b")] == ["T", "bold"]
    assert html.find_only(root, ".y").own_text() == "" and html.find_only(root, "img").code() == '<img src="i.png">'
    with pytest.raises(ValueError):
        html.find_only(root, "p")
    with pytest.raises(ValueError):
        html.compile_css("p:hover(")
    assert [x.text() for x in html.find_all(html.parse("<tr><td>a<td>b"), "td")] == ["a", "b"]
    assert html.parse(None).text() == ""


def test_references():
    page = '<!DOCTYPE html><title> a&amp;b &amp;lt; &#x27;&copy;&amp&lt</title><script>a&&b</script><a href="/x?a&b=1&copy=2&amp;c">&quot;&am</a>'
    get = lambda css, name, refs: html.value_of(name)(html.find_only(html.parse(page, refs), css), "")
    assert get("title", "own_data", "escape") == " a&b &lt; '&copy;&amp&lt" and get("title", "own_text", "html") == "a&b &lt; '\u00a9&<"
    assert get("a", "@href", "escape") == "/x?a&b=1&copy=2&c" and get("a", "text", "escape") == '"&am'
    assert get("script", "own_data", "escape") == "a&&b" and get("script", "own_data", "html") == "a&&b"


@pytest.mark.parametrize("name", ["html_title", "html_find_all", "html_href_absolute", "html_siblings_window"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    page = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/{1}">{1}</a></li></ul></nav></body></html>'
    titles = ["a&amp;&amp", "a &lt;  b&quot", " &amp;lt\t&#x2 ", "\u00a0x&copy;&nbsp", "", "&amp"]
    df = spark.createDataFrame([(i, f"http://h{i}/p", page.format(t, t.split()[0] if t.split() else "e")) for i, t in enumerate(titles)], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, con.sql(catalog.ORACLES[name]).fetchall()))
    assert sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_pages_are_parsed_once_and_their_trees_let_go(spark, sf_dir, monkeypatch):
    import gc
    import weakref

    for name in ("html_find_all", "html_href_absolute"):
        assert catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

    class Seen(html.Node):
        __slots__ = ("__weakref__",)

    monkeypatch.setattr(html, "Node", Seen)
    root = html.parse(PAGE)
    nodes_of = [weakref.ref(n) for n in root.walk()]
    gc.disable()
    try:
        root.release()
        assert len(nodes_of) > 20 and not any(r() for r in nodes_of)
    finally:
        gc.enable()


def test_pieces_are_put_together(spark):
    pages = [f"<ul>{'<li>' * (i % 3)}{i}</ul><!--{'x' * 12_000}-->" for i in range(200)]
    assert sum(map(len, pages)) > 2 * html.PIECE
    df = spark.createDataFrame(list(enumerate([*pages, None])), "id int, html string").coalesce(1)
    want = [{"text": [li.text() for li in html.find_all(html.parse(p), "li")]} for p in [*pages, None]]
    for kept in (df, df.filter("id < 0")):
        got = {r.id: r.v for r in kept.select("id", html.select_values(F.col("html"), "li").alias("v")).collect()}
        assert got == ({i: w["text"] for i, w in enumerate(want)} if kept is df else {})


def test_siblings_stop_at_the_next_match():
    root = html.parse(PAGE)
    rows = html.with_siblings(html.find_all(root, "li.m"), -2, 2)
    assert [[n.text() for n in r] for r in rows] == [["i", "j", "k", "l"], ["k", "l", "n"]]


def test_columns(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    out = {r.id: r for r in df.select("id", html.select_values(F.col("html"), "li").alias("v"), html.select_first(F.col("html"), "a", "href", F.lit("http://h/x")).alias("u"), html.all_attributes(F.col("html"), "#a").alias("m")).collect()}
    assert out[1].v == ["i", "j", "k", "l", "n"] and out[1].u == "http://h/z?q=1" and out[1].m == [{"id": "a", "class": "x y"}]
    assert out[2].v == [] and out[2].u is None
    with pytest.raises(Exception, match="expected one match"):
        df.select(html.select_only(F.col("html"), "li")).collect()


def test_json_nodes(spark):
    df = spark.createDataFrame([('{"a": [1, {"a": "x"}], "b": {"a": null, "c": {"a": 2}}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(nodes.json_find_all(F.col("j"), "a")).collect()] == [["1", '{"a": "x"}', "x", "2"], [], []]
    assert [r[0] for r in df.select(nodes.json_find_all(F.col("j"), "a", deep=False)).collect()][0] == ["1", '{"a": "x"}']
    assert [r[0] for r in df.select(nodes.json_path(F.col("j"), "$.b.c.a")).collect()] == ["2", None, None]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    for text in ("", "hello world", "\U0001f600 \u00e9" * 40):
        h = 1125899906842597
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (31 * h + raw[i] + 256 * raw[i + 1]) % 2**64
        assert get(nodes.long_hash(F.lit(text))) == (h - 2**64 if h >= 2**63 else h)
    assert get(nodes.long_hash(F.lit(None).cast("string"))) is None
    assert get(nodes.fill_template(F.lit("a ${x} $$ ${y}"), F.create_map(F.lit("x"), F.lit("1")))) == "a 1 $ ${y}"
    assert [get(nodes.try_boolean(F.lit(x))) for x in ("", "TRUE", "-1", "maybe")] == [True, True, False, None]
    assert get(nodes.canonize_urn(F.lit("http://a.b/c?d=e"))) == "http/a.b/c/d/e"
    assert get(nodes.distinct_name_scopes(F.array(*map(F.lit, "abab")))) == [0, 0, 1, 1]
    assert get(nodes.trace_path_flat(F.array(*map(F.lit, "abcdef")))).startswith("a~b~c~...2~f~")
    m = nodes.merge_attributes(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")), "left")
    assert get(m) == {"a": "1", "b": "3"}
    assert get(nodes.text_or_null(F.lit("  "))) is None
    assert get(nodes.detect_mime(F.lit(bytearray(b"%PDF-1.4")))) == "application/pdf"
    assert get(nodes.detect_charset(F.lit(bytearray(b"\xe9t\xe9")), F.lit("text/plain"))) == "ISO-8859-1"
    assert get(nodes.accept("status2xx", status=F.lit(404))) == "status 404"
    assert [r[0] for r in spark.range(5).select(nodes.in_range(F.col("id"), 1, 3)).collect()] == [False, True, True, False, False]
    assert metrics.as_tree({"a.b": 1, "a.c": 2}) == '{\n  "a": {\n    "b": 1,\n    "c": 2\n  }\n}'


def test_parser():
    rule = parser.literal("${") >> parser.until("}", escape="\\").named("key") >> parser.literal("}")
    assert rule.find("x ${a} ${b\\}c}") == [{"key": "a"}, {"key": "b\\}c"}] and rule.parse("x") is None


def test_structures(spark, tmp_path):
    from gleaner.functions import structures as st
    from gleaner.sources.store import Store

    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert get(st.array_product(arr(1, 2), arr("a", "b"))) == [["1", "a"], ["1", "b"], ["2", "a"], ["2", "b"]]
    with pytest.raises(Exception, match="different sizes"):
        get(st.interleave(arr(1, 2), arr(3)))
    assert get(st.canonical_keys(F.create_map(F.lit("a b"), F.lit("1"), F.lit("a_b"), F.lit("2")))) == {"a_b": "2"}
    assert st.from_xml_text(one.select(F.lit("<row><x>1</x></row>").alias("value")), "x array<int>").first().x == [1]
    assert st.same_type(spark.range(1).schema, spark.createDataFrame([(1,)], "id long").schema)
    store, path = Store(spark), str(tmp_path / "f")
    with store.lock(path):
        assert store.exists(path + ".lock")
        with pytest.raises(TimeoutError), store.lock(path, wait=0):
            pass
    assert not store.exists(path + ".lock") and store.create_new(path) and not store.create_new(path)
    assert store.copy(path, path + "2") and store.move(path, path + "3") and store.exists(path + "2") and not store.exists(path) and store.delete(path + "3")
