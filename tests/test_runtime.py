import io
import pickle
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gleaner import errors, runtime
from gleaner.conf import Conf
from gleaner.functions import html, nodes, parser
from gleaner.operators import keyed, sampling
from gleaner.plans import actions as ac
from gleaner.plans import explore, fetch
from gleaner.sources import files, web
from gleaner.view import View


def fail(text):
    raise ValueError(text)


def test_failures_judged_together():
    ok, bad = (lambda: 1), (lambda: fail("no"))
    assert errors.all_must("m", [ok, ok]) == [1, 1] and errors.one_must("m", [bad, ok]) == [1] and errors.first_success("m", [bad, ok, lambda: 1 / 0]) == 1
    for judge, runs in ((errors.all_must, [ok, bad]), (errors.one_must, [bad, bad]), (errors.first_success, [bad]), (errors.one_must, [])):
        with pytest.raises(ExceptionGroup) as e:
            judge("m", runs)
    assert errors.as_lines(ExceptionGroup("m", [ValueError("a"), ExceptionGroup("n", [KeyError("b")])])) == ["ExceptionGroup: m", "  ValueError: a", "  ExceptionGroup: n", "    KeyError: b"]
    assert str(errors.ActionFailed("down", ac.get("u"))) == "down; after: get u" and issubclass(errors.WriteFailed, errors.EngineError) and e


def test_temporary_and_jobs(spark, tmp_path):
    with runtime.temporary(spark) as held:
        df = held.persist(spark.range(4))
        held.view(df, "gone")
        assert held.broadcast(3).value == 3 and spark.table("gone").count() == 4 and df.is_cached and len(held) == 3
    assert not df.is_cached and not spark.catalog.tableExists("gone") and len(held) == 0
    parts = spark.range(0, 8, 1, 4)
    with ThreadPoolExecutor(2) as pool:
        jobs = [runtime.partition_later(parts, i, pool) for i in range(4)]
        assert [[r.id for r in j.result()] for j in jobs] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    many = runtime.disperse(parts, 3)
    assert many.rdd.getNumPartitions() == 12 and sorted(r.id for r in many.collect()) == list(range(8))
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert [r.result for r in runtime.everywhere(spark, lambda: "x", 3).collect()] == ["x"] * 3
    (tmp_path / "tool").write_text("bin")  # no other test may ship a file of this name
    at = runtime.deploy(spark, str(tmp_path / "tool"))
    assert runtime.everywhere(spark, at, 1).first().result == str(tmp_path / "tool")
    (tmp_path / "tool").rename(tmp_path / "kept")
    assert open(at()).read() == "bin"
    (tmp_path / "kept").rename(tmp_path / "tool")
    assert [tuple(r) for r in runtime.conflicts(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "r int, u string"), "r", "u").collect()] == [(1, 2)]


def test_clocks_and_guards():
    watch, beats = runtime.Stopwatch(), []
    with watch.split("a"):
        assert runtime.with_heartbeat(lambda: time.sleep(0.25) or 7, 5, beats.append, 0.1) == 7
    assert len(beats) >= 1 and watch.seconds["a"] >= 0.2
    stop = threading.Event()
    with pytest.raises(TimeoutError):
        runtime.with_heartbeat(stop.wait, 0.2, beats.append, 0.1)
    stop.set()
    with pytest.raises(TypeError):
        pickle.dumps(runtime.DriverOnly(1))
    s, opened = runtime.Session(lambda: 5.0), io.StringIO()
    s.did({"op": "get"})
    assert s.open(lambda: opened) is opened and s.backtrace == [{"op": "get"}] and s.seconds == 0
    s.close()
    assert opened.closed
    told = []
    p = runtime.Progress(io.BytesIO(b"abcdef"), lambda r, w: told.append((r, w)))
    assert p.read(4) == b"abcd" and p.write(b"xy") == 2 and told == [(4, 0), (4, 2)] and p.tell() == 6


def test_parser_backtracks():
    lit, many = parser.literal, parser.one_of("", but=True).many()
    rule = lit("<") >> many.named("x") >> lit(">")
    assert rule.parse("<a>b>") == {"x": "a>b"} and rule.parse("<a") is None
    key = lit("${") >> parser.until("}", escape="\\").to(str.upper, "key") >> lit("}")
    assert key.find("x ${a} ${b\\}c}") == [{"key": "A"}, {"key": "B\\}C"}]
    assert key.replace("x ${a} $ ${b}", lambda m: f"[{m['key']}]") == "x [A] $ [B]"
    assert (lit("ab").many(2) >> parser.END).parse("ababab") == {} and (lit("ab").many(4) >> parser.END).parse("ababab") is None
    assert (lit("a") | lit("ab")).many().parse("abaab") is None or (lit("a") | lit("ab")).many().parse("abaab") == {}
    assert ((lit("a") | lit("ab")).many() >> parser.END).parse("abaab") == {}
    r = parser.Replay(iter(range(5)))
    assert [next(r), next(r)] == [0, 1]
    mark = r.at
    assert list(r) == [2, 3, 4]
    r.back(mark)
    r.forget(mark)
    assert next(r) == 2
    with pytest.raises(ValueError):
        r.back(0)


def test_nodes(spark):
    root = html.parse("<div id=a><p name=n>one <b>two</b></p><a href=x>go there</a></div>")
    assert [n.tag for n in html.find_by(root, "id:a")] == ["div"] and html.find_by(root, "name:n")[0].tag == "p" and len(html.find_by(root, "tag:A")) == 1
    assert html.find_by(root, "link:go there") == html.find_by(root, "partial_link:there") == html.find_by(root, "css:div > a") == html.find_by(root, "a[href]")
    assert html.find_by(root, "id:a")[0].formatted_code() == '<div id="a">\n  <p name="n">\n    one\n    <b>\n      two\n    </b>\n  </p>\n  <a href="x">\n    go there\n  </a>\n</div>'
    text = html.plain("just <b>text</b>")
    assert text.text() == "just <b>text</b>" and html.find_all(text, "*") == html.children(text, "*") == []
    assert [n.text() for n in html.find_all(html.parse(html.to_html("a,b\n<c>,d", "text/csv")), "td")] == ["a", "b", "<c>", "d"]
    assert html.to_html('{"a": 1}', "application/json").count("<pre>") == 1 and html.to_html("<p>", "text/html") == "<p>"
    with pytest.raises(ValueError):
        html.to_html("", "image/png")
    df = spark.createDataFrame([('{"@x": "v", "a": {"a": 1}, "@y": " "}',)], "j string")
    row = df.select(nodes.json_attribute(F.col("j"), "x"), nodes.json_attribute(F.col("j"), "y"), nodes.json_children(F.col("j"), "a"), nodes.lifted(F.lit(False), F.lit(1))).first()
    assert tuple(row) == ("v", None, ['{"a": 1}'], None)
    inner = df.select(html.sibling_texts(F.lit("<ul><li>a<li class=m>b<li>c</ul>"), "li.m", -1, 1, within="ul")).first()[0]
    assert inner == [["a", "b", "c"]]


def test_keyed_order_and_trajectories(spark):
    assert keyed.reduce_local([("a", 1), ("b", 2), ("a", 3)], max) == {"a": 3, "b": 2}
    left = spark.createDataFrame([(i, i % 3) for i in (5, 2, 9, 1)], "id int, k int").coalesce(1)
    assert [r.id for r in keyed.join_in_order(left, spark.createDataFrame([(0, "x"), (2, "y")], "k int, v string"), ["k"]).collect()] == [5, 2, 9, 1]
    rows = spark.range(50)
    one, two, other = ([r.id for r in sampling.shuffled_rows(rows, s).collect()] for s in (1, 1, 2))
    assert one == two != other and sorted(one) == list(range(50)) != one
    v = View(spark.createDataFrame([(2, "b", {"z": 1}), (1, "c", {}), (1, "a", {})], "a int, b string, m map<string,int>"))
    assert [r.b for r in v.sorted().df.collect()] == ["a", "c", "b"] and [r.b for r in v.sorted(False).df.collect()] == ["b", "c", "a"]
    e = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "b", 20), (1, 3, "a", 30)], "u int, at int, name string, v int")
    per = fetch.observations(e, ["u"], F.col("name"), F.col("v"), F.col("at"))
    got = per.select(fetch.only(fetch.by_name(F.col("trajectory"), "b"))["value"], fetch.head(fetch.visible(F.col("trajectory"), F.array(F.lit(2), F.lit(3))))["value"]).first()
    assert tuple(got) == (20, 20)
    with pytest.raises(Exception, match="several observations"):
        per.select(fetch.only(fetch.by_name(F.col("trajectory"), "a"))).collect()


def test_all_ways_of_a_lineage(spark):
    edges = spark.createDataFrame([("a", "c", 2), ("a", "c", 1), ("b", "c", 0)], "s string, t string, p int")
    step = explore.edges_step(edges, "node", "s", "t", "p")
    roots = spark.createDataFrame([("b",), ("a",)], "node string").coalesce(1)
    run = lambda **o: explore.explore(roots, step, "node", **o).filter("depth = 1").collect()
    assert [r.pos for r in run()] == [r.pos for r in run(all_ways=True)] == [0]
    only_a = roots.filter("node = 'a'")
    assert sorted(r.pos for r in explore.explore(only_a, step, "node", all_ways=True).filter("depth = 1").collect()) == [1, 2]
    twice = explore.explore(roots.unionAll(roots), step, "node").filter("depth = 0")
    assert twice.select("lineage").distinct().count() == 4


def test_files_of_all_kinds(spark, tmp_path):
    agent = web.urllib_agent(Conf())
    path = f"file://{tmp_path}/x/y.txt"
    assert agent(ac.post(path, "entity")) == [] and agent(ac.get(path))[0]["content"] == "entity"
    assert agent(ac.get(f"local:{tmp_path}/x/y.txt"))[0]["content"] == "entity"
    assert "PySpark" in agent(ac.get("resource:gleaner/__init__.py"))[0]["content"] or agent(ac.get("resource:gleaner/conf.py"))
    with pytest.raises(errors.ReadFailed):
        files.read_bytes(f"{tmp_path}/none")
    with pytest.raises(errors.ReadFailed):
        files.package_file("resource:gleaner/none")
    assert agent([*ac.random_delay(0, 0.01), *ac.mock("m", "n")]) == [{"content": "m", "mime": "text/plain", "status": 200, "uri": None, "name": "n"}]
    docs = spark.createDataFrame([("u", "doc", "c"), ("v", "error", None)], "uri string, kind string, content string")
    assert files.dump_errors(docs, str(tmp_path / "bad")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    (tmp_path / "blocked").write_text("")
    files.dump_errors(docs, str(tmp_path / "blocked" / "t"), str(tmp_path / "other"))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 1
    with pytest.raises(errors.DumpFailed):
        files.dump_errors(docs, str(tmp_path / "blocked" / "t"))
    for kind, cols in (("both", {"original", "normalised"}), ("original", {"original"}), ("normalised", {"normalised"})):
        files.audit(docs, str(tmp_path / kind), F.upper("content"), kind)
        assert set(spark.read.parquet(str(tmp_path / kind)).columns) - {"uri"} == cols
    files.audit(docs, str(tmp_path / "off"), kind="disabled")
    assert not (tmp_path / "off").exists()
    w = View(docs, Conf(auditing="original"))
    assert w.audited(str(tmp_path / "w")).without_errors(str(tmp_path / "we")).df.count() == 1 and set(spark.read.parquet(str(tmp_path / "w")).columns) == {"uri", "original"}
    assert View(docs, Conf(error_dump=False)).without_errors(str(tmp_path / "no")).df.count() == 1 and not (tmp_path / "no").exists()
    v = View(spark.range(3))
    assert not v.checkpointed and v.checkpoint().checkpointed and not v.is_cached and v.persist().is_cached and not v.unpersist().is_cached
    assert v.repartition(3).df.rdd.getNumPartitions() == 3 and v.coalesce(1).df.rdd.getNumPartitions() == 1
    v.execute()
    v.foreach_partition(lambda rows: None)


def test_a_session_over_pages():
    site = {
        "http://h/": "<title>home</title> <a href=/p1>one</a> <a href=/p2>two</a> <iframe src=/f></iframe><form action=/s><input name=q><select name=o><option value=1>x</select></form>",
        "http://h/p1": "<p>first</p> <a class=n href=/>back</a> <a class=n href=/p2>next</a>",
        "http://h/p2": "<p>second</p> <a class=n href=/p1>back</a>",
        "http://h/f": "<b>inside</b>",
        "http://h/s?o=1&q=hi": "<p>found</p>",
    }
    run, do = web.PageBrowser(site), ac.action
    visit, snap = do("visit", "http://h/"), do("snapshot", name="s")
    text = lambda *actions: [html.parse(d["content"]).text() for d in run([visit, *actions])]
    assert text(do("wait_for", entity="link:one"), do("click", entity="link:one"), snap) == ["first back next"]
    assert text(do("click", entity="link:one"), *ac.loop([snap, do("click_next", entity="a.n")])) == ["first back next", "second back"]
    form = [do("text_input", entity="name:q=hi"), do("select_option", entity="name:o=1"), do("submit", entity="form"), snap]
    assert text(*form) == ["found"] and text(do("to_frame", entity="iframe"), snap) == ["inside"]
    assert text(do("script", entity="scroll()"), do("drag", entity="x"), do("assert", entity="title"), do("screenshot")) == ["home one two x"]
    for bad in ([do("assert", entity="h1")], [do("click", entity="b")], [do("visit", "none")], [do("select_option", entity="name:o=7")], [do("click", entity="form")]):
        with pytest.raises(errors.ActionFailed, match="after: visit http://h/"):
            run([visit, *bad])
    with pytest.raises(errors.ActionFailed):
        run([snap])


def test_http(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def _answer(self, body):
            if self.path.startswith("/away"):
                self.send_response(307 if self.path == "/away-as-is" else 302)
                self.send_header("Location", "/a b")
                self.end_headers()
                return
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "text/plain; charset=latin-1")
            self.end_headers()
            self.wfile.write(f"{self.command} {self.path} {self.headers['X-Test']} \u00e9 ".encode("latin-1") + body)

        def do_GET(self):
            self._answer(b"")

        def do_POST(self):
            self._answer(self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    agent = web.urllib_agent(Conf(headers=(("X-Test", "yes"),)))
    try:
        got = agent(ac.get(f"{base}/x y"))[0]
        assert got["content"] == "GET /x%20y yes \u00e9 " and got["mime"] == "text/plain" and got["status"] == 200
        assert agent(ac.post(f"{base}/p", "body"))[0]["content"].startswith("POST /p yes") and agent(ac.post(f"{base}/p", "body"))[0]["content"].endswith("body")
        assert agent(ac.get(f"{base}/away"))[0]["content"].startswith("GET /a%20b") and agent(ac.post(f"{base}/away-as-is", "z"))[0]["content"].startswith("POST /a%20b")
        rows = spark.createDataFrame([(1, f"{base}/1"), (2, f"{base}/none")], "id int, u string")
        docs = {r.id: r for r in fetch.fetch(rows, F.array(ac.get_column(F.col("u"))), web.agent_fetcher(lambda: web.urllib_agent(Conf()))).collect()}
        assert docs[1].kind == "doc" and docs[1].content.startswith("GET /1") and docs[2].kind == "error" and "404" in docs[2].error
    finally:
        server.shutdown()
