import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.conf import Conf
from gleaner.operators import graph, keyed, records, sampling
from gleaner.plans import actions as ac
from gleaner.plans import cache, explore, fetch
from gleaner.sources import files, web
from gleaner.view import View


def pages(spark):
    return spark.createDataFrame([("a", "A"), ("b", "B")], "url string, html string")


def test_traces():
    a, b, c = ac.get("http://x/a b"), ac.get("y", "n"), ac.get("y", "m")
    assert a[0]["uri"] == "http://x/a%20b" and ac.trace_key_of(b) == ac.trace_key_of(c) != ac.trace_key_of(a)
    assert ac.product([a], [b, c]) == [[*a, *b], [*a, *c]] and ac.either([a, b], [b, c]) == [a, b, c]
    t = [ac.action("visit", "p"), *a, ac.action("click", "q"), ac.action("snapshot", name="s")]
    assert ac.dry_run(t) == [[t[1]], [t[0], t[2], t[3]]] and ac.state_changes(t) == [t[0], t[2]]
    assert "oauth_signature=" in ac.oauth_sign("http://h/p?z=1", "k", "s", now=1)
    tries = []
    with pytest.raises(ZeroDivisionError):
        ac.retried(lambda: tries.append(1) or 1 / 0, 3)
    assert len(tries) == 3 and ac.looped(lambda i: 1 / (2 - i)) == [0.5, 1.0]


@pytest.mark.parametrize("locality,most", [("wide", 2), ("narrow", 6), ("passthrough", 20), ("cache_aware", 2)])
def test_how_often_a_trace_is_fetched(spark, locality, most):
    seen = spark.sparkContext.accumulator(0)

    def agent(trace):
        seen.add(1)
        return [{"uri": trace[0]["uri"], "content": trace[0]["uri"].upper(), "mime": "text/plain", "status": 200, "name": None}]

    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, u string").repartition(3)
    got = View(rows).fetch(F.array(ac.get_column(F.col("u")), ac.get_column(F.col("u"))), web.agent_fetcher(lambda: agent), locality=locality).df
    assert {(r.id, r.content) for r in got.collect()} == {(i, "AB"[i % 2]) for i in range(20)}
    assert seen.value == most if locality != "narrow" else 2 <= seen.value <= most
    if locality in ("narrow", "passthrough"):
        view = View(spark.range(4).select("id", F.col("id").cast("string").alias("u"))).fetch(F.array(ac.get_column(F.col("u"))), web.agent_fetcher(lambda: agent), locality=locality)
        assert "Exchange" not in view.df._jdf.queryExecution().executedPlan().toString()


def test_the_first_trace_of_a_key_runs(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "z"), (2, "a")], "id int, u string").coalesce(1)
    run = lambda **o: {r.uri for r in fetch.fetch(rows, F.array(ac.get_column(F.col("u"))), fetch.table_fetcher(pages(spark)), key_by=F.lit("k"), **o).collect()}
    assert run() == {"b"} and run(order=F.col("id")) == {"z"}


def test_cache_in_the_way_of_a_fetch(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def agent(trace):
        seen.add(1)
        if trace[0]["uri"] == "bad":
            raise OSError("down")
        return [{"uri": trace[0]["uri"], "content": trace[0]["uri"].upper(), "mime": "text/plain", "status": 200}]

    rows = spark.createDataFrame([(i, ["a", "b", "bad"][i % 3]) for i in range(12)] + [(12, None)], "id int, u string")
    traces, path = F.when(F.col("u").isNotNull(), F.array(ac.get_column(F.col("u")))), str(tmp_path / "cache")
    run = lambda **o: {r.id: (r.kind, r.content) for r in View(rows, Conf(remote_retries=1, **o)).fetch(traces, web.agent_fetcher(lambda: agent, Conf(remote_retries=1)), cache_path=path, how="outer").df.collect()}
    first = run()
    assert seen.value == 3 and first[0] == ("doc", "A") and first[2][0] == "error" and first[12] == ("nodoc", None)
    assert run() == first and seen.value == 4  # only the failure is tried again
    assert run(remote=False)[1] == ("doc", "B") and run(remote=False)[2][0] == "error" and seen.value == 4
    assert run(cache_read=False)[0] == ("doc", "A") and seen.value == 7
    assert run(ignore_cached_before="2999-01-01")[0] == ("doc", "A") and seen.value == 10


def test_loops_retries_and_timeouts(spark):
    left = [3]

    def one(a):
        if a["op"] == "click":
            left[0] -= 1
            if left[0] < 0:
                raise KeyError("no next")
        return {"content": str(left[0])} if a["op"] == "snapshot" else None

    snap = [ac.action("snapshot", name="s")]
    assert [d["content"] for d in web.run_trace(ac.then(snap, ac.loop([ac.action("click"), *snap])), one)] == ["3", "2", "1", "0"]
    fails = [2]

    def shaky(a):
        fails[0] -= 1
        if fails[0] >= 0:
            raise OSError
        return {"content": "x"}

    assert len(web.run_trace(ac.local_retry(snap), shaky)) == 1
    assert ac.state_changes(ac.loop([ac.action("click"), *snap])) == [ac.action("click")] and len(ac.dry_run(ac.loop(snap))) == 1
    conf = Conf(remote_timeout=0.2, hard_timeout_extra=0.1, remote_retries=1)

    def hang(trace):
        import time

        time.sleep(3)

    keys = fetch.keyed(spark.range(1), F.array(ac.get_column(F.lit("u")))).drop("_place")
    r = web.agent_fetcher(lambda: hang, conf)(keys).first()
    assert r.kind == "error" and "Timeout" in r.error


def test_few_keys_move_and_sort_no_rows(spark, sf_dir):
    from gleaner import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["fetch_key_by"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [_trace_key" in plan and "SortMergeJoin [_trace_key" not in plan
    on_rows = [x for x in plan.splitlines() if "Aggregate(key" in x and "min_by" not in x and "min(uri" not in x]
    assert on_rows and not [x for x in on_rows if "SortAggregate" in x]


def test_first_trace_of_many_keys(spark):
    """Above FEW_KEYS nothing is broadcast; among the traces of a row, its first counts; a row without a place comes before all."""
    rows = spark.range(0, 3000, 1, 5).select("id", (F.col("id") % 500).alias("k"), F.when(F.col("id") % 500 == 7, F.lit(None)).otherwise(-F.col("id")).alias("at"))
    traces = F.array(ac.get_column(F.concat(F.lit("z"), "id")), ac.get_column(F.concat(F.lit("a"), "id")))
    agent = lambda trace: [{"uri": trace[0]["uri"], "content": "x"}]
    run = lambda rows: {r.k: (r.first, r.n) for r in fetch.fetch(rows, traces, web.agent_fetcher(lambda: agent), key_by=F.col("k"), order=F.col("at")).groupBy("k").agg(F.count("*").alias("n"), F.min("uri").alias("first"), F.max("uri").alias("last")).filter("first = last").collect()}
    want = {k: (f"z{2500 + k}", 12) for k in range(500) if k != 7}
    got = run(rows.filter("k <> 7"))
    assert got == want and run(rows.filter("k < 5")) == {k: want[k] for k in range(5)}
    assert run(rows.filter("k = 7").unionByName(spark.sql("SELECT 3L id, 7L k, 1L at")))[7][0] != "z3"


def test_sessions_keep_their_threads(spark):
    import threading

    def agent(trace):
        return [{"uri": trace[0]["uri"], "content": threading.current_thread().name}]

    rows = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("u"))
    got = fetch.fetch(rows, F.array(ac.get_column(F.col("u"))), web.agent_fetcher(lambda: agent, sessions=4), locality="passthrough").collect()
    assert len(got) == 400 and all(r.u == r.uri for r in got) and len({r.content for r in got}) <= 4


def test_a_hanging_session_is_left_behind():
    import threading

    tries, free = [], threading.Event()

    def run(trace):
        tries.append(trace)
        if trace == "hang":
            free.wait(20)
        if trace == "shaky" and tries.count("shaky") < 2:
            raise OSError("once")
        if trace == "bad":
            raise KeyError("x")
        return [trace]

    pool = web.Sessions(run, 1, 0.3, 2)
    got = pool.map(["a", "hang", "shaky", "bad", "z"])
    assert got[0] == ["a"] and got[2] == ["shaky"] and got[4] == ["z"] and isinstance(got[1], TimeoutError) and isinstance(got[3], KeyError)
    assert [tries.count(x) for x in ("a", "hang", "shaky", "bad", "z")] == [1, 2, 2, 2, 1]
    assert pool.map(["b"] * 5) == [["b"]] * 5 and pool.map([]) == []
    free.set()
    pool.close()
    assert isinstance(web.Sessions(run, 1, 1, 0).map(["a"])[0], ValueError)


def test_errors_are_rows_and_outer_keeps(spark):
    rows = spark.createDataFrame([(1, ["a", "z"]), (2, [])], "id int, us array<string>")
    traces = F.transform("us", lambda u: ac.get_column(u))
    table = fetch.table_fetcher(pages(spark))
    got = {(r.id, r.uri, r.kind) for r in fetch.fetch(rows, traces, table).collect()}
    assert got == {(1, "a", "doc"), (1, "z", "error")}
    assert (2, None, "nodoc") in {(r.id, r.uri, r.kind) for r in fetch.fetch(rows, traces, table, how="outer").collect()}
    with pytest.raises(ValueError):
        fetch.fetch(rows, traces, table, remote=False)
    browser = web.agent_fetcher(lambda: web.MockBrowser({"a": "A"}))
    keys = fetch.keyed(spark.range(1), F.array(F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in x.items()]) for x in [ac.action("visit", "a"), ac.action("snapshot", name="s")]])))
    r = browser(keys).first()
    assert (r.kind, r.content, r.name) == ("doc", "A", "s")


def test_explore_ranges_and_pruning(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1)], "s string, t string, p int")
    step = explore.edges_step(edges, "node", "s", "t", "p")
    roots = spark.createDataFrame([("a",)], "node string")
    run = lambda **o: sorted((r.node, r.depth) for r in explore.explore(roots, step, "node", **o).collect())
    full = [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert run() == full == run(checkpoint_interval=1)
    assert run(max_depth=2) == full[:3] and run(min_depth=2) == full[3:] and run(min_depth=2, max_depth=2) == []
    two = spark.createDataFrame([("a",), ("d",)], "node string")
    assert explore.explore(two, step, "node", per_root=True).count() == 10 and explore.explore(two, step, "node").count() == 5
    costs = {r.node: r.cost for r in explore.cheapest_paths(edges.withColumn("w", F.col("p") + 1.0), "s", "t", "w", "a").collect()}
    assert costs == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 4}


def test_cache_bounds(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    v = spark.createDataFrame([("k", day(1), 1), ("k", day(3), 3), ("k", day(5), 5)], "key string, ts timestamp_ntz, n int")
    at = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    pick = lambda e, l: [r.n for r in cache.as_of(v, "key", "ts", e, l).collect()]
    assert pick(None, at(5)) == [3] and pick(at(3), at(4)) == [3] and pick(at(4), at(5)) == [] and pick(None, None) == [5]
    docs = spark.createDataFrame([("x", "doc"), ("x", "error"), ("y", "doc")], "_trace_key string, kind string")
    assert [r._trace_key for r in cache.storable(docs).collect()] == ["y"]
    with pytest.raises(Exception, match="wayback"):
        spark.range(1).select(cache.check_wayback(at(1), at(2))).collect()


def test_records(spark):
    xy, yz = spark.createDataFrame([(1, "ab")], "x int, y string"), spark.createDataFrame([(1.0, 1.1)], "y double, z double")
    assert records.cartesian(xy, yz).first().asDict() == {"x": 1, "y": 1.0, "z": 1.1}
    assert records.cartesian(xy, yz, "left").first().asDict() == {"x": 1, "y": "ab", "z": 1.1}
    with pytest.raises(records.Conflict):
        records.cartesian(xy, yz, "error")
    with pytest.raises(records.Conflict):
        View(xy).with_columns(x=F.lit(1))
    assert records.cartesian(xy, spark.range(5), most_right=2).count() == 5
    assert records.append_to_array(xy, "x", F.lit(2)).first().x == [1, 2]
    assert records.replace_if_not_null(xy, "y", F.lit(None)).first().y == "ab"
    assert records.runtime_map(xy).first().fields == {"x": "1", "y": "ab"}
    assert records.lift(spark.range(1)).columns == ["value"]


def test_keyed_and_sampling(spark):
    one, two = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), spark.createDataFrame([(2, 3), (3, 4)], "k int, v int")
    assert {tuple(r) for r in keyed.intersect_by_key(one, two, "k", s=F.sum("v")).collect()} == {(2, 5)}
    assert {tuple(r) for r in keyed.union_by_key(one, two, "k", s=F.sum("v")).collect()} == {(1, 1), (2, 5), (3, 4)}
    assert keyed.join_checked(one, two, ["k"], most_rows=1).count() == keyed.join_checked(one, two.withColumnRenamed("v", "w"), ["k"]).count() == 1
    arr = F.array(*map(F.lit, range(10)))
    got = [spark.range(1).select(sampling.to_size(arr, 4, s), sampling.by_ratio(arr, 0.55, s), sampling.any_one(arr, s)).first() for s in (1, 1, 2)]
    assert got[0] == got[1] != got[2] and len(got[0][0]) == 4 and len(set(got[0][1])) == 5 and got[0][2] in range(10)
    df, told = keyed.observed(one, "m", n=F.count("*"))
    df.collect()
    assert told() == {"n": 2}
    g = graph.Graph(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2)], "src int, dst int"))
    h = graph.Graph(spark.createDataFrame([(3,)], "id int"), spark.createDataFrame([], "src int, dst int"))
    assert {tuple(r) for r in g.then(h).edges.collect()} == {(1, 2), (2, 3)}
    assert g.connect(spark.createDataFrame([(2, 9)], "src int, dst int")).dangling().count() == 1


def test_files_and_view(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{"a": 1}')
    (tmp_path / "y.html").write_text("<html>")
    assert {(r.uri.rsplit("/", 1)[1], r.mime) for r in files.files(spark, str(tmp_path), True).collect()} == {("x.json", "application/json"), ("y.html", "text/html")}
    assert sorted(len(r.entries) for r in files.listing(spark, str(tmp_path)).collect()) == [1, 1]
    docs = spark.createDataFrame([("n/1", "text")], "name string, content string")
    saved = files.with_saved_path(docs, str(tmp_path / "out"), F.col("name"))
    files.save_contents(saved)
    assert open(saved.first().saved).read() == "text"
    files.save(docs, str(tmp_path / "t"))
    with pytest.raises(Exception):
        files.save(docs, str(tmp_path / "t"))
    files.save(docs, str(tmp_path / "t"), "read_only")
    v = View.create(spark, [(1, [1, 2, 3])], "id int, a array<int>", slices=2, conf=Conf().preview())
    assert v.sample(F.col("a")).df.count() == 1 and v.fork(F.col("a"), "x", "i").df.count() == 3
    assert View.blank(spark).df.count() == 1 and v.to_json().first().value == '{"id":1,"a":[1,2,3]}'
    assert v.checkpoint().df.count() == 1 and len(list(v.local())) == 1
    assert Conf.load(spark, locality="narrow").locality == "narrow"
