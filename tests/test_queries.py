"""Registered queries of the code graph against DuckDB on the smallest tables, and properties of the rules."""

import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.plans import catalog, durable
from graphloom.plans.routes import matched
from graphloom.sources.projection import graph

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    out = con.execute(ORACLES[name])
    cols = [d[0] for d in out.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(cols) == names
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in out.fetchall()), key=str)


def test_every_query_but_the_greedy_one_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"rank_traces_greedy"}


def test_routes(spark):
    cases = [("http://localhost:3000/api/users/42?x=1", "/api/users/*"), ("/api/users/:id", "/api/users/*"), ("/api/users/{id}/", "/api/users/*"), ("users", None), ("", None), ("https://x.org", "/"), ("/", "/"), (None, None), ("/a//b/", "/a//b")]
    got = spark.createDataFrame([(c, w) for c, w in cases], "a string, w string").select(T.normalize_route(F.col("a")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]
    pairs = [("/api/users/*", "/api/users/me", True), ("/api/*", "/api/users/me", True), ("/api/users", "/api/posts", False), ("/a", "/a/b", False), ("/*/b", "/a/b", True)]
    got = spark.createDataFrame(pairs, "a string, b string, w boolean").select(T.routes_match(F.col("a"), F.col("b")).alias("x"), T.routes_match(F.col("b"), F.col("a")).alias("y"), "w").collect()
    assert all(r.x == r.y == r.w for r in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "*"]), max_size=4), min_size=1, max_size=14))
def test_accelerated_route_join_equals_the_plain_one(spark, parts):
    df = spark.createDataFrame([("/" + "/".join(p),) for p in parts], "route string").select(T.normalize_route(F.col("route")).alias("route")).distinct()
    a, b = df.withColumnRenamed("route", "client"), df.withColumnRenamed("route", "server")
    want = {tuple(r) for r in a.crossJoin(b).filter(T.routes_match(F.col("client"), F.col("server"))).collect()}
    assert {tuple(r) for r in matched(df, df).collect()} == want


def test_route_join_does_not_compare_all_routes_of_a_first_part(spark):
    from threading import Timer

    df = spark.range(20_000).selectExpr("concat('/en/', id, '.html') AS route").unionByName(spark.createDataFrame([("/en/*",)], "route string"))
    late = Timer(60, spark.sparkContext.cancelAllJobs)  # 400 million pairs take far longer, a row a match a few seconds
    late.start()
    try:
        assert matched(df, df).count() == 60_001
    finally:
        late.cancel()


def test_evidence_is_cut_before_pairs_meet(spark):
    from graphloom.operators import atlas as A

    rows = [(1, 2, a, b, via) for a in range(5) for b in range(4) for via in ("x", None)] * 2 + [(1, 3, 7, 7, "x")]
    out = A.capped_evidence(spark.createDataFrame(rows, "src long, dst long, a long, b long, via string"), 3)
    assert {(r.dst, r.n_evidence, r.evidence) for r in out.collect()} == {(2, 3, "0>0;0>0>x;0>1"), (3, 1, "7>7>x")}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("HashAggregate") + plan.count("SortAggregate") <= 2  # no rows made distinct before


def test_packages_above_are_found_without_all_ancestors(spark):
    from graphloom.sources.projection import Graph

    rows = [(0, "repo", None), (1, "package", 0), (2, "package", 1), (3, "file", 2), (4, "symbol", 3), (5, "file", 0), (6, "file", 1), (7, None, 2)]
    out = catalog._ancestor_package(Graph(spark.createDataFrame(rows, "id long, kind string, parent long"), None))
    assert {tuple(r) for r in out.collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (6, 1), (7, 2)}
    assert "Aggregate" not in out._jdf.queryExecution().sparkPlan().toString()


def test_view_keeps_weight(spark):
    g = graph(spark, SF)
    up = G.lift(g, G.kept("package")).cache()
    e = g.edges.filter("kind <> 'contains'").join(up.select(F.col("node").alias("src"), F.col("target").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("target").alias("b")), "dst")
    want = e.filter("a <> b").agg(F.sum("weight")).first()[0]
    assert G.view(g, "package").agg(F.sum("weight")).first()[0] == want


def test_cycles_equal_brute_force(spark):
    import random

    r = random.Random(1)
    for n, m in ((6, 8), (14, 22), (20, 60)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        reach = {a: {b for x, b in edges if x == a} for a in range(n)}
        for _ in range(n):
            for a in reach:
                reach[a] |= {c for b in reach[a] for c in reach.get(b, ())}
        comps = {frozenset(b for b in range(n) if b == a or (b in reach[a] and a in reach[b])) for a in range(n)}
        want = sorted((min(c), len(c)) for c in comps if len(c) > 1)
        got = G.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
        assert sorted((x.component, x.size) for x in got) == want


def test_path_without_connection(spark):
    edges = spark.createDataFrame([(1, 2, "calls"), (3, 4, "calls"), (2, 5, "contains")], "src long, dst long, kind string")
    assert [r.id for r in G.path_between(edges, 2, 1).orderBy("pos").collect()] == [2, 1]
    assert G.path_between(edges, 1, 4).count() == 0 and G.path_between(edges, 1, 5).count() == 0
    assert [r.id for r in G.path_between(edges, 7, 7).collect()] == [7]


def test_stream_equals_table(spark, tmp_path):
    from graphloom.streaming import telemetry

    rows = [(f"s{i % 3}", float(i % 7), i) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, ms double, seq long")
    for k in range(3):
        df.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = telemetry.span_stats(telemetry.watch(spark, str(tmp_path / "in"), "name string, ms double, seq long"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("spans").collect())) == sorted(map(tuple, telemetry.span_stats(df).collect()))


def test_hotspots_read_the_graph_few_times(spark):
    plan = G.hotspots(graph(spark, SF), "file")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") < 30


@pytest.mark.parametrize("step", ["calls", "imports", "raised", "view_file"])
def test_rows_of_a_task_are_bounded_however_many_there_are(spark, monkeypatch, step):
    for module in (durable, G):
        monkeypatch.setattr(module, "TASK_ROWS", 300)
    g = graph(spark, SF)
    made = {"calls": lambda: g.edges.filter("kind = 'calls'"), "imports": lambda: g.edges.filter("kind = 'imports'"), "raised": lambda: G.raised(g, G.kept("file")), "view_file": lambda: G.view(g, "file")}[step]
    monkeypatch.setattr(durable, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        rows = made().groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows[0] > 2000 and rows[1] <= 3 * 300, rows
