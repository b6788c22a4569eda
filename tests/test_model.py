"""The C4 model of a bakery written out as tables: what the code says, what others say of it, and drawings."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lookup as L
from graphloom.operators import model as M

NODES = "id string, kind string, name string, path string, lang string, parent string, loc long, tags array<string>, external boolean"
EDGES = "src string, dst string, kind string, label string, weight long"


def bakery():
    rows = [("repo", "repo", "bakery", "", None, None, 0, [], False)]
    rows += [(f"package:{d}", "package", d, d, None, "repo", 0, [], False) for d in ("till", "oven", "docs")]
    rows += [(f"external:{n}:{lang}", "package", n, f"external:{n}", lang, "repo", 0, [], True) for n, lang in (("react", "typescript"), ("@desk/tauri", "typescript"), ("os", "python"), ("flask", "python"), ("dough", "python"))]
    files = [("till/src/app.ts", []), ("till/src/money.ts", ["http-client", "route:/flour"]), ("oven/main.py", ["env:OVEN_DB_URL"]), ("oven/dough.py", ["fs"])]
    files += [(f"oven/lib/{d}/{n}.py", ["db"] if n == "a" else []) for d in ("heat-up", "heat_up", "rest") for n in ("a", "b")]
    rows += [(p, "file", p.rsplit("/", 1)[1], p, "typescript" if p.endswith(".ts") else "python", "package:" + p.split("/")[0], 10, t, False) for p, t in files]
    symbols = [("till/src/app.ts#onPay", []), ("till/src/money.ts#send", ["http-client", "route:/bake"]), ("oven/main.py#bake", ["http-server", "route:/bake"]), ("oven/lib/rest/a.py#store", ["db"])]
    rows += [(s, "symbol", s.split("#")[1], s, None, s.split("#")[0], 3, t, False) for s, t in symbols]
    edges = [("till/src/app.ts", "till/src/money.ts", "imports", None, 1), ("till/src/app.ts#onPay", "till/src/money.ts#send", "calls", "send", 2), ("till/src/money.ts#send", "oven/main.py#bake", "flow", "http /bake", 1)]
    edges += [("oven/main.py#bake", "oven/lib/rest/a.py#store", "calls", "store", 1), ("till/src/app.ts", "external:react:typescript", "imports", None, 5), ("till/src/app.ts", "external:@desk/tauri:typescript", "imports", None, 1)]
    edges += [("oven/main.py", f"external:{n}:python", "imports", None, w) for n, w in (("os", 9), ("flask", 2), ("dough", 3))]
    return rows, edges


@pytest.fixture(scope="module")
def tables(spark):
    rows, edges = bakery()
    return spark.createDataFrame(rows, NODES).coalesce(1).cache(), spark.createDataFrame(edges, EDGES).coalesce(1).cache()


@pytest.fixture(scope="module")
def found(tables):
    return M.model(*tables)


@pytest.fixture(scope="module")
def known(tables):
    return M.facts(*tables)


def test_containers(found):
    got = {r.package: r for r in found.containers.collect()}
    assert {p: (r.kind, r.language, r.technology, r.hidden, r.files, r.loc) for p, r in got.items()} == {
        "till": ("web", "typescript", "TypeScript, React, Tauri", False, 2, 20), "oven": ("service", "python", "Python, Flask", False, 8, 80), "docs": ("tooling", "", "", True, 0, 0),
    }
    assert got["oven"].description == "8 files of Python in `oven`; serves HTTP routes, reads a database, touches the file system."
    assert got["docs"].description == "The `docs` package has no source files of its own."


def test_components(found):
    got = {r.path: r.component for r in found.placed.collect()}
    assert got["till/src/app.ts"] == "c:till/app" and got["till/src/money.ts"] == "c:till/money" and got["oven/main.py"] == got["oven/dough.py"] == "c:oven/core"
    assert {got["oven/lib/heat-up/a.py"], got["oven/lib/heat_up/a.py"]} == {"c:oven/heat-up", "c:oven/heat-up-2"} and got["oven/lib/rest/b.py"] == "c:oven/rest"
    told = {r.id: (r.name, r.technology, r.description) for r in found.components.collect()}
    assert told["c:oven/rest"] == ("Rest", "Python", "2 files, 1 part: store") and told["c:till/app"] == ("App", "TypeScript", "1 file, 1 part: onPay")


def test_relationships(found):
    got = {(r.src, r.dst): (r.level, r.label, r.technology, r.source, len(r.evidence)) for r in found.relationships.collect()}
    db = "x:database-oven-db-url"
    assert got == {
        ("c:till/app", "c:till/money"): ("component", "imports and calls", "", "code", 2), ("c:till/money", "c:oven/core"): ("component", "http /bake", "", "code", 1), ("c:till", "c:oven"): ("container", "http /bake", "HTTP", "code", 1),
        ("c:oven/core", "c:oven/rest"): ("component", "calls", "", "code", 1), ("c:oven", db): ("container", "reads and writes", "SQL", "code", 3), ("c:oven/heat-up", db): ("component", "reads and writes", "SQL", "code", 1),
        ("c:oven/heat-up-2", db): ("component", "reads and writes", "SQL", "code", 1), ("c:oven/rest", db): ("component", "reads and writes", "SQL", "code", 1), ("c:oven", "x:file-system"): ("container", "reads and writes files on", "", "code", 1),
        ("c:oven/core", "x:file-system"): ("component", "reads and writes files on", "", "code", 1), ("c:till", "x:outside-http-api"): ("container", "calls /flour", "HTTP", "code", 1),
        ("c:till/money", "x:outside-http-api"): ("component", "calls /flour", "HTTP", "code", 1), ("p:user", "c:till"): ("container", "uses", "", "survey", 0),
    }
    assert {(r.name, r.kind) for r in found.externals.collect()} == {("Database (OVEN_DB_URL)", "database"), ("File system", "filesystem"), ("Outside HTTP API", "service")}
    assert tuple(M.report(found).first()) == (12, 1, 0, 0)


def test_what_others_say(spark, tables):
    claims = spark.createDataFrame([("c:till", "c:oven", " orders ", ""), ("c:oven", "c:till", "thanks", "paper"), ("c:oven/rest", "x:mill", "buys", ""), ("c:gone", "c:oven", "x", "")], "src string, dst string, label string, technology string")
    people = spark.createDataFrame([("p:baker", "Baker"), ("p:cat", "Cat")], "id string, name string")
    declared = spark.createDataFrame([("x:mill", "Mill", "service", "Flour.", 0), ("x:store", "Ledger", "database", "Books.", 1)], "id string, name string, kind string, description string, ord int")
    claims = claims.unionByName(spark.createDataFrame([("p:baker", "c:oven", "heats", "")], claims.schema))
    m = M.model(*tables, people=people, declared=declared, claims=claims)
    got = {(r.src, r.dst): (r.label, r.technology, r.source, r.level) for r in m.relationships.collect()}
    assert got["c:till", "c:oven"] == ("orders", "HTTP", "code", "container") and got["c:oven", "c:till"] == ("thanks", "paper", "claimed", "container")
    assert got["c:oven/rest", "x:mill"] == ("buys", "", "survey", "component") and got["p:baker", "c:oven"][2] == "survey" and got["p:cat", "c:till"][0] == "uses"
    assert ("p:baker", "c:till") not in got and ("c:oven", "x:store") in got and [tuple(r) for r in m.dropped.collect()] == [("c:gone", "c:oven")]


def test_checks_of_proposals(spark, known):
    boxes = spark.createDataFrame([("oven", "Big oven", "worker", "Hot.", 0), ("oven", "Again", "cli", "", 1), ("moon", "Moon", "cli", "", 2)], "package string, name string, kind string, description string, ord int")
    shown, notes = M.checked_containers(known, boxes)
    got = {r.package: (r.name, r.kind, r.description, r.hidden) for r in shown.collect()}
    assert got == {"oven": ("Big oven", "worker", "Hot.", False), "till": ("Till", "web", "2 files the agents did not describe.", False), "docs": ("Docs", "tooling", "0 files the agents did not describe.", True)}
    assert sorted(r.about for r in notes.collect()) == ["Again", "Moon", "till"]
    parts = [("oven", "Door", 0, "oven/main.py"), ("oven", "Door", 1, "oven/main.py"), ("oven", "Door", 1, "oven/dough.py"), ("oven", "Void", 2, "till/src/app.ts")]
    placed, unplaced, notes = M.checked_placement(known, spark.createDataFrame(parts, "package string, name string, ord int, path string"))
    got = {r.path: r.component for r in placed.collect()}
    assert got["oven/main.py"] == "c:oven/door" and got["oven/dough.py"] == "c:oven/door-2" and got["oven/lib/rest/a.py"] == "c:oven/other-files" and got["till/src/app.ts"] == "c:till/app" and len(got) == 10
    assert unplaced.count() == 6 and {r.what for r in notes.collect()} == {"`Door`: dropped 1 file(s) that are not in `oven` or were placed twice.", "`Void`: dropped 1 file(s) that are not in `oven` or were placed twice."}


def test_messages_and_drawings(spark, found, tables):
    steps = [("till/src/app.ts#onPay", 0, None, "till/src/app.ts#onPay", None, False), ("till/src/app.ts#onPay", 1, 0, "till/src/money.ts#send", "send", False), ("till/src/app.ts#onPay", 2, 1, "oven/main.py#bake", "http /bake", True), ("till/src/app.ts#onPay", 3, 2, "oven/lib/rest/a.py#store", "store", False)]
    msgs = M.trace_messages(spark.createDataFrame(steps, "entry string, step long, parent long, node string, via string, flow boolean"), tables[0], found)
    got = [(r.src, r.dst, r.kind, r.label) for r in msgs.orderBy("ord").collect()]
    walk = [("p:user", "c:till/app", "call", "uses"), ("c:till/app", "c:till/money", "call", "calls send"), ("c:till/money", "c:oven/core", "flow", "http /bake"), ("c:oven/core", "c:oven/rest", "call", "calls store")]
    assert got == [*walk, ("c:oven/rest", "x:database-oven-db-url", "store", "reads and writes")]
    more = [("j", 1, "c:oven/old", "c:till/money", "jump", "", "oven/main.py#bake", "", "x"), ("j", 2, "c:till/money", "c:oven/core", "return", "me", "", "", "y"), ("j", 3, "c:gone", "c:oven/core", "call", "me", "", "", "z"), ("j", 4, "c:oven/rest", "c:till/app", "call", "me", "", "", "w"), ("j", 5, "c:till", "c:oven/core", "call", "", "", "", "v")]
    ids = M.elements(found.containers, found.placed, found.people, found.externals)
    checked = M.checked_messages(spark.createDataFrame(more, "journey string, ord long, src string, dst string, kind string, by string, from_path string, to_path string, label string"), ids, found.placed, found.relationships)
    got = [(r.ord, r.src, r.kind, r.by, r.source) for r in checked.orderBy("ord").collect()]
    assert got == [(1, "c:oven/core", "call", "engine", "claimed"), (2, "c:till/money", "return", "me", "code"), (4, "c:oven/rest", "call", "me", "claimed"), (5, "c:till", "call", "engine", "code")]

    said = [("j", k, *x) for k, x in enumerate([("p:user", "c:till/app", "call", "a"), ("c:till/app", "c:till/money", "call", "b"), ("c:till/money", "c:oven/core", "flow", "c"), ("c:till/app", "c:oven/rest", "flow", "d"), ("c:till/app", "c:oven/rest", "flow", "d"), ("c:oven/rest", "c:till/app", "return", "e"), ("c:oven/rest", "c:docs/x", "call", "f")])]
    said = spark.createDataFrame(said, "journey string, ord long, src string, dst string, kind string, label string")
    drawn = M.projected(said, found.containers, "containers")
    assert [(r.n, r.src, r.dst, r.label) for r in drawn.orderBy("n").collect()] == [(1, "p:user", "c:till", "a"), (3, "c:till", "c:oven", "c, d"), (6, "c:oven", "c:till", "e")]
    assert [(r.n, r.src, r.dst, r.label) for r in M.projected(said, found.containers, "components", "c:oven").orderBy("n").collect()] == [(1, "p:user", "c:till", "a"), (3, "c:till", "c:oven/core", "c"), (4, "c:till", "c:oven/rest", "d"), (6, "c:oven/rest", "c:till", "e")]
    assert [(r.src, r.dst, r.label) for r in M.projected(said, found.containers, "context").collect()] == [("p:user", "s", "a")]
    arrows = spark.createDataFrame([("p:user", "c:till"), ("c:till", "c:oven")], "src string, dst string")
    assert {(r.src, tuple(r.numbers)) for r in M.on_diagram(drawn, arrows).collect()} == {("p:user", (1,)), ("c:till", (3, 6))}


def test_brief(known):
    got = {(r.package, r.section, r.n): r.line for r in M.brief(known).collect()}
    assert got["oven", "files", 2] == "oven/lib/heat-up/a.py (10 lines); touches: db" and got["till", "out", 1] == got["oven", "in", 1] == "till/src/money.ts flow oven/main.py (http /bake)"
    assert got["till", "files", 1] == "till/src/app.ts (10 lines); parts: onPay" and got["oven", "inside", 1] == "oven/main.py calls oven/lib/rest/a.py (store)"


def test_names_dodge_made_names(spark):
    rows = [("p", "Foo", 1), ("p", "Foo 2", 2), ("p", "Foo", 3), ("p", "Foo", 4), ("q", "Foo", 1), ("p", "Bar", 5), ("p", "Foo 2", 6)]
    got = L.dodge(spark.createDataFrame(rows, "s string, n string, o int"), "s", "n", "o").orderBy("s", "o")
    assert [r.unique_name for r in got.collect()] == ["Foo", "Foo 2", "Foo 3", "Foo 4", "Bar", "Foo 2 2", "Foo"]


def test_first_k_of_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    assert sorted(r.v for r in M.first_k(df, ["k"], ["v"], 7).collect()) == list(range(7))


def test_facts_are_made_when_asked_for(spark):
    nodes = spark.createDataFrame([(1, "package", "p", "p", None, None, 0, [], False), (2, "file", "a", "p/a.py", "python", 1, 3, [], False)], "id long, kind string, name string, path string, lang string, parent long, loc long, tags array<string>, external boolean")
    f = M.facts(nodes, spark.createDataFrame([(1, 2, "contains", None, 1)], "src long, dst long, kind string, label string, weight long"))
    assert [r.path for r in M.placement(f).collect()] == ["p/a.py"]
    assert not {"edges", "deps", "tags"} & set(vars(f)) and f.files is f.files
