"""Names, starts and messages against rules applied one by one."""

import random

from graphloom.operators import discovery as D


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_names_hold_by_who_comes_first(spark):
    one = "id string, name string, ord long"
    known = D.registry(
        table(spark, [("c:shop", "pack/shop", "Shop", 1), ("c:bank", "pack/bank", "Bank", 2), ("c:x", "bank", None, 3)], "id string, package string, name string, ord long"),
        table(spark, [("c:shop/cart", "c:shop", "Cart", 1), ("c:shop/ledger", "c:shop", "Ledger", 2), ("c:bank/ledger", "c:bank", "Ledger", 1), ("c:bank/shop", "c:bank", "Shop", 2), ("c:y/z", "c:y", "Lost", 1)], "id string, container string, name string, ord long"),
        table(spark, [("p:buyer", "Buyer", 1)], one), table(spark, [("x:mail", "Mail", 1), ("x:bank", " bank ", 2)], one), table(spark, [("j:buy", "Buyer", 1)], one),
    )
    asked = [(1, " SHOP ", None, "c:shop", 2), (2, "ledger", None, "c:shop/ledger", 2), (3, "Ledger", "Bank", "c:bank/ledger", 1), (4, "bank / LEDGER", None, "c:bank/ledger", 1), (5, "buyer", None, "p:buyer", 2), (6, "bank", None, "c:bank", 3),
             (7, "Cart", "Bank", "c:shop/cart", 1), (8, "nobody", "Shop", None, 0), (9, None, None, None, 0), (10, "lost", None, None, 0), (11, "J:BUY", None, "j:buy", 1)]
    got = D.named(table(spark, [a[:3] for a in asked], "query long, name string, within string"), known).collect()
    assert {(r.query, r.id, r.ids) for r in got} == {(a[0], *a[3:]) for a in asked}
    assert D.named(table(spark, [], "query long, name string, within string"), known).count() == 0


def test_starts_however_they_are_written(spark):
    files = ["web/app.ts", "web/api.ts", "api/main.py", "store/store.go", "shell/lib.rs"]
    nodes = [(f, "file", f, f, None, None, [], False) for f in files]
    symbol = lambda path, *tags: (path, "symbol", path.split("#")[1], path, "x", path.split("#")[0], list(tags), False)
    nodes += [symbol("web/app.ts#main"), symbol("web/api.ts#ask", "http-client", "route:/users/*"), symbol("api/main.py#user", "http-server", "route:/users/*"), symbol("api/main.py#health", "http-server", "route:/health"),
              symbol("shell/lib.rs#run"), symbol("shell/lib.rs#scan", "ipc-server", "ipc:scan"), symbol("web/app.ts#load", "ipc-client", "ipc:scan"), symbol("api/main.py#quiet")]
    edges = [("web/app.ts#main", "web/api.ts#ask", "calls", None), ("web/api.ts#ask", "api/main.py#user", "flow", "http /users/*"), ("shell/lib.rs#run", "web/app.ts#load", "calls", None), ("web/app.ts#load", "shell/lib.rs#scan", "flow", "ipc scan")]
    n = table(spark, nodes, "id string, kind string, name string, path string, lang string, parent string, tags array<string>, external boolean")
    e = table(spark, edges, "src string, dst string, kind string, label string").selectExpr("*", "1L AS weight")
    asked = [
        (1, "web/app.ts#main", "", "web/app.ts#main", "web/app.ts#main", "trace"), (2, " `web/app.ts` ", None, "web/app.ts#main", "web/app.ts#main", "file"),
        (3, "GET /users/{id}", "", "", None, "none"), (4, "GET /users/*", "", "web/api.ts#ask", "web/api.ts#ask", "endpoint"), (5, "scan", "", "web/app.ts#load", "web/app.ts#load", "endpoint"),
        (6, "http /health", "", "api/main.py#health", None, "endpoint"), (7, "store/store.go", "", "store/store.go", None, "file"), (8, "api/main.py#quiet", "", "api/main.py#quiet", None, "symbol"),
        (9, "Nightly cleanup", "", "", None, "none"), (10, "somewhere", "shell/lib.rs#run", "shell/lib.rs#run", "shell/lib.rs#run", "trace"), (11, None, None, "", None, "none"),
        (12, "web/api.ts#ask", "", "web/api.ts#ask", "web/api.ts#ask", "trace"), (13, "store/store.go#gone", "", "store/store.go", None, "file"),
    ]
    got = D.starts(table(spark, [a[:3] for a in asked], "query long, start string, hint string"), n, e).collect()
    assert {(r.query, r.entry, r.trace, r.how) for r in got} == {(a[0], *a[3:]) for a in asked}


def test_who_takes_part_in_a_contract_is_not_copied_to_each_query(spark):
    import os

    from graphloom.plans.durable import cut

    cut(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    n = spark.range(2000).selectExpr("id", "'file' AS kind", "concat('f', id) AS name", "concat('f', id) AS path", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS BIGINT) AS parent", "array('http-client', 'route:/a') AS tags", "false AS external")
    e = table(spark, [(5000, 5001, "flow", "http /b", 1)], "src long, dst long, kind string, label string, weight long")
    before = size()
    got = D.starts(spark.range(2000).selectExpr("id AS query", "'/a' AS start", "'' AS hint"), n, e)
    assert {(r.entry, r.trace, r.how) for r in got.collect()} == {("f0", None, "endpoint")}
    assert got.count() == 2000 and size() - before < 8e6


def merge_by_hand(answers, drafts):
    up = lambda x: x.rsplit("/", 1)[0] if "/" in x else x
    used, out = set(), []
    for j, o, s, d, k in sorted(answers):
        k = k if k in D.KINDS else "call"
        mine = [x for x in sorted(drafts) if x[0] == j and x[:2] not in used and (x[4] if x[4] in D.KINDS else "call") == k]
        hit = next((x for x in mine if x[2:4] == (s, d)), None) or next((x for x in mine if (up(x[2]), up(x[3])) == (up(s), up(d))), None)
        if hit:
            used.add(hit[:2])
        out.append((j, o, s, d, hit and hit[1]))
    return sorted(out, key=str)


def test_messages_take_drafts_in_order(spark):
    schema, r = "journey long, ord long, src string, dst string, kind string", random.Random(6)
    ends = ["a/x", "a/y", "b/x", "b", "c/d/e", "c/d/f"]
    make = lambda most: [(j, o, r.choice(ends[:3] if j < 5 else ends), r.choice(ends[:3] if j < 5 else ends), r.choice(["call", "flow", "odd"])) for j in range(12) for o in range(r.randrange(most))]
    answers, drafts = make(24), make(18)
    got = D.merged(table(spark, answers, schema), table(spark, drafts, schema)).collect()
    assert sorted(((x.journey, x.ord, x.src, x.dst, x.draft) for x in got), key=str) == merge_by_hand(answers, drafts)
    assert D.merged(table(spark, [], schema), table(spark, drafts, schema)).count() == 0
    assert {x.draft for x in D.merged(table(spark, answers, schema), table(spark, [], schema)).collect()} == {None}
