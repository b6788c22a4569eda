"""Traces against a depth-first walk by hand, on small random graphs."""

import random

import pytest

from graphloom.operators import traces as R

SINKS = ("db", "fs", "queue", "process")


def walk_by_hand(nodes, edges, starts=None, depth=24, most=300):
    """nodes: id -> (kind, name, path, lang, parent, tags); edges: (src, dst, kind, label)."""
    hops = {e for e in edges if e[2] in ("calls", "flow") and not (e[2] == "calls" and nodes[e[1]][0] == "symbol" and nodes[e[1]][4] == e[0])}
    out = {}
    for s, d, k, label in sorted(hops, key=lambda e: (e[3] is not None, e[3] or "", e[1], e[2])):
        out.setdefault(s, []).append((d, k, label))

    def sinks(i):
        tags = nodes[i][5]
        found = [t for t in tags if t in SINKS]
        if {"http-client", "ipc-client"} & set(tags) and not any(k == "flow" for _, k, _ in out.get(i, [])):
            found += [f"unmatched {t}" for t in tags if t.startswith(("route:", "ipc:"))]
        return found

    alive = {i for i in nodes if sinks(i) or any(k == "flow" for _, k, _ in out.get(i, []))}
    while True:
        more = {s for s in out if s not in alive and any(k == "calls" and d in alive for d, k, _ in out[s])}
        if not more:
            break
        alive |= more

    def lane(i):
        while i is not None and nodes[i][0] != "package":
            i = nodes[i][4]
        return "" if i is None else nodes[i][1]

    into = {d for _, d, _, _ in hops}
    result = {}
    for entry in starts if starts is not None else [i for i in out if i not in into and i in alive]:
        steps, expanded, off = [], set(), False
        stack = [(entry, None, 0, False, None, ())]
        while stack:
            if len(steps) >= most:
                off = True
                break
            node, parent, deep, flow, label, path = stack.pop()
            repeat = node in expanded and node in out
            expanded.add(node)
            steps.append((entry, len(steps), parent, node, label, flow, deep, repeat, *nodes[node][1:4], lane(node), sinks(node)))
            if repeat:
                continue
            if deep >= depth:
                off |= node in out
                continue
            here = len(steps) - 1
            stack += [(d, here, deep + 1, k == "flow", x, (*path, node)) for d, k, x in reversed(out.get(node, [])) if d not in (*path, node) and (k == "flow" or d in alive)]
        if starts is not None or any(s[5] for s in steps):
            result[entry] = [(*s[:8], off, *s[8:]) for s in steps]
    return result


def tables(spark, nodes, edges):
    n = [(i, k, name, path, lang, parent, list(tags), False) for i, (k, name, path, lang, parent, tags) in nodes.items()]
    return spark.createDataFrame(n, "id long, kind string, name string, path string, lang string, parent long, tags array<string>, external boolean"), spark.createDataFrame(list(edges), "src long, dst long, kind string, label string").selectExpr("*", "1L AS weight")


def run(spark, nodes, edges, starts=None):
    n, e = tables(spark, nodes, edges)
    s = None if starts is None else spark.createDataFrame([(i,) for i in starts], "id long")
    steps = R.traces(n, e, s, whole=starts is not None)
    got = {}
    for r in sorted(steps.collect(), key=lambda r: (r.entry, r.step)):
        got.setdefault(r.entry, []).append((r.entry, r.step, r.parent, r.node, r.via, r.flow, r.depth, r.repeat, r.truncated, r.name, r.path, r.lang, r.lane, list(r.sinks)))
    return got, steps, n


def world(r, symbols, links, flows):
    nodes = {0: ("repo", "repo", "", None, None, ())}
    nodes |= {i: ("package", f"p{i}", f"p{i}", None, 0, ()) for i in (1, 2)}
    nodes |= {i: ("file", f"f{i}", f"f{i}", r.choice(["go", "rust"]), r.choice([1, 2, 0]), ()) for i in (3, 4, 5)}
    tags = [(), (), (), ("db",), ("http-client", "route:/x"), ("ipc-client", "ipc:y", "fs"), ("queue",)]
    nodes |= {i: ("symbol", f"s{i}", f"f#s{i}", r.choice(["go", "rust", "python"]), r.choice([3, 4, 5]), r.choice(tags)) for i in range(6, 6 + symbols)}
    pick = lambda: r.randrange(3, 6 + symbols)
    edges = {(pick(), pick(), "calls", r.choice([None, "a", "b"])) for _ in range(links)}
    return nodes, edges | {(pick(), pick(), "flow", r.choice(["http /x", "queue q", None])) for _ in range(flows)}


@pytest.mark.parametrize("seed,symbols,links,flows", [(1, 8, 10, 2), (2, 24, 26, 4), (3, 30, 34, 8)])
def test_equals_a_walk_by_hand(spark, seed, symbols, links, flows):
    nodes, edges = world(random.Random(seed), symbols, links, flows)
    got, _, _ = run(spark, nodes, edges)
    assert got == walk_by_hand(nodes, edges) and got
    some = [6, 7, 8, 9]
    assert run(spark, nodes, edges, some)[0] == walk_by_hand(nodes, edges, some)


def test_budget_depth_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(R, "DEPTH", 5)
    monkeypatch.setattr(R, "STEPS", 12)
    seen = set()
    for seed in range(3):
        nodes, edges = world(random.Random(50 + seed), 16, 36, 4)
        got, _, _ = run(spark, nodes, edges)
        assert got == walk_by_hand(nodes, edges, depth=5, most=12)
        seen |= {(s[8], s[7]) for t in got.values() for s in t}
    assert {(True, True), (True, False)} <= seen
    chain = {i: ("symbol", f"s{i}", f"f#s{i}", "go", 3, ("db",) if i == 15 else ()) for i in range(6, 16)} | {0: ("repo", "r", "", None, None, ()), 3: ("file", "f", "f", "go", 0, ())}
    edges = {(i, i + 1, "flow" if i == 6 else "calls", None) for i in range(6, 15)}
    assert run(spark, chain, edges)[0] == walk_by_hand(chain, edges, depth=5, most=12)


def test_summary_and_a_branch_far_from_its_sink(spark):
    far = {i: ("symbol", f"s{i}", f"f#s{i}", "go" if i % 2 else "rust", 3, ("db",) if i == 40 else ()) for i in range(6, 41)} | {0: ("repo", "r", "", None, None, ()), 1: ("package", "pack", "pack", None, 0, ()), 3: ("file", "f", "f", "go", 1, ())}
    edges = {(i, i + 1, "calls", "c") for i in range(6, 40)} | {(6, 9, "flow", "http /a"), (6, 8, "flow", "http /a"), (7, 8, "flow", "queue q")}
    got, steps, n = run(spark, far, edges)
    assert got == walk_by_hand(far, edges)
    (r,) = R.summary(steps, n).collect()
    assert (r.entry, r.entry_path, r.name, r.hops, r.langs, r.lanes, r.via, r.truncated) == (6, "f#s6", "s6", 3, ["rust", "go"], ["pack"], ["queue q", "http /a"], True)


def test_nothing_to_walk(spark):
    nodes, edges = world(random.Random(5), 4, 0, 0)
    assert run(spark, nodes, edges)[0] == {} and run(spark, {}, set())[0] == {}
    assert run(spark, nodes, edges, [6])[0] == walk_by_hand(nodes, edges, [6])


def test_endpoints(spark):
    nodes = {i: ("symbol", f"s{i}", f"s{i}", "go", None, t) for i, t in enumerate([
        ("http-server", "route:/a"), ("http-client", "route:/a"), ("http-client", "route:/a"), ("http-server", "route:/b"), ("http-client", "route:/c"), ("queue", "queue-producer", "topic:t"), ("queue", "topic:t"),
        ("queue", "queue-producer", "topic:u"), ("ipc-server", "ipc:go"), ("route:/z",)])}
    n, e = tables(spark, nodes, {(1, 0, "flow", "http /a"), (4, 3, "flow", None)})
    got = {(r.kind, r.key): (list(r.handlers), list(r.callers), r.status) for r in R.endpoints(n, e).collect()}
    assert got == {("http", "/a"): ([0], [1], "ok"), ("http", "/b"): ([3], [], "no-callers"), ("http", "/c"): ([], [4], "no-handler"), ("queue", "t"): ([6], [5], "ok"), ("queue", "u"): ([], [7], "no-handler"), ("ipc", "go"): ([8], [], "no-callers")}


def test_walks_write_little(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    symbols = {i: ("symbol", f"s{i}", f"f#s{i}", "go", 3, ("db",)) for i in range(1000, 4000)}
    files = {i: ("file", f"f{i}", f"f{i}", "go", 0, ("fs",)) for i in range(100, 160)}
    nodes = symbols | files | {0: ("repo", "r", "", None, None, ()), 3: ("file", "f", "f", "go", 0, ())}
    edges = {(i, 100 + (i * k) % 50, "calls", f"c{k}") for i in symbols for k in (1, 3, 7, 11)} | {(i, 150 + i % 10, "flow", "http /a") for i in range(100, 150)}
    got, steps, _ = run(spark, nodes, edges)
    assert got == walk_by_hand(nodes, edges)
    written = sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file())
    assert written < 100 * steps.count()
