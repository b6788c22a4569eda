"""End-to-end traces: depth-first walks from entries over calls and flows, and the contracts they cross."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from graphloom.operators.graph import SINK_TAGS, entries, hops, kept, leads_somewhere, lift
from graphloom.plans.durable import cut, small, stored
from graphloom.sources.projection import Graph

DEPTH, STEPS = 24, 300
PLACE, ROUNDS = 2, 2  # bytes of a place among siblings in a key; rounds before walks are written
TASK_EDGES = 100_000  # of the entries whose walks a task makes


def contract_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, kind, handler, caller): ends of the contracts of servers and clients, either null; rows may repeat.

    Flows pair their ends under their label. A node that flows, and a key that flows, is accounted for
    there; other tags make their node a handler if it serves, a caller if it asks. Of a topic the producer
    asks and who else names it answers.
    """
    flows = edges.filter("kind = 'flow' AND label IS NOT NULL")
    key = F.regexp_replace("label", r"^(http|ipc|queue) ", "")
    rows = flows.select(key.alias("key"), F.substring_index("label", " ", 1).alias("kind"), F.col("dst").alias("handler"), F.col("src").alias("caller"))
    flowing = flows.select(F.col("src").alias("id")).unionByName(flows.select(F.col("dst").alias("id"))).distinct()
    tagged = nodes.filter("kind IN ('symbol', 'file')").join(flowing, "id", "left_anti").withColumn("t", F.explode("tags")).filter(F.col("t").rlike("^(route|ipc|topic):"))
    has = lambda *names: F.arrays_overlap("tags", F.array(*[F.lit(t) for t in names]))
    kind = F.when(F.col("t").startswith("route:"), "http").when(F.col("t").startswith("ipc:"), "ipc").otherwise("queue")
    asks = F.when(kind == "queue", has("queue-producer")).otherwise(~has("http-server", "ipc-server") & has("http-client", "ipc-client"))
    serves = F.when(kind == "queue", ~has("queue-producer")).otherwise(has("http-server", "ipc-server"))
    rest = tagged.select(F.regexp_replace("t", "^(route|ipc|topic):", "").alias("key"), kind.alias("kind"), F.when(serves, F.col("id")).alias("handler"), F.when(asks, F.col("id")).alias("caller"))
    rest = rest.filter("handler IS NOT NULL OR caller IS NOT NULL").join(rows.select("key", "kind").distinct(), ["key", "kind"], "left_anti")
    return rows.unionByName(rest)


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, kind, handlers, callers, status): contracts of servers and clients, gaps first."""
    out = contract_ends(nodes, edges).groupBy("key", "kind").agg(F.array_sort(F.collect_set("handler")).alias("handlers"), F.array_sort(F.collect_set("caller")).alias("callers"))
    status = F.when(F.size("handlers") == 0, "no-handler").when(F.size("callers") == 0, "no-callers").otherwise("ok")
    return out.withColumn("status", status).orderBy(F.col("status") == "ok", "kind", "key")


def node_sinks(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """(id, sinks): the sink tags of each node in their order, then the routes and commands that a client
    names which flows nowhere. Nodes without any are left out."""
    crosses = walked.filter("kind = 'flow'").select(F.col("src").alias("id"), F.lit(True).alias("crosses")).distinct()
    client = F.arrays_overlap("tags", F.array(F.lit("http-client"), F.lit("ipc-client")))
    named = F.transform(F.filter("tags", lambda t: t.startswith("route:") | t.startswith("ipc:")), lambda t: F.concat(F.lit("unmatched "), t))
    own = F.filter("tags", lambda t: t.isin(*SINK_TAGS))
    out = nodes.select("id", "tags").join(crosses, "id", "left")
    lost = F.when(client & F.col("crosses").isNull(), named).otherwise(F.expr("array()").cast("array<string>"))
    return out.select("id", F.concat(own, lost).alias("sinks")).filter(F.size("sinks") > 0)


def _marked(rows: DataFrame, kids: DataFrame) -> DataFrame:
    """The first STEPS + 1 rows of each entry in pre-order, with their number n, whether they repeat a node that
    is expanded before, their depth and the children k that they open, null if none."""
    in_order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("key"))
    out = rows.withColumn("n", in_order("entry")).filter(F.col("n") <= STEPS + 1)
    out = out.withColumn("repeat", (in_order("entry", "node") > 1) & F.col("goes_on")).withColumn("depth", (F.octet_length("key") / PLACE).cast("int"))
    opens = (F.col("n") <= STEPS) & ~F.col("repeat") & (F.col("depth") < DEPTH)
    return out.join(kids, "node", "left").withColumn("k", F.when(opens, F.coalesce("own", "kids"))).drop("kids")


def _opened() -> Column:
    """A digest of the steps of a walk that open children."""
    return F.coalesce(F.bit_xor(F.when(F.col("k").isNotNull(), F.xxhash64("key", "node"))).over(Window.partitionBy("entry")), F.lit(0))


def _walks(kids: DataFrame, roots: DataFrame, whole: bool) -> DataFrame:
    """(entry, node, via, flow, n, parent, depth, repeat, truncated): the first STEPS steps from each root, depth
    first, n from 1. Walks without a flow are left out, unless whole.

    A step's key is the places of its ancestors among their siblings and its own, so that keys in order are
    the walk in order. Each round marks the steps so far, and makes the next steps anew as the children of
    those that open any. A step depends only on steps before it, so at least one more step of each walk is
    final after each round, in practice a level or more; a walk of which the same steps open children as
    before is done. A round passes over the steps once, without a shuffle of theirs if kids are few, and only
    every ROUNDS rounds, walks are written. A group holds one walk, STEPS + 1 rows and their children at most.
    """
    of = Window.partitionBy("entry")
    child = lambda x: F.struct(x["dst"].alias("node"), F.concat("key", x["place"]).alias("key"), F.concat("path", F.array(x["dst"])).alias("path"), x["label"].alias("via"), x["flow"].alias("flow"), x["goes_on"].alias("goes_on"), F.lit(None).cast(own).alias("own"))
    own = roots.schema["own"].dataType
    parts = ["node", "key", "path", "via", "flow", "goes_on", "own"]
    none = F.array().cast(ArrayType(roots.select(*parts).schema))
    now, done = roots, None
    for _ in range(0, STEPS + 2, ROUNDS):
        for _ in range(ROUNDS):
            marked = _marked(now, kids).withColumn("before", _opened())
            again = F.when(F.col("depth") == 0, F.array(F.struct(*parts)))
            new = F.transform(F.filter("k", lambda x: ~F.array_contains("path", x["dst"])), child)
            now = marked.select("entry", "before", F.inline(F.concat(F.coalesce(again, none), F.coalesce(new, none))))
        marked = _marked(now, kids).withColumn("settled", _opened() == F.col("before"))
        inside = F.col("n") <= STEPS
        deep = (F.col("depth") >= DEPTH) & ~F.col("repeat") & F.col("goes_on") & inside
        out = marked.withColumns({"truncated": (F.max("n").over(of) > STEPS) | F.bool_or(deep).over(of), "flows": F.bool_or(F.col("flow") & inside).over(of)})
        up = F.expr(f"substring(key, 1, octet_length(key) - {PLACE})")
        # a first child follows its parent
        out = out.withColumn("parent", F.when(F.col("depth") > 0, F.min("n").over(Window.partitionBy("entry", "depth", up)) - 1))
        out = out.filter(~F.col("settled") | (inside & (F.lit(whole) | F.col("flows"))))
        rest = lambda *names: [F.when(~F.col("settled"), F.col(x)).alias(x) for x in names]
        out = stored(out.select("settled", "entry", "node", "via", "flow", "n", "parent", "depth", "repeat", "truncated", *rest("key", "path", "goes_on", "own")))
        final = out.filter("settled").drop("settled", "key", "path", "goes_on", "own")
        done = final if done is None else done.unionByName(final)
        now = out.filter("not settled").select("entry", *parts)
        if now.isEmpty():
            return done
    raise RuntimeError("walks did not settle")


def ground(nodes: DataFrame, edges: DataFrame) -> SimpleNamespace:
    """What all walks share: the hops, the nodes that lead somewhere, the children of each node in order, and the nodes
    that hops lead to."""
    g = Graph(nodes, edges)
    # what follows goes by src, so that a walk begins where its entry's children are
    walked = stored(hops(g).select("src", "dst", "kind", "label").repartition("src").distinct())
    alive = leads_somewhere(g, walked=walked)
    ends = cut(walked.select(F.col("dst").alias("id")).distinct())
    out_of = walked.select(F.col("src").alias("id")).join(small(ends), "id").distinct().withColumn("goes_on", F.lit(True))
    is_alive = alive.join(small(ends), "id").withColumn("alive", F.lit(True))
    ends = small(cut(ends.join(out_of, "id", "left").join(is_alive, "id", "left").select(F.col("id").alias("dst"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"), F.coalesce("alive", F.lit(False)).alias("alive"))))
    live = walked.join(ends, "dst").filter("kind = 'flow' or alive").repartition(1 + walked.count() // TASK_EDGES, "src")
    # a walk has STEPS steps and skips what is on its way, so children beyond these two bounds are in none
    number = F.row_number().over(Window.partitionBy("src").orderBy(F.col("label").asc_nulls_first(), "dst", "kind"))
    ranked = live.withColumn("number", number).filter(F.col("number") <= STEPS + DEPTH + 1)
    place = F.unhex(F.lpad(F.hex("number"), 2 * PLACE, "0"))
    one = F.struct(place.alias("place"), "dst", "label", (F.col("kind") == "flow").alias("flow"), "goes_on")
    kids = ranked.groupBy(F.col("src").alias("node")).agg(F.collect_list(one).alias("kids"))
    return SimpleNamespace(walked=walked, alive=alive, kids=kids, inner=ends.select(F.col("dst").alias("node")))


def walks(on: SimpleNamespace, starts: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(entry, node, via, flow, n, parent, depth, repeat, truncated): steps of the walks of traces, n from 1."""
    if starts is None and not whole:  # an entry that opens nothing has no flow
        roots = on.kids.join(on.inner, "node", "left_anti").select(F.col("node").alias("entry"), F.col("kids").alias("own"), F.lit(True).alias("goes_on"))
    else:
        first = entries(on.walked).join(on.alive, "id", "left_semi") if starts is None else starts.select("id").distinct()
        goes = on.walked.select(F.col("src").alias("id")).distinct().withColumn("goes_on", F.lit(True))
        roots = first.join(goes, "id", "left").join(on.kids.withColumnRenamed("node", "id"), "id", "left" if whole else "inner").select(F.col("id").alias("entry"), F.col("kids").alias("own"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"))
    label, node = F.lit(None).cast("string"), F.col("entry")
    roots = roots.select("entry", node.alias("node"), F.lit(b"").alias("key"), F.array(node).alias("path"), label.alias("via"), F.lit(False).alias("flow"), "goes_on", "own")
    return _walks(small(cut(on.kids.join(on.inner, "node"))), roots, whole)


def traces(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(entry, step, parent, node, via, flow, depth, repeat, truncated, name, path, lang, lane, sinks): steps
    of each trace in pre-order.

    Walks begin at starts (id), or where hops lead out and none in and something is reached. They leave out
    branches that reach neither a sink nor a flow, do not enter a node again that is on the way here, and
    end at a `repeat` of a node that the trace has expanded before. Children go by label (null first), id
    and kind, as edges carry no order of their own. A walk is at most DEPTH deep and STEPS long; one that
    goes on beyond is `truncated`. via is the label and flow whether the hop is one; lane the package that a
    step runs in, '' without one; sinks what data rests in there. Traces without a flow are left out, unless
    whole. lang is null if nodes have none.
    """
    g, on = Graph(nodes, edges), ground(nodes, edges)
    steps = walks(on, starts, whole)
    lang = F.col("lang") if "lang" in nodes.columns else F.lit(None).cast("string")
    lanes = lift(g, kept("package")).join(small(cut(nodes.filter(kept("package")).select(F.col("id").alias("target"), F.col("name").alias("lane")))), "target").select("node", "lane")
    about = nodes.select(F.col("id").alias("node"), "name", "path", lang.alias("lang")).join(lanes, "node", "left").join(node_sinks(nodes, on.walked).withColumnRenamed("id", "node"), "node", "left")
    about = stored(about)
    # entries are many and in one step each, what they reach is less
    below = steps.filter("n > 1").join(small(cut(about.join(on.inner, "node"))), "node", "left")
    out = steps.filter("n = 1").join(about, "node", "left").unionByName(below)
    long = lambda c: c.cast("long")
    return out.select(
        "entry", long(F.col("n") - 1).alias("step"), long(F.col("parent") - 1).alias("parent"), "node", "via", "flow", long(F.col("depth")).alias("depth"), "repeat", "truncated",
        "name", "path", "lang", F.coalesce("lane", F.lit("")).alias("lane"), F.coalesce("sinks", F.expr("array()").cast("array<string>")).alias("sinks"),
    )


def summary(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entry, entry_path, name, hops, steps, langs, lanes, via, sinks, truncated): of each trace its flows,
    its steps, and languages, lanes, labels of flows and sinks as they first appear. The order is flows,
    languages, steps, each the most first, then the entry's path."""
    rows = F.array_sort(F.collect_list(F.struct("step", "lang", "lane", F.when(F.col("flow"), F.col("via")).alias("via"), "sinks")))
    seen = lambda f: F.array_distinct(F.array_compact(F.transform("rows", lambda x: x[f]))).alias(f"{f}s" if f[0] == "l" else f)
    out = steps.groupBy("entry").agg(F.count_if("flow").alias("hops"), F.count("*").alias("steps"), F.bool_or("truncated").alias("truncated"), rows.alias("rows"))
    out = out.select("entry", "hops", "steps", "truncated", seen("lang"), seen("lane"), seen("via"), F.array_distinct(F.flatten(F.transform("rows", lambda x: x["sinks"]))).alias("sinks"))
    out = out.join(nodes.select(F.col("id").alias("entry"), F.col("path").alias("entry_path"), "name"), "entry")
    out = out.select("entry", "entry_path", "name", "hops", "steps", "langs", "lanes", "via", "sinks", "truncated")
    return out.orderBy(F.desc("hops"), F.desc(F.size("langs")), F.desc("steps"), "entry_path", "entry")
