"""Registered queries over the code graph and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions import text as T
from graphloom.operators import atlas as A
from graphloom.operators import discovery as D
from graphloom.operators import graph as G
from graphloom.operators import lookup as L
from graphloom.operators import model as M
from graphloom.operators import traces as R
from graphloom.plans import oracle
from graphloom.plans.durable import cut, small
from graphloom.plans.routes import matched
from graphloom.sources import tree
from graphloom.sources.projection import event_chain, graph, read
from graphloom.streaming import progress, telemetry

Query = Callable[[SparkSession, str], DataFrame]
FOCUS, SUPPLIER, ORDER = 100, 10_003, 100_000_005


def _view(level: str, focus: int | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.view(graph(spark, d), level, focus).withColumn("labels", F.array_join("labels", "|"))

    return run


def _over(f: Callable, home: bool = False) -> Query:
    return lambda spark, d: f(graph(spark, d, home))


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(read(spark, d, table))


def _traced(g) -> tuple[DataFrame, DataFrame]:
    """Nodes, whose first tag stands for a language, and the steps of all traces."""
    nodes = g.nodes.withColumn("lang", F.get("tags", F.lit(0)))
    return nodes, R.traces(nodes, g.edges)


def _traces_steps(g) -> DataFrame:
    return _traced(g)[1].withColumn("sinks", F.array_join("sinks", "|"))


def _traces_summary(g) -> DataFrame:
    nodes, steps = _traced(g)
    return R.summary(steps, nodes).withColumns({c: F.array_join(c, "|") for c in ("langs", "lanes", "via", "sinks")})


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Nations are containers, suppliers their parts, segments people, brands externals, regions journeys; names that orders make up."""
    nation, supplier, customer, part, region, orders = (read(spark, d, t) for t in ("nation", "supplier", "customer", "part", "region", "orders"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    n, s, r = F.col("n_nationkey"), F.col("s_suppkey"), F.col("r_regionkey")
    known = D.registry(
        nation.select(text("c:", n).alias("id"), text("pack ", n % 5).alias("package"), F.col("n_name").alias("name"), n.alias("ord")),
        supplier.select(text("c:", F.col("s_nationkey"), "/", s).alias("id"), text("c:", F.col("s_nationkey")).alias("container"), text("Part ", s % 40).alias("name"), s.alias("ord")),
        customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("ord")).select(text("p:", F.lower("name")).alias("id"), "name", "ord"),
        part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("ord")).select(text("x:", F.lower("name")).alias("id"), "name", "ord"),
        region.select(text("j:", r).alias("id"), F.when(r % 2 == 0, F.col("r_name")).otherwise(text("Part ", r)).alias("name"), r.alias("ord")),
    )
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 5 == 0, text("Part ", c % 50)).when(k % 5 == 1, text(" nation_", c % 30, " ")).when(k % 5 == 2, text("NATION_", c % 25, " / part ", c % 40)).when(k % 5 == 3, text("PACK ", c % 7)).otherwise(text("brand#", c % 60))
    return D.named(orders.select(k.alias("query"), name.alias("name"), F.when(k % 4 == 0, text("NATION_", c % 25)).alias("within")), known)


def _starts(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = F.concat_ws("#", "c_name", "o_orderkey")
    start = F.when(k % 6 == 0, F.concat(F.lit("`"), own, F.lit("` "))).when(k % 6 == 1, F.col("c_name")).when(k % 6 == 2, F.concat(F.lit("GET /NATION_"), (c % 30).cast("string")))
    start = start.when(k % 6 == 3, F.concat(F.lit("/"), F.lower("c_mktsegment"))).when(k % 6 == 4, F.concat(F.lit("Supplier#"), F.lpad((c % 120).cast("string"), 9, "0")))
    return D.starts(orders.select(k.alias("query"), start.alias("start"), F.when(k % 10 == 0, own).otherwise("").alias("hint")), g.nodes, g.edges)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers; as drafts, those in no third place, a turn later."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    at = F.concat("role", F.lit("/"), (F.col("turn") % 2).cast("string"))
    said = read(spark, d, "conversations").select(F.col("conv_id").alias("journey"), F.col("turn").alias("ord"), at.alias("src"), F.coalesce(F.lead("role").over(w), F.lit("end")).alias("dst"), F.when(F.contains("text", F.lit("a")), "call").otherwise("flow").alias("kind"))
    drafts = said.filter("ord % 3 > 0").withColumn("src", F.when(F.col("ord") % 4 == 0, F.lit("user/0")).otherwise(F.col("src")))
    return D.merged(said, drafts).select("journey", "ord", "draft")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of runs (a user each), some of them broken, read as progress."""
    c, i = F.col, F.col("event_id")
    made = lambda event, **f: F.to_json(F.struct(F.lit(event).alias("event"), *[v.alias(k) for k, v in f.items()]))
    role, target, some = c("event_type").alias("role"), F.when(i % 3 > 0, c("user_id").cast("string")), F.array(F.struct(c("event_type").alias("name")))
    thing = F.struct(c("user_id").alias("id"))
    kinds = [
        made("started", model=role, containers=c("user_id"), journeys=c("user_id") % 7, scout=c("value") > 50), made("stage", stage=role), made("proposed", flows=some),
        made("survey_done", system=thing, people=some, externals=F.array(), containers=some), made("container_done", container=thing), made("journey_done", journey=thing), made("verified", atlas=thing),
        made("agent_done", role=role, target=target, ok=c("value") <= 100, cost_usd=c("value"), secs=c("user_id").cast("double"), error=F.when(c("value") > 100, c("props"))),
        *[made("agent_activity", role=role, target=target, kind=F.lit("reading"), path=F.concat(F.lit("src/"), c("event_type")))] * 4,
        made("agent_activity", role=role, target=target, kind=F.lit("searching"), query=c("props")), made("agent_started", role=role, target=target, name=F.concat(F.lit("the "), role)),
        made("lost"), F.when(i % 32 == 15, F.lit('{"event": "stage", ')).otherwise(made("stage", stage=F.lit(None).cast("string"))),
    ]
    line = F.lit(None).cast("string")
    for n, kind in enumerate(kinds):
        line = F.when(i % 16 == n, kind).otherwise(line)
    return progress.events(read(spark, d, "events").select(i.alias("seq"), c("ts").cast("timestamp").alias("ts"), F.concat(F.lit("r"), (c("user_id") % 50).cast("string")).alias("run"), line.alias("value")))


def _progress_events(spark: SparkSession, d: str) -> DataFrame:
    inner = F.coalesce(*[F.try_variant_get("body", f"$.{p}", "string") for p in ("flows[0].name", "containers[0].name", "container.id", "journey.id", "atlas.id")])
    return _progress(spark, d).select("seq", "event", "model", "containers", "journeys", "scout", "stage", "role", "target", "name", "kind", "path", "query", "ok", "cost_usd", "secs", "error", inner.alias("inner"), "problem", "raw")


def _agents_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress.agents(_progress(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"), 10 * 86_400)


def _cycles(level: str) -> Callable:
    return lambda g: G.cycles(G.view(g, level))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("journey"), F.col("turn").alias("ord"), F.col("role").alias("src"), F.lead("role").over(w).alias("dst"), F.when(F.contains("text", F.lit("?")), "ask").otherwise("tell").alias("what"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    backed = docs.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("src"), (F.col("n_chars") % 7).alias("dst"), F.col("lang").alias("label"))
    word = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    claims = labels.join(docs.select("doc_id"), "doc_id").select(F.col("doc_id").alias("src"), (F.col("doc_id") % 7).alias("dst"), word.alias("label"))
    return A.overlay(backed, claims)


def _report(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return docs.agg(F.count_if(F.col("known").isNotNull()).alias("backed"), F.count_if(F.col("known").isNull()).alias("claimed"), F.count_if(F.col("source") == "src0").alias("survey"))


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    handlers = pages.select(T.normalize_route(F.col("url")).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("handlers"))
    callers = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h")).select(T.normalize_route(F.col("h")).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("callers"))
    status = F.when(F.col("callers").isNull(), "no-callers").when(F.col("handlers").isNull(), "no-handler").otherwise("ok")
    return handlers.join(callers, "key", "full").select("key", F.coalesce("handlers", F.lit(0)).alias("handlers"), F.coalesce("callers", F.lit(0)).alias("callers"), status.alias("status")).orderBy(F.col("status") == "ok", "key")


def _routes(spark: SparkSession, d: str) -> DataFrame:
    routes = read(spark, d, "pages").select(T.normalize_route(F.col("url")).alias("route")).filter("route is not null").distinct()
    return matched(routes, routes).filter("client <> server")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """The deepest package directory that is a prefix of each page's path: prefixes exploded, one equi-join."""
    pages = read(spark, d, "pages")
    parts = F.split("url", "/")
    packages = F.broadcast(spark.createDataFrame([("http:",), ("https:",)], "package string")).unionByName(pages.filter(F.size(parts) > 4).select(F.array_join(F.slice(parts, 1, 4), "/").alias("package")).distinct())
    prefixes = pages.select("page_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "package"))
    return prefixes.join(packages, "package").groupBy("page_id").agg(F.max_by("package", "depth").alias("package"))


def _innermost(spark: SparkSession, d: str) -> DataFrame:
    """The smallest interval around each event, the first of equals; null without one."""
    events, nation = read(spark, d, "events").select("event_id", "user_id"), read(spark, d, "nation")
    low = F.col("n_nationkey") * 6
    spans = nation.select(F.col("n_nationkey").alias("def"), (F.col("n_nationkey") % 5).alias("size"), F.explode(F.sequence(low.cast("long"), (low + (F.col("n_nationkey") % 5) * 10).cast("long"))).alias("user_id"))
    inner = spans.groupBy("user_id").agg(F.min_by("def", F.struct("size", "def")).alias("def"))
    return events.join(inner, "user_id", "left").select("event_id", "def")


def _evidence(g) -> DataFrame:
    parent = g.nodes.select("id", "parent")
    e = g.edges.filter("kind = 'calls'")
    called = small(cut(e.select(F.col("dst").alias("id")).distinct()))
    above = small(cut(parent.join(called, "id").select(F.col("id").alias("dst"), F.col("parent").alias("q"))))
    e = e.join(above, "dst").join(parent.select(F.col("id").alias("src"), F.col("parent").alias("p")), "src")
    return A.capped_evidence(e.select(F.col("p").alias("src"), F.col("q").alias("dst"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("label").alias("via")))


def _relationships(g) -> DataFrame:
    ends = G.raised(g, G.kept("package"))
    return A.relationship_label(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "label"))


def _dep_rank(g) -> DataFrame:
    at = g.nodes.select(F.col("id").alias("src"), F.col("parent").alias("package"))
    return A.dependency_rank(g.edges.filter("kind = 'imports'").join(at, "src").select("package", F.col("dst").alias("dep"), "weight"))


def _ancestor_package(g) -> DataFrame:
    return G.lift(g, F.coalesce(F.col("kind") == "package", F.lit(False))).select("node", F.col("target").alias("package"))


def _rank_pick(events: DataFrame) -> DataFrame:
    return A.pick(events.select(F.col("user_id").alias("journey"), F.col("event_type").alias("container"), F.col("event_id").alias("ord")), 12)


def _rank_traces(spark: SparkSession, d: str) -> DataFrame:
    chain = event_chain(spark, d)
    t = chain.groupBy(F.col("user_id").alias("trace")).agg(
        F.bool_or((F.col("pos") == 0) & (F.col("event_type") == "signup")).alias("known"), F.min_by("event_type", "pos").alias("start"), F.array_sort(F.collect_set(F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")))).alias("boundaries"),
        F.array_sort(F.collect_set("event_type")).alias("packages"), F.count_if(F.col("next_type") != F.col("event_type")).alias("hops"), F.count_distinct("event_type").alias("langs"), F.count("*").alias("steps"))
    return A.rank_traces(t, 8)


def _not_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files below region, nation and segment; regions and nations have rules."""
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), "c_custkey")
    own = F.when(F.col("n_nationkey") % 3 == 0, "BUILDING/").when(F.col("n_nationkey") % 3 == 1, "!*5").otherwise("/MACH*/*[2-4]\n# all")
    texts = nations.select(F.concat_ws("/", "r_name", "n_name").alias("dir"), F.lit(1).alias("rank"), own.alias("text"))
    regions = read(spark, d, "region").select(F.col("r_name").alias("dir"), F.lit(1).alias("rank"), F.lit("*5\n!*15\n").alias("text"))
    return tree.not_ignored(files, tree.rules(texts.unionByName(regions))).select("c_custkey", "path")


def _log(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "signup", "info").otherwise("debug")
    return telemetry.log_query(events.select(F.col("event_id").alias("seq"), level.alias("level"), F.col("props").alias("message")), 500, "info", '"k": 7', 50)


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return A.upsert(ids.withColumn("state", F.lit("kept")), ids.filter("id % 5 = 0 and id % 7 <> 0").withColumn("state", F.lit("changed")), ids.filter("id % 7 = 0"))


def _fps(events: DataFrame) -> DataFrame:
    return telemetry.frames(events, "ts", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "frames")


CALLEES = [
    ("fetch", "typescript", "/api/x"), ("axios.get", "javascript", "http://h/a/1"), ("app.get", "python", "/users"), ("app.get", "python", "users"), ("invoke", "typescript", "scan"), ("ipcMain.handle", "typescript", "scan"),
    ("listen", "rust", "x"), ("listen", "javascript", "x"), ("sqlx::query!", "rust", None), ("cursor.EXECUTE", "python", None), ("os.Getenv", "go", "HOME"), ("std::env::var", "rust", "lower"), ("open", "python", "f"), ("open", "go", "f"),
    ("fs.readFileSync", "javascript", None), ("job.delay", "python", "mail"), ("kafka.publish", "go", "topic"), ("exec.Command", "go", "ls"), ("subprocess.run", "python", None), ("x.send", "rust", "/r"), ("http.HandleFunc", "go", "/jobs"), ("nothing", "go", None),
]


def _classified(spark: SparkSession, d: str) -> DataFrame:
    calls = spark.createDataFrame(CALLEES, "callee string, lang string, first string").withColumn("strings", F.array_compact(F.array("first")))
    kind = rules.call_class(F.col("callee"), F.col("lang"), F.col("strings"))
    return calls.select("callee", "lang", F.coalesce("first", F.lit("")).alias("first"), F.coalesce(kind, F.lit("none")).alias("class"), F.array_join(F.coalesce(rules.call_tags(kind, F.col("strings")), F.array().cast("array<string>")), "|").alias("tags"))


def _capped(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    label = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    return lines.groupBy("s_nationkey", "l_linestatus").agg(F.array_join(F.slice(F.array_sort(F.collect_set(label)), 1, G.LABELS), "|").alias("labels"), F.count("*").alias("weight"))


def _traces_order(g) -> DataFrame:
    nodes, steps = _traced(g)
    return R.summary(steps, nodes).limit(20).select("entry", "entry_path", "hops", F.size("langs").cast("long").alias("n_langs"), "steps")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = read(spark, d, "customer"), read(spark, d, "orders").filter("o_orderkey % 50 = 1")
    asked = [customer.filter("c_custkey % 20 = 0").select(F.col("c_name").alias("query")), customer.select(F.right("c_name", F.lit(2)).alias("query")), read(spark, d, "nation").select(F.col("n_name").alias("query"))]
    asked += [orders.select(f(F.col("o_orderkey").cast("string")).alias("query")) for f in (lambda k: F.concat(F.lit("o"), k), lambda k: F.concat(F.lit("#"), k), lambda k: k)]
    wanted = asked[0]
    for a in asked[1:]:
        wanted = wanted.unionByName(a)
    return L.resolve(graph(spark, d).nodes, wanted)


def _topics(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_compact(F.array(F.lit("queue"), F.when(F.col("event_type") == "signup", "queue-producer"), F.concat(F.lit("topic:"), F.col("user_id").cast("string"))))
    return L.queue_flows(read(spark, d, "events").select(F.col("event_id").alias("id"), tags.alias("tags")))


def _technology(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "http /v").when(F.col("event_type") == "click", "ipc c").when(F.col("event_type") == "purchase", "queue p").when(F.col("event_type") == "error", "imports")
    return L.technology(read(spark, d, "events").select((F.col("user_id") % 400).alias("src"), (F.col("event_id") % 5).alias("dst"), label.alias("label"), F.col("event_id").alias("ord")))


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    calls = g.edges.filter("kind = 'calls'")
    exact = calls.filter("label = 'R' and weight > 1").groupBy("src", "dst").agg(F.lit("own").alias("label"))
    at = g.nodes.select(F.col("id").alias("node"), F.col("parent").alias("container"))
    pairs = calls.filter("src % 7 = 0").join(at.select(F.col("node").alias("src"), F.col("container").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("container").alias("b")), "dst")
    return L.with_fallback(calls.select("src", "dst").distinct(), exact.unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("container").alias("label")).distinct()), at)


def _keys(pages: DataFrame) -> DataFrame:
    n = F.col("page_id")
    text = F.when(n % 5 == 0, F.concat(F.lit(" GET  "), "url")).when(n % 5 == 1, F.concat(F.lit("/p/"), n.cast("string"))).when(n % 5 == 2, F.concat(F.lit("Queue q"), n.cast("string"))).when(n % 5 == 3, F.concat(F.lit("word"), n.cast("string"))).otherwise(F.col("url"))
    return pages.select("page_id", F.array_join(L.endpoint_keys(text), "|").alias("keys"))


def _requests(parts: DataFrame) -> DataFrame:
    n, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(n % 4 == 0, F.concat(name, F.lit(" @ a#"), n.cast("string"), F.lit(" :: see @ x :: y"))).when(n % 4 == 1, F.concat(F.lit("f#"), n.cast("string"), F.lit(" :: note "))).when(n % 4 == 2, F.concat(name, F.lit(" @ b"))).otherwise(name)
    return parts.select("p_partkey", L.flow_request(text).alias("r")).select("p_partkey", "r.name", "r.entry", "r.note")


def _entry_kinds(g) -> DataFrame:
    lang = F.when(F.col("kind") == "symbol", "typescript")
    name = F.when(F.col("id") % 10 == 3, "main").when(F.col("id") % 10 == 4, F.concat(F.lit("api.onOpen"), F.col("name"))).otherwise(F.col("name"))
    return g.nodes.select("id", L.entry_kind(F.col("kind"), name, F.col("path"), lang, F.col("tags")).alias("entry_kind")).filter("entry_kind is not null")


def _code(spark: SparkSession, d: str) -> M.Facts:
    """The graph over the tables as code: files in three directories and three languages, some with tags."""
    g, c = graph(spark, d), F.col
    n = g.nodes
    up = n.select(c("id").alias("parent"), c("path").alias("above"))
    ext = F.when(c("id") < 1_000_000, "go").when(c("id") % 2 == 0, "py").otherwise("ts")
    where = F.when(c("id") % 3 == 0, "src").when(c("id") % 3 == 1, "alpha").otherwise("beta_x")
    none = F.array().cast("array<string>")
    tags = F.when(c("id") < 1_000_000, F.when(c("parent") % 3 == 0, c("tags")).otherwise(none)).when(c("id") % 10 == 0, F.array(F.concat(F.lit("env:PG_"), (c("id") % 100).cast("string")))).when(c("id") % 50 == 1, c("tags")).otherwise(none)
    lang = F.when(ext == "go", "go").when(ext == "py", "python").otherwise("typescript")
    files = n.filter("kind = 'file'").join(up, "parent").select("id", "kind", "name", F.concat("above", F.lit("/"), where, F.lit("/"), "name", F.lit("."), ext).alias("path"), lang.alias("lang"), "parent", "loc", tags.alias("tags"), "external")
    at = files.select(c("id").alias("parent"), c("path").alias("above"))
    symbols = n.filter("kind = 'symbol'").join(at, "parent").select("id", "kind", "name", F.concat("above", F.lit("#"), c("id").cast("string")).alias("path"), F.lit(None).cast("string").alias("lang"), "parent", "loc", F.when(c("id") % 20 == 1, c("tags")).otherwise(none).alias("tags"), "external")
    rest = n.filter("kind not in ('file', 'symbol')").withColumn("lang", F.lit(None).cast("string"))
    return M.facts(rest.unionByName(files).unionByName(symbols), g.edges)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return M.containers(_code(spark, d)).drop("id")


def _placement(spark: SparkSession, d: str) -> DataFrame:
    return M.placement(_code(spark, d))


def _backed(spark: SparkSession, d: str) -> DataFrame:
    f = _code(spark, d)
    return M.backed(f, M.placement(f)).select("level", "src", "dst", "label", "technology", F.size("evidence").cast("long").alias("n_evidence"))


def _touching(spark: SparkSession, d: str) -> DataFrame:
    f = _code(spark, d)
    gaps = f.tags.filter(F.col("tag").startswith("route:")).select(F.substr("tag", F.lit(7)).alias("key"), "path")
    return M.touching(M.externals(M.touches(f, gaps))[1], M.placement(f)).select("level", "src", "dst", "label", "technology", F.size("evidence").cast("long").alias("n_evidence"))


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as journeys between a person, two containers, of which one is hidden, and a log, drawn as one system."""
    c = F.col
    system = c("role") == "system"
    src = F.when(c("role") == "user", "p:user").when(system, "c:hidden/x").otherwise("c:a/t")
    dst = F.when(c("turn") % 5 == 4, "x:log").otherwise(F.concat(F.lit("c:b/k"), (c("turn") % 2).cast("string")))
    label = F.when(F.contains("text", F.lit("?")), "ask").otherwise("tell")
    said = read(spark, d, "conversations").select(c("conv_id").alias("journey"), c("turn").alias("ord"), src.alias("src"), dst.alias("dst"), F.lit("call").alias("kind"), label.alias("label"))
    boxes = spark.createDataFrame([("c:a", False), ("c:b", False), ("c:hidden", True)], "id string, hidden boolean")
    return M.projected(said, boxes, "context").select("journey", F.col("n").cast("long").alias("n"), "src", "dst", "kind", "label")


def queries() -> dict[str, Query]:
    c = F.col
    return {
        "model_containers": _boxes,
        "model_placement": _placement,
        "model_relationships": _backed,
        "model_touches": _touching,
        "journey_drawn": _drawn,
        "nodes_resolved": _resolved,
        "queue_flows": _topics,
        "evidence_technology": _technology,
        "relationship_fallback": _fallback,
        "endpoint_keys": _on("pages", _keys),
        "flow_requests": _on("part", _requests),
        "entry_kinds": _over(_entry_kinds),
        "children_counts": _over(lambda g: L.children(g.nodes)),
        "run_totals": _on("events", lambda e: L.run_totals(e.select((c("event_type") != "error").alias("ok"), c("value").alias("cost")))),
        "names_distinct": _on("supplier", lambda s: L.distinct_names(s.select("s_suppkey", "s_nationkey", F.concat(F.lit("n"), (c("s_suppkey") % 3).cast("string")).alias("name")), "s_nationkey", "name", "s_suppkey").select("s_suppkey", "unique_name")),
        "names_shortened": _on("part", lambda p: p.select("p_partkey", L.shorten(c("p_name"), 12).alias("short"))),
        "view_labels_capped": _capped,
        "tag_classify_calls": _classified,
        "traces_order": _over(_traces_order),
        "journey_merge": lambda s, d: A.merge_arrows(_messages(s, d).filter("dst is not null"), ["src", "dst"], "ord"),
        "view_package": _view("package"),
        "view_file": _view("file"),
        "view_symbol": _view("symbol"),
        "view_focus_nation": _view("package", FOCUS),
        "view_degree": _over(lambda g: G.degree(G.view(g, "package"))),
        "hotspots_file": _over(lambda g: G.hotspots(g, "file")),
        "hotspots_package": _over(lambda g: G.hotspots(g, "package")),
        "neighbours_supplier": _over(lambda g: G.neighbours(g, SUPPLIER)),
        "neighbours_order": _over(lambda g: G.neighbours(g, ORDER)),
        "stats_overview": _over(G.stats),
        "stats_by_kind": _over(lambda g: g.nodes.groupBy("kind", "external").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))),
        "loc_propagated": _over(G.loc_propagated),
        "edge_dedup_weight": _over(lambda g: g.edges.groupBy("kind", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))),
        "closure_all": _over(lambda g: g.closure),
        "ancestor_package": _over(_ancestor_package),
        "search_parts": _over(lambda g: G.search(g.nodes, "nation_1", 20)),
        "search_empty": _over(lambda g: G.search(g.nodes, "", 50)),
        "nodes_filtered": _over(lambda g: g.nodes.filter((c("kind") == "file") & F.exists("tags", lambda t: t.startswith("route:/b")) & c("path").contains("7")).select("id", "path")),
        "boundaries_all": _over(lambda g: G.boundaries(g.nodes).select("id", "path")),
        "boundaries_prefix": _over(lambda g: G.boundaries(g.nodes, "http-s").select("id", "path")),
        "flows_rows": _over(G.flows),
        "hops": _over(G.hops),
        "entries": _over(lambda g: G.entries(G.hops(g))),
        "sinks": _over(G.sinks),
        "leads_somewhere": _over(G.leads_somewhere),
        "traces_summary": _over(_traces_summary),
        "traces_steps": _over(_traces_steps),
        "paths_not_ignored": _not_ignored,
        "progress_events": _progress_events,
        "agents_progress": _agents_progress,
        "names_registered": _names,
        "starts_resolved": _starts,
        "drafts_merged": _merged,
        "cycles_file": _over(_cycles("file"), home=True),
        "cycles_package": _over(_cycles("package")),
        "path_between_files": _over(lambda g: G.path_between(g.edges, 100_000_001, 1_000_007)),
        "routes_normalized": _on("pages", lambda p: p.select("page_id", "url", T.normalize_route(c("url")).alias("route"))),
        "routes_matched": _routes,
        "endpoints_gaps": _endpoints,
        "lang_of_path": _on("pages", lambda p: p.select("page_id", T.language(c("url")).alias("lang"))),
        "loc_nonblank": _on("documents", lambda x: x.select("doc_id", T.nonblank_lines(c("text")).alias("loc"))),
        "minified": _on("documents", lambda x: x.select("doc_id", T.minified(c("text")).alias("minified"))),
        "slug_title": _on("part", lambda p: p.select("p_partkey", T.slug(c("p_name")).alias("slug"), T.title_case(c("p_name")).alias("title"))),
        "span_stats": _on("events", lambda e: telemetry.span_stats(e.select(c("event_type").alias("name"), c("value").alias("ms"), c("event_id").alias("seq")))),
        "log_query": _on("events", _log),
        "ring_buffer": _on("events", lambda e: telemetry.ring(e.select(c("event_id").alias("seq"), c("event_type").alias("level")))),
        "fps_tumbling": _on("events", _fps),
        "reducer_by_user": _on("events", lambda e: telemetry.reducer(e.select(c("event_type").alias("role"), c("user_id").alias("target"), F.when(c("value") > 100, "done").when(c("value") > 10, "reading").alias("kind"), c("value").alias("cost"), c("props").alias("path"), c("event_id").alias("seq")))),
        "event_chain_runs": lambda s, d: event_chain(s, d).groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(c("next_type") != c("event_type")).alias("hops"), F.bool_or(c("event_type").isin("purchase", "error")).alias("sinks")),
        "journey_project_containers": lambda s, d: A.project(_messages(s, d), c("what")),
        "journey_participants": _on("conversations", lambda x: x.groupBy("conv_id").agg(F.array_join(G.ordered(c("role"), c("turn")), ",").alias("participants"))),
        "messages_dedup": _on("conversations", lambda x: x.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"), F.count("*").alias("n"))),
        "claims_overlay": _claims,
        "verify_report": _report,
        "components_group": _on("pages", lambda p: p.select("page_id", A.component_of(c("url")).alias("component"))),
        "unplaced_files": lambda s, d: read(s, d, "supplier").join(read(s, d, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09"), c("s_suppkey") == c("l_suppkey"), "left_anti").select("s_suppkey"),
        "externals_named": _on("orders", lambda o: o.groupBy(c("o_orderstatus").alias("kind")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("name"), F.count("*").alias("n"))),
        "main_language": _on("documents", lambda x: A.main_language(x.select(c("source").alias("package"), "lang", F.floor(c("n_chars") / 1000).alias("loc")))),
        "dep_rank": _over(_dep_rank),
        "tags_union": _on("events", lambda e: A.tag_union(e.select(c("user_id").alias("id"), c("event_type").alias("tag"), c("event_id").alias("ord")))),
        "evidence_capped": _over(_evidence),
        "relationship_label": _over(_relationships),
        "rank_pick": _on("events", _rank_pick),
        "rank_traces_greedy": _rank_traces,
        "set_difference": lambda s, d: read(s, d, "benchmark").join(read(s, d, "labels").filter("toxic = 1"), c("item_id") == c("doc_id"), "left_anti").select("item_id"),
        "set_union_priority": lambda s, d: A.union_by_priority([read(s, d, "labels").join(read(s, d, "documents").select("doc_id"), "doc_id", "left_semi").select(c("doc_id").alias("id"), F.lit("label").alias("source")), read(s, d, "documents").select(c("doc_id").alias("id"), F.lit("document").alias("source"))], ["id"]),
        "upsert_journey": _upsert,
        "prefix_join_nearest": _nearest,
        "range_join_innermost": _innermost,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracles()
