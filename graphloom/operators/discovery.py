"""What people and agents write, matched to the code and to the model: names, starts of flows, and messages.

All of it is joins by key with a priority. Only the merge of messages is by rounds, each a few windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import endpoint_keys
from graphloom.operators.traces import contract_ends, ground, walks
from graphloom.plans.durable import cut, small

KINDS = ("call", "flow", "store", "return")


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def registry(containers: DataFrame, components: DataFrame, people: DataFrame, externals: DataFrame, journeys: DataFrame) -> DataFrame:
    """(key, id, ids): the id that each lower-cased name stands for, and how many different ones claim it.

    containers have (id, package, name, ord), components (id, container, name, ord), the others (id, name,
    ord); ord are whole numbers. The first registration holds: containers in order, each by id, package and
    name and then its components by id and by `container/component`; then components by their name alone;
    people; externals; journeys. Null names and those of components without a container are not registered.
    """
    c = containers.select(F.col("id").alias("container"), F.col("name").alias("above"), F.col("ord").alias("c_ord"), "package")
    within = components.join(c, "container").withColumnRenamed("ord", "k_ord")

    def names(df: DataFrame, stage: int, first: Column, second: Column, *written: Column) -> DataFrame:
        rank = lambda i: F.struct(F.lit(stage).alias("stage"), first.cast("long").alias("a"), second.cast("long").alias("b"), F.lit(i).alias("c"))
        return df.select("id", F.inline(F.array(*[F.struct(_key(w).alias("key"), rank(i).alias("rank")) for i, w in enumerate(written)])))

    none = F.lit(None)
    full = lambda sep: F.concat("above", F.lit(sep), "name")
    put = [
        names(containers, 0, F.col("ord"), none, F.col("id"), F.col("package"), F.col("name")),
        names(within, 0, F.col("c_ord"), F.col("k_ord"), F.col("id"), full("/"), full(" / ")),
        names(within, 1, F.col("c_ord"), F.col("k_ord"), F.col("name")),
        *[names(df, stage, F.col("ord"), none, F.col("id"), F.col("name")) for stage, df in ((2, people), (3, externals), (4, journeys))],
    ]
    return reduce(DataFrame.unionByName, put).filter("key IS NOT NULL").groupBy("key").agg(F.min_by("id", F.struct("rank", "id")).alias("id"), F.count_distinct("id").alias("ids"))


def named(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (query, name, within) with id and ids of what a name stands for in a registry; null and 0 if
    nothing. within, where it is not null, is the container whose part of that name is meant first. query is
    unique."""
    first = F.when(F.col("within").isNotNull(), F.lower(F.concat("within", F.lit("/"), "name")))
    tries = asked.select("query", F.posexplode(F.array(first, _key(F.col("name")))).alias("prio", "key")).filter("key IS NOT NULL")
    found = tries.join(known, "key").groupBy("query").agg(F.min_by(F.struct("id", "ids"), "prio").alias("hit"))
    return asked.join(found, "query", "left").select(*[asked[c] for c in asked.columns], F.col("hit.id").alias("id"), F.coalesce("hit.ids", F.lit(0)).cast("long").alias("ids"))


def starts(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query, entry, trace, how) of asked (query, start, hint): where a flow begins that a person wrote.

    In this order: hint, then start, is the path of an entry with a trace; start is the path of a symbol
    (it holds #), traced from there if that crosses anything; it is a route or a command, followed from the
    first caller, else handler, that has a trace, else from the first handler or caller; it is a file,
    through the first trace that begins in it, else the file itself. entry is a path, '' if nothing
    matches, and trace the id of the entry whose trace it is, null if none. how is trace, symbol, endpoint,
    file or none. Blanks and back quotes around what is written do not count; null counts as empty. query
    is unique; callers and handlers of a contract, and nodes of one path, go by id.
    """
    bare = lambda c: F.btrim(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("`"))
    want = cut(asked.select("query", bare("start").alias("start"), bare("hint").alias("hint")))
    on = ground(nodes, edges)
    steps = walks(on)
    lang = steps.join(nodes.select(F.col("id").alias("node"), "lang"), "node", "left") if "lang" in nodes.columns else steps.withColumn("lang", F.lit(None).cast("string"))
    order = lang.groupBy("entry").agg((-F.count_if("flow")).alias("h"), (-F.count_distinct("lang")).alias("l"), (-F.count("*")).alias("s"))
    all_traces = cut(order.join(nodes.select(F.col("id").alias("entry"), F.col("path").alias("entry_path")), "entry"))
    rank = F.struct("h", "l", "s", "entry_path", "entry")
    by_path = all_traces.groupBy(F.col("entry_path").alias("written")).agg(F.min_by("entry", rank).alias("trace"))
    hit = lambda df, prio, how: df.select("query", F.struct(F.lit(prio).alias("prio"), F.col("path").alias("entry"), F.col("trace"), F.lit(how).alias("how")).alias("hit"))
    written = want.select("query", F.posexplode(F.array("hint", "start")).alias("prio", "written")).filter("written <> ''")
    at_entry = written.join(by_path, "written").select("query", F.struct("prio", F.col("written").alias("entry"), "trace", F.lit("trace").alias("how")).alias("hit"))

    first_of = nodes.groupBy("path").agg(F.min("id").alias("id"))
    left = want.filter("start <> ''").join(at_entry.select("query").distinct(), "query", "left_anti")
    symbol = left.filter(F.contains("start", F.lit("#"))).join(first_of.withColumnRenamed("path", "start"), "start").select("query", F.col("start").alias("path"), "id")
    # the first contract, gaps first and then by key, of those that the words may mean; who takes part in it stays a row
    # each, once a contract and not once a query
    ends = contract_ends(nodes, edges).select(F.concat("kind", F.lit(" "), "key").alias("key"), F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("caller").alias("id")), F.struct(F.lit(1).alias("side"), F.col("handler").alias("id")))))
    ends = cut(ends.filter("id IS NOT NULL").distinct())
    known = cut(ends.groupBy("key").agg((F.count_distinct("side") == 2).alias("ok"), F.coalesce(F.min(F.when(F.col("side") == 1, F.col("id"))), F.min("id")).alias("first")))
    meant = left.select("query", F.explode(endpoint_keys(F.col("start"))).alias("key")).join(small(known), "key")
    meant = cut(meant.groupBy("query").agg(F.min(F.struct("ok", "key", "first")).alias("e")).select("query", "e.key", "e.first"))
    sides = ends.join(meant.select("key").distinct(), "key", "left_semi")
    # what may be traced although it is called itself
    others = symbol.select("id").unionByName(sides.select("id")).distinct().join(all_traces.select(F.col("entry").alias("id")), "id", "left_anti")
    traced = cut(walks(on, others).select(F.col("entry").alias("id")).distinct().unionByName(all_traces.select(F.col("entry").alias("id"))))
    traced = traced.withColumn("trace", F.col("id"))
    at_symbol = symbol.join(traced, "id", "left")
    paths = nodes.select("id", "path")
    by_key = cut(sides.join(traced, "id").groupBy("key").agg(F.min(F.struct("side", "id"))["id"].alias("id")))
    followed = meant.join(small(by_key), "key").select("query", "id").join(paths, "id").withColumn("trace", F.col("id"))
    named_first = meant.select("query", F.col("first").alias("id")).join(paths, "id").withColumn("trace", F.lit(None).cast(nodes.schema["id"].dataType))
    in_file = F.substring_index("start", "#", 1)
    of_file = all_traces.groupBy(F.substring_index("entry_path", "#", 1).alias("file")).agg(F.min_by(F.struct(F.col("entry").alias("trace"), "entry_path"), rank).alias("t"))
    files = left.select("query", in_file.alias("file")).join(nodes.filter("kind = 'file'").select(F.col("path").alias("file")).distinct(), "file").join(of_file, "file", "left")
    files = files.select("query", F.coalesce("t.entry_path", "file").alias("path"), F.col("t.trace").alias("trace"))
    hits = [at_entry, hit(at_symbol.filter("trace IS NOT NULL"), 2, "trace"), hit(at_symbol.filter("trace IS NULL"), 3, "symbol"), hit(followed, 4, "endpoint"), hit(named_first, 5, "endpoint"), hit(files, 6, "file")]
    best = reduce(DataFrame.unionByName, hits).groupBy("query").agg(F.min_by("hit", "hit.prio").alias("hit"))
    return want.join(best, "query", "left").select("query", F.coalesce("hit.entry", F.lit("")).alias("entry"), F.col("hit.trace").alias("trace"), F.coalesce("hit.how", F.lit("none")).alias("how"))


def merged(answers: DataFrame, drafts: DataFrame) -> DataFrame:
    """answers (journey, ord, src, dst, kind) with draft, the ord of the draft message that each takes over.

    In order, an answer takes the first draft (journey, ord, src, dst, kind) left with its ends and kind,
    else the first left of its kind between the same containers; a part's container is what its id has
    before the last slash. Each draft is taken once; draft is null where none is left. Kinds other than
    KINDS count as calls. ord are unique within a journey on either side.

    Within a pair of containers and a kind, a round settles the answers up to the second change from exact
    matches to others: the k-th of equal answers takes the k-th equal draft while there is one, and of the
    answers after them that have none, the k-th takes the k-th draft left. Both by row numbers, so rounds
    follow how often a pair's answers change sides and not their number.
    """
    grain = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.col(c))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("call")
    of, same = ["journey", "a", "b", "kind"], ["journey", "a", "b", "kind", "src", "dst"]
    keyed = lambda df: df.select("journey", "ord", "src", "dst", kind.alias("kind"), grain("src").alias("a"), grain("dst").alias("b"))
    left, free = cut(keyed(answers)), cut(keyed(drafts).withColumnRenamed("ord", "draft"))
    nth = lambda keys, by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    done = []
    while True:
        # the exact draft that each answer has if all equal answers before it have theirs
        exact = left.withColumn("k", nth(same, "ord")).join(free.withColumn("k", nth(same, "draft")), [*same, "k"], "left").drop("k")
        before = Window.partitionBy(*of).orderBy("ord")
        missing = F.col("draft").isNull().cast("int")
        runs = exact.withColumn("was", F.coalesce(F.lag(missing).over(before), F.lit(0))).withColumn("turn", F.sum(((F.col("was") == 1) & (missing == 0)).cast("int")).over(before))
        now = cut(runs.filter("turn = 0").drop("was", "turn"))
        hits = now.filter("draft IS NOT NULL")
        rest = free.join(hits.select("journey", "draft"), ["journey", "draft"], "left_anti")
        others = now.filter("draft IS NULL").drop("draft").withColumn("k", nth(of, "ord"))
        others = others.join(rest.select(*of, "draft", nth(of, "draft").alias("k")), [*of, "k"], "left")
        settled = cut(hits.select("journey", "ord", "draft").unionByName(others.select("journey", "ord", "draft")))
        done.append(settled)
        left = cut(left.join(settled.select("journey", "ord"), ["journey", "ord"], "left_anti"))
        if left.isEmpty():
            break
        free = cut(free.join(settled.filter("draft IS NOT NULL").select("journey", "draft"), ["journey", "draft"], "left_anti"))
    return answers.join(reduce(DataFrame.unionByName, done), ["journey", "ord"])
