"""Finding nodes by what people write, and small joins around names, topics and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, id, matches) of each distinct text of wanted (query) among nodes (id, path, name).

    Digits are an id. Else the first node with that path; else nodes whose path ends so; else nodes of that
    name. id is null unless the answer is one node; matches counts those of the deciding rule. Path
    endings are cut to the lengths asked for and joined by equality.
    """
    q = wanted.select("query").filter("query is not null and query <> ''").distinct()
    n = nodes.select("id", "path", "name")
    number = F.col("query").rlike(r"^[0-9]+\z")
    ids = q.filter(number).select("query", F.col("query").try_cast("long").alias("id")).join(n.select("id"), "id").select("query", "id", F.lit(0).alias("rule"))
    words = q.filter(~number)
    paths = words.join(n.select(F.col("path").alias("query"), "id"), "query").groupBy("query").agg(F.min("id").alias("id")).select("query", "id", F.lit(1).alias("rule"))
    lengths = [r[0] for r in words.select(F.length("query")).distinct().collect()]  # no more than the longest text has characters
    ends = n.withColumn("long", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).filter(F.length("path") >= F.col("long"))
    ends = ends.select(F.expr("right(path, `long`)").alias("query"), "id").join(words, "query").select("query", "id", F.lit(2).alias("rule"))
    names = words.join(n.select(F.col("name").alias("query"), "id"), "query").select("query", "id", F.lit(3).alias("rule"))
    by = ids.unionByName(paths).unionByName(ends).unionByName(names).groupBy("query", "rule").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = by.groupBy("query").agg(F.min_by(F.struct("n", "id"), "rule").alias("b"))
    return q.join(best, "query", "left").select("query", F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"), F.coalesce("b.n", F.lit(0)).cast("long").alias("matches"))


def distinct_names(named: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """named with a column unique_name: the second of a scope's equal names gets " 2", the third " 3", by order.
    Names that already end so are not looked at."""
    n = F.row_number().over(Window.partitionBy(scope, name).orderBy(order))
    return named.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" "), n.cast("string"))))


def dodge(named: DataFrame, scope: str, name: str, order: str, sep: str = " ") -> DataFrame:
    """named with a column unique_name: by order, each name of a scope that is taken gets the first free of 2, 3, ... behind
    sep, also where another is called so. order is unique in a scope. Names that cannot meet, for they differ
    before their numbers, are told apart first; only those that can are walked."""
    root = F.regexp_replace(name, f"({sep}[0-9]+)+\\z", "")
    keys = named.select(F.col(scope).alias("s_"), F.col(name).alias("t_"), F.col(order).alias("o_"), root.alias("r_")).distinct()
    many = keys.groupBy("s_", "r_").agg(F.count("*").alias("n_")).filter("n_ > 1").select("s_", "r_")

    def walk(pdf):
        used, out = set(), []
        pdf = pdf.sort_values("o_")
        for t in pdf["t_"]:
            got, k = t, 2
            while got in used:
                got, k = f"{t}{sep}{k}", k + 1
            used.add(got)
            out.append(got)
        return pdf[["s_", "t_", "o_"]].assign(u_=out)

    kind = {x: keys.schema[x].dataType.simpleString() for x in ("s_", "t_", "o_")}
    told = keys.join(many, ["s_", "r_"], "left_semi").groupBy("s_", "r_").applyInPandas(walk, ", ".join(f"{k} {v}" for k, v in kind.items()) + ", u_ string")
    out = named.join(told, (F.col(scope) == F.col("s_")) & (F.col(name) == F.col("t_")) & (F.col(order) == F.col("o_")), "left")
    return out.withColumn("unique_name", F.coalesce("u_", name)).drop("s_", "t_", "o_", "u_")


def queue_flows(nodes: DataFrame) -> DataFrame:
    """(src, dst, label): from each producer of a topic to each other node of it that produces none. nodes:
    (id, tags) with queue, queue-producer and topic:<name>."""
    at = nodes.filter(F.array_contains("tags", "queue")).select("id", F.array_contains("tags", "queue-producer").alias("makes"), F.explode(F.filter("tags", lambda t: t.startswith("topic:"))).alias("topic"))
    topic = F.substr(F.col("topic"), F.lit(7))
    makers = at.filter("makes").select(F.col("id").alias("src"), "topic")
    takers = at.filter("not makes").select(F.col("id").alias("dst"), "topic")
    return makers.join(takers, "topic").filter("src <> dst").select("src", "dst", F.concat(F.lit("queue "), topic).alias("label"))


def technology(evidence: DataFrame) -> DataFrame:
    """(src, dst, technology): HTTP, IPC and queue in the order (ord) in which labels first name them."""
    first = F.split("label", " ")[0]
    kinds = F.array(*[F.struct(F.min(F.when(first == k, F.col("ord"))).alias("at"), F.lit(v).alias("name")) for k, v in (("http", "HTTP"), ("ipc", "IPC"), ("queue", "queue"))])
    agg = evidence.groupBy("src", "dst").agg(kinds.alias("k"))
    return agg.select("src", "dst", F.array_join(F.transform(F.array_sort(F.filter("k", lambda x: x["at"].isNotNull())), lambda x: x["name"]), ", ").alias("technology"))


def with_fallback(messages: DataFrame, relationships: DataFrame, container: DataFrame) -> DataFrame:
    """messages (src, dst, ...) with the label of their relationship (src, dst, label), else that of their
    containers (node, container), else null; one relationship a pair."""
    own = relationships.select("src", "dst", F.col("label").alias("own"))
    above = relationships.select(F.col("src").alias("up_src"), F.col("dst").alias("up_dst"), F.col("label").alias("above"))
    up = lambda end: container.select(F.col("node").alias(end), F.col("container").alias(f"up_{end}"))
    out = messages.join(own, ["src", "dst"], "left").join(up("src"), "src", "left").join(up("dst"), "dst", "left").join(above, ["up_src", "up_dst"], "left")
    return out.select(*messages.columns, F.coalesce("own", "above").alias("label"))


def children(nodes: DataFrame) -> DataFrame:
    """(id, children) of nodes that have any."""
    return nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))


def run_totals(runs: DataFrame) -> DataFrame:
    """(agents, failures, cost) of runs (ok, cost); the cost to the cent."""
    return runs.agg(F.count("*").alias("agents"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"))


def shorten(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where some are left out."""
    t = F.trim(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…")))


def ui_action(name: Column) -> Column:
    """Whether a name is one that user interfaces give to what a person does."""
    leaf = F.regexp_extract(name, r"([^.:]*)\z", 1)
    return leaf.rlike("^(on|handle)[A-Z_]") | F.lower(leaf).rlike("click|submit|press")


def endpoint_keys(text: Column) -> Column:
    """The contract keys that a written route or command may mean, as an array."""
    t = F.trim(text)
    head, rest = F.lower(F.regexp_extract(t, r"^(\S+)\s", 1)), F.trim(F.regexp_replace(t, r"^\S+\s+", ""))
    none = F.array().cast("array<string>")
    two = F.when(head.isin("http", "ipc", "queue"), F.array(F.concat(head, F.lit(" "), rest))).when(head.isin("get", "post", "put", "patch", "delete"), F.array(F.concat(F.lit("http "), rest))).otherwise(none)
    one = F.when(t.startswith("/"), F.array(F.concat(F.lit("http "), t))).when(t.rlike("[/.#]"), none).otherwise(F.array(F.concat(F.lit("ipc "), t), F.concat(F.lit("queue "), t)))
    return F.when(t.rlike(r"\s"), two).otherwise(one)


def flow_request(text: Column) -> Column:
    """A struct (name, entry, note) of `name @ entry :: note`, where entry and note may be missing; a text with # and
    without @ is an entry."""
    head = F.trim(F.regexp_extract(text, r"^(.*?)( :: |\z)", 1))
    note = F.trim(F.regexp_extract(text, r"^.*? :: (.*)\z", 1))
    pair = F.contains(head, F.lit(" @ "))
    entry = F.when(pair, F.trim(F.regexp_extract(head, r"^.*? @ (.*)\z", 1))).when(F.contains(head, F.lit("#")), head).otherwise("")
    name = F.when(pair, F.trim(F.regexp_extract(head, r"^(.*?) @ ", 1))).when(F.contains(head, F.lit("#")), "").otherwise(head)
    return F.struct(name.alias("name"), entry.alias("entry"), note.alias("note"))


def entry_kind(kind: Column, name: Column, path: Column, lang: Column, tags: Column) -> Column:
    """What a person would call the node as a place to start from: route, command, main, ui action; else null."""
    stem = F.regexp_extract(F.substring_index(path, "#", 1), r"([^/]*?)(\.[^./]*)?\z", 1)
    main = name.isin("main", "__main__") | ((kind == "file") & stem.isin("main", "__main__"))
    return F.when(F.array_contains(tags, "http-server"), "route").when(F.array_contains(tags, "ipc-server"), "command").when(main, "main").when(lang.isin("typescript", "javascript") & ui_action(name), "ui action")
