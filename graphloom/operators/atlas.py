"""C4 model operators: journeys, claims, components, rankings and ordered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import slug, title_case
from graphloom.operators.graph import first_per, ordered
from graphloom.plans.durable import cut

EVIDENCE, ARROW_LABELS, TOP_DEPENDENCIES = 12, 3, 3
# Directories that do not name a component.
PLAIN_DIRS = ("src", "lib", "pkg", "internal", "app")


def merge_arrows(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Consecutive messages with the same keys as one: (journey, n, <keys>, merged), n the place of the first,
    by the running count of changes."""
    w = Window.partitionBy("journey").orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & (F.lag(k).over(w).eqNullSafe(F.col(k)))
    fresh = messages.withColumn("fresh", F.when(same & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).withColumn("place", F.row_number().over(w))
    island = fresh.withColumn("island", F.sum("fresh").over(w))
    return island.groupBy("journey", "island", *keys).agg(F.min("place").cast("long").alias("n"), F.count("*").alias("merged")).drop("island")


def project(messages: DataFrame, level: Column) -> DataFrame:
    """Messages (journey, ord, src, dst) with both ends mapped by a rule, less those to nothing or to themselves,
    and consecutive ones merged; n numbers the messages that were there."""
    return merge_arrows(messages.withColumn("kind", level).filter("src is not null and dst is not null and src <> dst"), ["src", "dst", "kind"], "ord")


def overlay(backed: DataFrame, claims: DataFrame) -> DataFrame:
    """(src, dst, label, source): claims put words on what code backs, and else stand as claims."""
    b, c = backed.select("src", "dst", F.col("label").alias("own")), claims.select("src", "dst", F.col("label").alias("said"))
    out = b.join(c, ["src", "dst"], "full")
    return out.select("src", "dst", F.coalesce("said", "own").alias("label"), F.when(F.col("own").isNotNull(), "code").otherwise("claimed").alias("source"))


def component_of(path: Column) -> Column:
    """The first directory of a path that names something, as a title; else Core."""
    dirs = F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda d: (d != "") & ~d.isin(*PLAIN_DIRS))
    return F.coalesce(title_case(F.get(dirs, F.lit(0))), F.lit("Core"))


def component_id(container: Column, name: Column) -> Column:
    return F.concat(F.lit("c:"), slug(container), F.lit("/"), slug(name))


def capped_evidence(edges: DataFrame, cap: int = EVIDENCE) -> DataFrame:
    """(src, dst, n_evidence, evidence): the first distinct (from, to, via) of each pair."""
    rank = F.dense_rank().over(Window.partitionBy("src", "dst").orderBy("a", "b", "via"))
    few = edges.select("src", "dst", "a", "b", "via").withColumn("n", rank).filter(F.col("n") <= cap)  # cut within tasks before pairs meet
    first = few.groupBy("src", "dst").agg(F.array_sort(F.collect_set(F.struct("n", F.concat_ws(">", F.col("a").cast("string"), F.col("b").cast("string"), F.col("via")).alias("t")))).alias("e"))
    return first.select("src", "dst", F.size("e").cast("long").alias("n_evidence"), F.array_join(F.transform("e", lambda x: x["t"]), ";").alias("evidence"))


def relationship_label(edges: DataFrame) -> DataFrame:
    """(src, dst, label): up to three flow labels and how many more, or what kinds of use there are."""
    agg = edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "flow", F.col("label")))).alias("l"), F.bool_or(F.col("kind") == "imports").alias("i"), F.bool_or(F.col("kind") == "calls").alias("c"))
    more = F.size("l") - ARROW_LABELS
    flows = F.concat(F.array_join(F.slice("l", 1, ARROW_LABELS), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    uses = F.when(F.col("i") & F.col("c"), "imports and calls").when(F.col("i"), "imports").otherwise("calls")
    return agg.select("src", "dst", F.when(F.size("l") > 0, flows).otherwise(uses).alias("label"))


def main_language(files: DataFrame) -> DataFrame:
    """(package, lang): that with the most lines, each file at least one; of equals the greatest name."""
    by = files.groupBy("package", "lang").agg(F.sum(F.greatest("loc", F.lit(1))).alias("s"))
    return by.groupBy("package").agg(F.max(F.struct("s", "lang"))["lang"].alias("lang"))


def dependency_rank(imports: DataFrame, top: int = TOP_DEPENDENCIES) -> DataFrame:
    """(package, dep, weight, rank) of each package's most imported dependencies."""
    by = imports.groupBy("package", "dep").agg(F.sum("weight").alias("weight"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("weight"), "dep")).cast("long")).filter(F.col("rank") <= top)


def tag_union(tagged: DataFrame) -> DataFrame:
    """(id, tags): distinct tags in the order of (ord)."""
    return tagged.groupBy("id").agg(F.array_join(ordered(F.col("tag"), F.col("ord")), ",").alias("tags"))


def pick(proposals: DataFrame, cap: int) -> DataFrame:
    """Of proposals (journey, container, ord): one of each journey, first those that are the first of their
    container, then others, up to cap, in their order."""
    once = first_per(proposals, ["journey"], F.col("ord"))
    tier = F.when(F.row_number().over(Window.partitionBy("container").orderBy("ord")) == 1, 0).otherwise(1)
    return once.withColumn("tier", tier).orderBy("tier", "ord").limit(cap).drop("tier").orderBy("ord")


def upsert(journeys: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    return journeys.join(changed.select("id").unionByName(removed.select("id")), "id", "left_anti").unionByName(changed)


def union_by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all parts; of rows with equal keys that of the first part."""
    out = parts[0].withColumn("priority", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("priority", F.lit(n)))
    return first_per(out, keys, F.col("priority")).drop("priority")


def rank_traces(traces: DataFrame, k: int = 8) -> DataFrame:
    """(pick, trace): up to k traces, each that with the largest gain over those before: 6 for a known entry, 5
    for a new start package, 4 for each new boundary, 2 for each new package; then more hops, langs, steps, and
    the lower number. traces: trace, known, start, boundaries, packages, hops, langs, steps.

    Each pick is one aggregate over all traces that are left, combined where they are: no group holds them. What
    is picked comes to the driver, k rows with the boundaries and packages of a trace each. A null start is a
    package of its own, null lists are empty; repeated rows of a trace count once.
    """
    rows = cut(traces.select("trace", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hops", "langs", "steps")], F.coalesce("known", F.lit(False)).alias("known"), "start", *[F.coalesce(c, F.expr("array()").cast("array<string>")).alias(c) for c in ("boundaries", "packages")]))
    starts, bounds, packs, picked = [], set(), set(), []
    words = lambda x: F.array(*[F.lit(v) for v in sorted(x)]).cast("array<string>")
    for _ in range(k):
        new_start = F.lit(True)
        for s in starts:
            new_start = new_start & ~F.col("start").eqNullSafe(F.lit(s))
        gain = 6 * F.col("known").cast("int") + 5 * new_start.cast("int") + 4 * F.size(F.array_except("boundaries", words(bounds))) + 2 * F.size(F.array_except("packages", words(packs)))
        order = F.struct(gain.alias("gain"), "hops", "langs", "steps", (-F.col("trace")).alias("low"))
        left = rows.filter(~F.col("trace").isin(picked)) if picked else rows
        best = left.agg(F.max_by(F.struct("trace", "start", "boundaries", "packages"), order).alias("r")).first().r
        if best is None:
            break
        picked.append(best.trace)
        starts.append(best.start)
        bounds |= {x for x in best.boundaries if x is not None}
        packs |= {x for x in best.packages if x is not None}
    return traces.sparkSession.createDataFrame(list(enumerate(picked)), "pick long, trace long")
