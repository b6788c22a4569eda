"""The C4 model of a code graph: containers, components, and the relationships that the code backs.

Everything is a table. Where an order decides (of files, evidence, tags), it is that of paths and ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import slug, title_case
from graphloom.operators.atlas import ARROW_LABELS, EVIDENCE, TOP_DEPENDENCIES, main_language
from graphloom.operators.graph import SINK_TAGS, first_per, lift
from graphloom.operators.lookup import dodge
from graphloom.operators.traces import endpoints
from graphloom.plans.durable import cut, small, stored

c = F.col
FEW_FILES, SALTS, BRIEF_LINES, BRIEF_PARTS, NAMED_PARTS = 6, 64, 60, 14, 4

# Names of kinds of containers and of languages.
KIND_NAMES = {"web": "Web app", "desktop": "Desktop app", "service": "Service", "worker": "Worker", "cli": "Command line", "library": "Library", "tooling": "Tooling"}
LANGUAGE_NAMES = {"rust": "Rust", "typescript": "TypeScript", "javascript": "JavaScript", "python": "Python", "go": "Go"}
# Directories that do not name a component, and files that start a program.
PLAIN_DIRS = ("src", "lib", "pkg", "internal", "app")
MAIN_FILES = ("main.rs", "main.go", "main.py", "main.ts", "index.ts", "app.ts", "main.js", "index.js", "__main__.py")
# Dependencies that say nothing about a technology, and how others are written.
STANDARD = ("os", "sys", "json", "re", "time", "typing", "pathlib", "sqlite3", "fs", "path", "encoding/json", "net/http", "database/sql", "fmt", "context", "errors", "strings", "io", "log", "std", "collections", "dataclasses", "subprocess", "http", "url")
WRITTEN = {"fastapi": "FastAPI", "celery": "Celery", "three": "three.js", "axum": "Axum", "react": "React", "vite": "Vite", "express": "Express", "flask": "Flask", "django": "Django", "sqlalchemy": "SQLAlchemy", "reqwest": "reqwest"}
# What a boundary tag says of a container, in this order.
BOUNDARY_PHRASES = {"http-server": "serves HTTP routes", "ipc-server": "answers IPC commands", "http-client": "calls HTTP APIs", "db": "reads a database", "queue": "uses a queue", "fs": "touches the file system"}
# Kinds of external systems: tag, name, names of variables that name one, verb, technology, description.
STORES = {
    "database": ("db", "Database", "DATABASE|DB|PG|SQL", "reads and writes", "SQL", "Where the data lives."),
    "queue": ("queue", "Queue", "REDIS|QUEUE|BROKER|AMQP|KAFKA", "puts work on", "queue", "Work handed off to be done later."),
    "filesystem": ("fs", "File system", None, "reads and writes files on", "", "Files on the machine."),
}
# What is said of a container without files, of files that none described, and of a container that was added.
NO_FILES = ("The `", "` package has no source files of its own.")
NOT_DESCRIBED = " files the agents did not describe."
ADDED = ("Added container `", "` from the engine: the agents left it out.")
OUTSIDE, OUTSIDE_BLURB, OTHER_BLURB = "Outside HTTP API", "An HTTP API nothing in this repository serves.", "Outside this repository."
USED = ("web", "desktop", "cli")


def _written(value: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), other)


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bare(path: Column) -> Column:
    """A file's name less its last extension."""
    return F.regexp_replace(base(path), r"\.[^.]*\z", "")


def container_id(package: Column) -> Column:
    return F.concat(F.lit("c:"), slug(package))


def container_of(component: Column) -> Column:
    return F.regexp_replace(component, r"/[^/]*\z", "")


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key. A hot key is cut to k rows in each of SALTS shares before it meets in one."""
    shares = Window.partitionBy(*keys, F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*order)
    few = df.withColumn("n_", F.row_number().over(shares)).filter(c("n_") <= k)
    return few.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(c("n_") <= k)


@dataclass
class Facts:
    """What the model needs of a graph. Each table is made and written once, when it is first asked for, as all
    that follows reads it several times and no question needs all."""

    nodes: DataFrame  # as scanned
    lines: DataFrame  # the edges as scanned

    @cached_property
    def _at(self) -> DataFrame:
        """(node, target, at): the file of each node and the node's own path."""
        return cut(lift(SimpleNamespace(nodes=self.nodes), _inner()).join(self.nodes.select(c("id").alias("node"), c("path").alias("at")), "node"))

    @cached_property
    def _named(self) -> DataFrame:
        return self.nodes.filter((c("kind") == "package") & ~c("external")).groupBy(c("name").alias("package")).agg(F.max_by("path", "id").alias("dir"))

    @cached_property
    def files(self) -> DataFrame:
        """(file, path, lang, loc, package)."""
        up = lift(SimpleNamespace(nodes=self.nodes), F.coalesce(c("kind") == "package", F.lit(False)))
        up = up.join(self.nodes.select(c("id").alias("target"), c("name").alias("package")), "target").select(c("node").alias("file"), "package")
        return cut(self.nodes.filter(_inner()).select(c("id").alias("file"), "path", "lang", "loc").join(up, "file", "left").withColumn("package", F.coalesce("package", F.lit("root"))))

    @cached_property
    def packages(self) -> DataFrame:
        """(package, dir): by name; of equal names the directory of the last id."""
        return cut(self._named.unionByName(self.files.select("package").distinct().join(self._named, "package", "left_anti").withColumn("dir", F.lit(""))))

    @cached_property
    def edges(self) -> DataFrame:
        """(a, b, via, label, from_path, to_path): between different files. Ends are looked up where they are, if few
        nodes are called."""
        e = self.lines.filter("kind <> 'contains'")
        called = small(cut(e.select(c("dst").alias("node")).distinct()))
        to = small(cut(self._at.join(called, "node").select(c("node").alias("dst"), c("target").alias("b"), c("at").alias("to_path"))))
        at = self._at.select(c("node").alias("src"), c("target").alias("a"), c("at").alias("from_path"))
        between = e.select("src", "dst", c("kind").alias("via"), "label").join(to, "dst").join(at, "src").filter("a <> b")
        return stored(between.select("a", "b", "via", "label", "from_path", "to_path"))

    @cached_property
    def deps(self) -> DataFrame:
        """(package, dep, weight, rank)."""
        out = self.nodes.filter("kind = 'package' and external").select(c("id").alias("dst"), F.regexp_replace("name", "^(external:)+", "").alias("dep"))
        owner = self._at.select(c("node").alias("src"), c("target").alias("file")).join(self.files.select("file", "package"), "file").select("src", "package")
        counted = self.lines.filter("kind = 'imports'").join(out, "dst").join(owner, "src").groupBy("package", "dep").agg(F.sum("weight").alias("weight"))
        counted = counted.join(self.files.select("package", bare(c("path")).alias("dep")).distinct(), ["package", "dep"], "left_anti")
        return cut(counted.withColumn("rank", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("weight"), "dep"))))

    @cached_property
    def tags(self) -> DataFrame:
        """(path, package, tag, ord): distinct in a file, ord as first met."""
        tagged = self.nodes.filter(~c("external")).select(c("id").alias("node"), F.posexplode("tags").alias("pos", "tag")).join(self._at.drop("at"), "node")
        found = tagged.groupBy(c("target").alias("file"), "tag").agg(F.min(F.struct("node", "pos")).alias("ord"))
        return cut(found.join(self.files.select("file", "path", "package"), "file").drop("file"))


def _inner() -> Column:
    return F.coalesce((c("kind") == "file") & ~c("external"), F.lit(False))


def facts(nodes: DataFrame, edges: DataFrame) -> Facts:
    """The facts of a graph (nodes: id, kind, name, path, lang, parent, loc, tags, external; edges: src, dst, kind,
    label, weight). Packages go by name, so those of one name are one; a file without a package is of `root`.
    A dependency that is called as a file of its package is none."""
    return Facts(nodes, edges)


def technology_of(f: Facts) -> DataFrame:
    """(package, deps): the three most imported dependencies that say something, as people write them."""
    short = F.regexp_replace(base(c("dep")), "^@+", "")
    shell = short.isin("tauri", "api") & F.contains("dep", F.lit("tauri"))
    told = f.deps.filter(~c("dep").isin(*STANDARD) & ~c("dep").startswith("crate") & ~c("dep").startswith("."))
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("package").orderBy("rank"))).filter(c("n") <= TOP_DEPENDENCIES)
    told = told.withColumn("written", F.when(shell, "Tauri").otherwise(_written(short, WRITTEN, short)))
    return told.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "written"))), lambda x: x["written"]).alias("deps"))


def containers(f: Facts) -> DataFrame:
    """(id, package, name, kind, language, technology, description, hidden, files, loc): a container a package, of the
    kind that its tags, the language of its first file and its main file say."""
    starts = f.nodes.filter("name = 'main' and parent is not null").select(c("parent").alias("file")).distinct().withColumn("starts", F.lit(True))
    main = base(c("path")).isin(*MAIN_FILES) | F.coalesce("starts", F.lit(False))
    of = f.files.join(starts, "file", "left").groupBy("package").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.min_by("lang", "path").alias("first"), F.bool_or(main).alias("main"))
    has = f.tags.groupBy("package").agg(*[F.bool_or(c("tag") == t).alias(t) for t in (*BOUNDARY_PHRASES, "ipc-client")])
    lang = main_language(f.files.withColumn("lang", F.coalesce("lang", F.lit("")))).select("package", c("lang").alias("language"))
    p = f.packages.join(of, "package", "left").join(has, "package", "left").join(lang, "package", "left").join(technology_of(f), "package", "left")
    t = lambda name: F.coalesce(c(f"`{name}`"), F.lit(False))
    script = F.coalesce(c("first").isin("typescript", "javascript"), F.lit(False))
    kind = F.when(c("files").isNull(), "tooling").when(t("ipc-server"), "desktop").when(t("http-server"), "service").when(t("queue") & ~t("http-client") & ~script, "worker")
    kind = kind.when(script & (t("ipc-client") | t("http-client") | t("main")), "web").when(t("main"), "cli").otherwise("library")
    first = _written(c("first"), LANGUAGE_NAMES, F.lit(""))
    phrases = F.array_compact(F.array(*[F.when(t(k), v) for k, v in BOUNDARY_PHRASES.items()]))
    where = F.when(c("dir") == "", "the repository root").otherwise(c("dir"))
    told = F.concat(c("files").cast("string"), F.when(c("files") == 1, " file").otherwise(" files"), F.lit(" of "), F.when(first == "", "code").otherwise(first), F.lit(" in `"), where, F.lit("`"), F.when(F.size(phrases) > 0, F.concat(F.lit("; "), F.array_join(phrases, ", "))).otherwise(""), F.lit("."))
    empty = F.concat(F.lit(NO_FILES[0]), "package", F.lit(NO_FILES[1]))
    technology = F.array_join(F.concat(F.when(first == "", F.array().cast("array<string>")).otherwise(F.array(first)), F.coalesce("deps", F.array().cast("array<string>"))), ", ")
    out = p.select(container_id(c("package")).alias("id"), "package", title_case(c("package")).alias("name"), kind.alias("kind"), F.coalesce("language", F.lit("")).alias("language"), technology.alias("technology"), F.when(c("files").isNull(), empty).otherwise(told).alias("description"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("loc", F.lit(0)).alias("loc"))
    return out.withColumn("hidden", (c("kind") == "tooling") | (c("loc") == 0))


def placement(f: Facts) -> DataFrame:
    """(package, path, component, name): the component of each file: of its first directory below the package that
    names something, else Core; but each of at most six files that lie together is one. Names that meet get
    numbers, and so do ids."""
    rel = F.when((c("dir") != "") & c("path").startswith(c("dir")), F.ltrim(F.substr("path", F.length("dir") + 1), F.lit("/"))).otherwise(c("path"))
    parts = F.split(rel, "/")
    dirs = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda d: ~d.isin(*PLAIN_DIRS))
    files = f.files.join(f.packages, "package").select("package", "path", F.coalesce(F.get(dirs, F.lit(0)), F.lit("")).alias("group"))
    size = files.groupBy("package", "group").agg(F.count("*").alias("n")).groupBy("package").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
    alone = (c("groups") == 1) & (c("n") <= FEW_FILES)
    title = F.when(alone, title_case(bare(c("path")))).when(c("group") == "", "Core").otherwise(title_case(c("group")))
    files = files.join(size, "package").select("package", "path", F.when(alone, c("path")).otherwise(c("group")).alias("key"), title.alias("title"))
    named = dodge(files.select("package", "key", "title").distinct(), "package", "title", "key").select("package", "key", c("unique_name").alias("name"))
    ids = dodge(named.withColumn("plain", slug(c("name"))), "package", "plain", "key", "-").select("package", "key", "name", F.concat(container_id(c("package")), F.lit("/"), "unique_name").alias("component"))
    return files.join(ids, ["package", "key"]).select("package", "path", "component", "name")


def components(f: Facts, placed: DataFrame) -> DataFrame:
    """(id, container, name, technology, files, description) of a placement (package, path, component, name)."""
    rows = placed.join(f.files.select("package", "path", "file", "lang"), ["package", "path"])
    inside = f.nodes.filter("parent is not null").select(c("parent").alias("file"), "id", c("name").alias("part")).join(rows.select("file", "path", "component"), "file")
    few = first_k(inside, ["component"], ["path", "id"], NAMED_PARTS)
    listed = few.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "part"))), lambda x: x["part"]), ", ").alias("listed"))
    told = inside.groupBy("component").agg(F.count("*").alias("parts")).join(listed, "component")
    out = rows.groupBy("component", "name").agg(F.count("*").alias("files"), F.min_by("lang", "path").alias("lang")).join(told, "component", "left")
    count = lambda n, one: F.concat(c(n).cast("string"), F.when(c(n) == 1, f" {one}").otherwise(f" {one}s"))
    more = F.when(c("parts").isNull(), "").otherwise(F.concat(F.lit(", "), count("parts", "part"), F.lit(": "), "listed", F.when(c("parts") > NAMED_PARTS, ", …").otherwise("")))
    return out.select(c("component").alias("id"), container_of(c("component")).alias("container"), "name", _written(c("lang"), LANGUAGE_NAMES, F.lit("")).alias("technology"), "files", F.concat(count("files", "file"), more).alias("description"))


def _evidence(rows: DataFrame) -> DataFrame:
    """(level, src, dst, evidence): the first distinct (from, to, via) of each pair, at most EVIDENCE."""
    rank = F.dense_rank().over(Window.partitionBy("level", "src", "dst").orderBy("from_path", "to_path", "via"))
    few = rows.withColumn("n_", rank).filter(c("n_") <= EVIDENCE)  # cut within tasks before pairs meet
    once = few.groupBy("level", "src", "dst", "from_path", "to_path", "via").agg(F.min("label").alias("label"))
    return once.groupBy("level", "src", "dst").agg(F.array_sort(F.collect_list(F.struct(c("from_path").alias("from"), c("to_path").alias("to"), "via", "label"))).alias("evidence"))


def evidence_label(evidence: Column) -> Column:
    """Up to three labels of flows and how many more, or what kinds of use the evidence shows."""
    flows = F.array_distinct(F.array_compact(F.transform(F.filter(evidence, lambda e: e["via"] == "flow"), lambda e: e["label"])))
    more = F.size(flows) - ARROW_LABELS
    uses = lambda via: F.exists(evidence, lambda e: e["via"] == via)
    plain = F.when(~uses("calls"), "imports").when(~uses("imports"), "calls").otherwise("imports and calls")
    return F.when(F.size(flows) > 0, F.concat(F.array_join(F.slice(flows, 1, ARROW_LABELS), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))).otherwise(plain)


def evidence_technology(evidence: Column) -> Column:
    kinds = F.transform(evidence, lambda e: _written(F.split(e["label"], " ")[0], {"http": "HTTP", "ipc": "IPC", "queue": "queue"}, F.lit(None).cast("string")))
    return F.array_join(F.array_distinct(F.array_compact(kinds)), ", ")


def backed(f: Facts, placed: DataFrame) -> DataFrame:
    """(level, src, dst, label, technology, evidence): relationships between components, and between containers,
    that edges between files back."""
    of = small(cut(f.files.select("file", "path").join(placed.select("path", "component").distinct(), "path").drop("path")))
    e = f.edges.join(of.select(c("file").alias("b"), c("component").alias("dst")), "b").join(of.select(c("file").alias("a"), c("component").alias("src")), "a").filter("src <> dst")
    parts = cut(_evidence(e.select(F.lit("component").alias("level"), "src", "dst", "from_path", "to_path", "via", "label")))
    # what comes first between two containers comes first between two of their components
    rows = parts.select(F.lit("container").alias("level"), container_of(c("src")).alias("src"), container_of(c("dst")).alias("dst"), F.inline("evidence")).filter("src <> dst")
    both = parts.unionByName(_evidence(rows.withColumnsRenamed({"from": "from_path", "to": "to_path"})))
    technology = F.when(c("level") == "container", evidence_technology(c("evidence"))).otherwise("")
    return both.select("level", "src", "dst", evidence_label(c("evidence")).alias("label"), technology.alias("technology"), "evidence")


def touches(f: Facts, gaps: DataFrame) -> DataFrame:
    """(package, kind, name, verb, technology, path, tag, key): the files that touch a database, queue or file system,
    and those that call what nothing here serves. gaps: (key, path)."""
    out = None
    for kind, (tag, name, pattern, verb, technology, _) in STORES.items():
        rows = f.tags.filter(c("tag") == tag).select("package", "path", "tag")
        if pattern:
            env = f.tags.filter(c("tag").rlike(f"^env:.*({pattern})")).groupBy("package").agg(F.min_by("tag", F.struct("path", "ord")).alias("env"))
            rows = rows.join(env, "package", "left").withColumn("name", F.when(c("env").isNull(), name).otherwise(F.concat(F.lit(f"{name} ("), F.substr("env", F.lit(5)), F.lit(")")))).drop("env")
        else:
            rows = rows.withColumn("name", F.lit(name))
        rows = rows.select("package", F.lit(kind).alias("kind"), "name", F.lit(verb).alias("verb"), F.lit(technology).alias("technology"), "path", "tag", F.lit("").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    service = gaps.join(f.files.select("path", "package"), "path").select("package", F.lit("service").alias("kind"), F.lit(OUTSIDE).alias("name"), F.concat(F.lit("calls "), "key").alias("verb"), F.lit("HTTP").alias("technology"), "path", c("key").alias("tag"), "key")
    return out.unionByName(service)


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, path): contracts that are called and not served, with the files that call them."""
    at = lift(SimpleNamespace(nodes=nodes), F.coalesce((c("kind") == "file") & ~c("external"), F.lit(False)))
    path = at.join(nodes.select(c("id").alias("target"), "path"), "target").select(c("node").alias("caller"), "path")
    return endpoints(nodes, edges).filter("status = 'no-handler'").select("key", F.explode("callers").alias("caller")).join(path, "caller").select("key", "path").distinct()


def externals(touched: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The external systems (id, name, kind, description), and touches with the id x and name of theirs.

    A declared one (id, name, kind, description, ord) stands for all of its kind, and for its name; else
    the first package of a kind names it. Services go by name alone.
    """
    blurb = F.create_map(*[F.lit(x) for k, v in STORES.items() for x in (k, v[5])], F.lit("service"), F.lit(OUTSIDE_BLURB))
    told = touched.groupBy("kind").agg(F.min_by("name", "package").alias("chosen"))
    rows = touched.join(told, "kind")
    if declared is not None:
        kinds = declared.filter("kind <> 'service'").groupBy("kind").agg(F.min_by(F.struct("id", "name"), "ord").alias("k"), F.min("ord").alias("k_ord"))
        names = declared.groupBy("name").agg(F.min_by(F.struct("id", "name"), "ord").alias("m"), F.min("ord").alias("m_ord"))
        rows = rows.join(kinds, "kind", "left").join(names, "name", "left")
        known = F.when(c("m_ord") <= F.coalesce("k_ord", "m_ord"), c("m")).otherwise(c("k"))
    else:
        known = F.lit(None).cast("struct<id:string,name:string>")
    x = F.coalesce(known, F.struct(F.concat(F.lit("x:"), slug(c("chosen"))).alias("id"), c("chosen").alias("name")))
    rows = rows.withColumn("x", x["id"]).withColumn("x_name", x["name"]).select(*touched.columns, "x", "x_name")
    found = rows.groupBy(c("x").alias("id"), c("x_name").alias("name")).agg(F.min("kind").alias("kind")).select("id", "name", "kind", F.coalesce(F.try_element_at(blurb, c("kind")), F.lit(OTHER_BLURB)).alias("description"))
    if declared is not None:
        found = first_per(declared, ["id"], c("ord")).select("id", "name", "kind", "description").unionByName(found.join(declared, "id", "left_anti"))
    return found, rows


def touching(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(level, src, dst, label, technology, evidence) of touches with x, from containers and from components. A container's
    label to a service names each contract that those before do not contain."""
    at = rows.join(placed.select("package", "path", "component"), ["package", "path"])
    pair = lambda level, s: F.struct(F.lit(level).alias("level"), s.alias("src"))
    both = at.select(F.explode(F.array(pair("container", container_id(c("package"))), pair("component", c("component")))).alias("p"), "*").select("p.*", c("x").alias("dst"), "kind", "verb", "technology", c("path").alias("from_path"), c("x_name").alias("to_path"), F.lit("tag").alias("via"), c("tag").alias("label"), "key")
    rank = F.array_position(F.array(*[F.lit(k) for k in STORES], F.lit("service")), c("kind"))
    verbs = both.groupBy("level", "src", "dst", "kind", "verb", "key").agg(F.min("technology").alias("technology")).groupBy("level", "src", "dst").agg(F.array_sort(F.collect_list(F.struct(rank.alias("o"), "key", "verb", "technology"))).alias("v"))
    first = c("v")[0]
    folded = F.aggregate(c("v"), F.lit(""), lambda acc, v: F.when(acc == "", v["verb"]).when(F.contains(acc, v["verb"]) | (v["key"] == ""), acc).otherwise(F.concat(acc, F.lit(", "), v["verb"])))
    words = verbs.select("level", "src", "dst", F.when(c("level") == "container", folded).otherwise(first["verb"]).alias("label"), first["technology"].alias("technology"))
    return words.join(_evidence(both), ["level", "src", "dst"]).select("level", "src", "dst", "label", "technology", "evidence")


def elements(boxes: DataFrame, placed: DataFrame, people: DataFrame, outside: DataFrame) -> DataFrame:
    """(id) of all that a relationship may join."""
    return boxes.select("id").unionByName(placed.select(c("component").alias("id"))).unionByName(people.select("id")).unionByName(outside.select("id")).distinct()


def claimed(code: DataFrame, claims: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relationships with what others say of them, and the claims (src, dst) that name no element.

    A claim (src, dst, label, technology) on what the code backs gives it words; else it is of the survey if it
    is of a person or an external system, and a claim if not. Of claims on one pair the last words count.
    """
    once = claims.groupBy("src", "dst").agg(F.max(F.struct(F.trim("label").alias("said"), F.trim("technology").alias("means"))).alias("w")).select("src", "dst", "w.*")
    words = code.join(once, ["src", "dst"], "left").select("level", "src", "dst", F.coalesce(F.nullif("said", F.lit("")), "label").alias("label"), F.coalesce(F.nullif("means", F.lit("")), "technology").alias("technology"), F.lit("code").alias("source"), "evidence")
    rest = once.join(code.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    known = rest.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    told = c("src").startswith("p:") | c("src").startswith("x:") | c("dst").startswith("x:")
    deep = F.contains("src", F.lit("/")) | F.contains("dst", F.lit("/"))
    none = F.array().cast(code.schema["evidence"].dataType)
    said = known.select(F.when(deep, "component").otherwise("container").alias("level"), "src", "dst", F.coalesce("said", F.lit("")).alias("label"), F.coalesce("means", F.lit("")).alias("technology"), F.when(told, "survey").otherwise("claimed").alias("source"), none.alias("evidence"))
    return words.unionByName(said), rest.select("src", "dst").join(known.select("src", "dst"), ["src", "dst"], "left_anti")


def default_uses(rels: DataFrame, people: DataFrame, boxes: DataFrame) -> DataFrame:
    """rels, and for each person who uses nothing, that they use every shown container that a person can run."""
    idle = people.select(c("id").alias("src")).join(rels.select("src"), "src", "left_anti").withColumn("k", F.lit(1))
    run = boxes.filter(~c("hidden") & c("kind").isin(*USED)).select(c("id").alias("dst"), F.lit(1).alias("k"))
    none = F.array().cast(rels.schema["evidence"].dataType)
    uses = idle.join(run, "k").select(F.lit("container").alias("level"), "src", "dst", F.lit("uses").alias("label"), F.lit("").alias("technology"), F.lit("survey").alias("source"), none.alias("evidence"))
    return rels.unionByName(uses)


def checked_containers(f: Facts, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A container for each package, and notes (about, what). proposed: (package, name, kind, description, ord); the first of
    a package gives the words, one of no package is dropped, and packages left out come from the code."""
    own = containers(f)
    first = first_per(proposed, ["package"], c("ord")).select("package", c("name").alias("said"), c("kind").alias("as_kind"), c("description").alias("told"), F.lit(True).alias("given"))
    out = own.join(first, "package", "left")
    kind = F.coalesce("as_kind", "kind")
    left_out = F.concat(c("files").cast("string"), F.lit(NOT_DESCRIBED))
    shown = out.select("id", "package", F.coalesce("said", "name").alias("name"), kind.alias("kind"), "language", "technology", F.when(c("given"), c("told")).otherwise(left_out).alias("description"), "files", "loc", ((kind == "tooling") | (c("files") == 0)).alias("hidden"))
    again = proposed.withColumn("n", F.row_number().over(Window.partitionBy("package").orderBy("ord"))).join(own.select("package", F.lit(True).alias("real")), "package", "left")
    notes = again.filter("n > 1 or real is null").select(c("name").alias("about"), F.concat(F.lit("Dropped container `"), "name", F.lit("`: no package `"), "package", F.lit("` in the scan.")).alias("what"))
    added = out.filter("given is null and files > 0").select(c("package").alias("about"), F.concat(F.lit(ADDED[0]), "package", F.lit(ADDED[1])).alias("what"))
    return shown, notes.unionByName(added)


def checked_placement(f: Facts, proposed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placement, unplaced (package, path), notes). proposed: (package, name, ord, path), a row a file of a component. A
    file goes to the first component that names it, if it is of its package; what no component names is of
    `Other files`, or as the code groups it in a package without any component."""
    real = proposed.join(f.files.select("package", "path"), ["package", "path"], "left_semi")
    kept = first_per(real, ["package", "path"], c("ord"))
    parts = proposed.select("package", "name", "ord").distinct()
    ids = dodge(parts.withColumn("plain", slug(c("name"))), "package", "plain", "ord", "-").select("package", "ord", F.concat(container_id(c("package")), F.lit("/"), "unique_name").alias("component"))
    placed = kept.join(ids, ["package", "ord"]).select("package", "path", "component", "name")
    lost = proposed.groupBy("package", "name", "ord").agg(F.count("*").alias("before")).join(kept.groupBy("package", "ord").agg(F.count("*").alias("after")), ["package", "ord"], "left")
    n = c("before") - F.coalesce("after", F.lit(0))
    notes = lost.filter(n > 0).select(c("name").alias("about"), F.concat(F.lit("`"), "name", F.lit("`: dropped "), n.cast("string"), F.lit(" file(s) that are not in `"), "package", F.lit("` or were placed twice.")).alias("what"))
    missing = f.files.select("package", "path").join(placed, ["package", "path"], "left_anti")
    some = placed.select("package").distinct()
    unplaced = missing.join(some, "package", "left_semi")
    other = unplaced.select("package", "path", F.concat(container_id(c("package")), F.lit("/other-files")).alias("component"), F.lit("Other files").alias("name"))
    return placed.unionByName(other).unionByName(placement(f).join(some, "package", "left_anti")), unplaced, notes


@dataclass
class Model:
    containers: DataFrame
    placed: DataFrame  # package, path, component, name
    components: DataFrame
    people: DataFrame  # id, name
    externals: DataFrame
    relationships: DataFrame  # level, src, dst, label, technology, source, evidence
    dropped: DataFrame  # src, dst


def model(nodes: DataFrame, edges: DataFrame, boxes: DataFrame | None = None, placed: DataFrame | None = None, people: DataFrame | None = None, declared: DataFrame | None = None, claims: DataFrame | None = None) -> Model:
    """The whole model of a graph. boxes and placed are checked ones (see checked_containers, checked_placement), else
    those of the code; a person `User` stands in if none is given and there is something that a person can run."""
    f = facts(nodes, edges)
    boxes = cut(containers(f) if boxes is None else boxes)
    placed = cut(placement(f) if placed is None else placed)
    if people is None:
        people = boxes.filter(c("kind").isin(*USED)).select(F.lit("p:user").alias("id"), F.lit("User").alias("name")).distinct()
    outside, touched = externals(cut(touches(f, gaps(nodes, edges))), declared)
    outside, touched = cut(outside), cut(touched)
    code = cut(backed(f, placed).unionByName(touching(touched, placed)))
    if claims is None:
        claims = nodes.sparkSession.createDataFrame([], "src string, dst string, label string, technology string")
    rels, dropped = claimed(code, claims, elements(boxes, placed, people, outside))
    return Model(boxes, placed, components(f, placed), people, outside, cut(default_uses(rels, people, boxes)), dropped)


def report(m: Model) -> DataFrame:
    """(backed, survey, claimed, dropped): how many relationships each source stands for."""
    n = m.relationships.agg(*[F.count_if(c("source") == s).alias(a) for s, a in (("code", "backed"), ("survey", "survey"), ("claimed", "claimed"))])
    return n.crossJoin(m.dropped.agg(F.count("*").alias("dropped")))  # a row each


def at_level(ends: DataFrame, boxes: DataFrame, level: str, focus: str | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(id, box): where each element (id) stands in a drawing: people and externals as they are, the rest as the
    system `s` (context), as their container, or, in the focus of a drawing of components, as themselves. What
    is in a hidden container has no box. With placed, the focus itself stands as its first component by id."""
    free = c("id").startswith("p:") | c("id").startswith("x:")
    shown = boxes.filter(~c("hidden")).select(c("id").alias("up"))
    out = ends.select("id").distinct().withColumn("up", F.when(~free, container_of(c("id"))))
    out = out.join(shown.withColumn("shown", F.lit(True)), "up", "left").filter(free | c("shown"))
    box = F.lit("s") if level == "context" else c("up")
    if level == "components" and focus:
        first = placed.groupBy(container_of(c("component")).alias("up")).agg(F.min("component").alias("first")) if placed is not None else shown.withColumn("first", F.lit(None).cast("string"))
        out = out.join(first, "up", "left")
        box = F.when((c("up") == focus) & F.contains("id", F.lit("/")), c("id")).when(c("up") == focus, F.coalesce("first", "up")).otherwise(c("up"))
    return out.select("id", F.when(free, c("id")).otherwise(box).alias("box"))


def projected(messages: DataFrame, boxes: DataFrame, level: str, focus: str | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(journey, n, src, dst, kind, label): messages (journey, ord, src, dst, kind, label) drawn at a level. What stays in
    a box vanishes; arrows of one kind that follow each other are one, with at most three of their labels; n is
    the place of the first in the journey. In a drawing of components labels must agree, too."""
    ends = messages.select(c("src").alias("id")).unionByName(messages.select(c("dst").alias("id")))
    box = at_level(ends, boxes, level, focus, placed)
    w = Window.partitionBy("journey").orderBy("ord")
    m = messages.withColumn("n", F.row_number().over(w))
    m = m.join(box.select(c("id").alias("src"), c("box").alias("a")), "src").join(box.select(c("id").alias("dst"), c("box").alias("b")), "dst").filter("a <> b")
    keys = ["a", "b", "kind"] + (["label"] if level == "components" else [])
    same = F.lag("ord").over(w).isNotNull()
    for k in keys:
        same = same & F.lag(k).over(w).eqNullSafe(c(k))
    m = m.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"])
    label = F.aggregate(c("labels"), F.lit(None).cast("string"), lambda acc, v: F.when(acc.isNull(), v).when(F.contains(acc, v) | (F.size(F.split(acc, ", ")) >= ARROW_LABELS), acc).otherwise(F.concat(acc, F.lit(", "), v)))
    out = m.groupBy("journey", "island").agg(F.min("n").alias("n"), F.first("a").alias("src"), F.first("b").alias("dst"), F.first("kind").alias("kind"), rows.alias("labels"))
    return out.select("journey", "n", "src", "dst", "kind", label.alias("label"))


def on_diagram(drawn: DataFrame, arrows: DataFrame) -> DataFrame:
    """(src, dst, numbers): for each arrow (src, dst) of a drawing the numbers n of the messages that ride on it; a
    return rides on the arrow of its way there."""
    back = c("kind") == "return"
    rode = drawn.select(F.when(back, c("dst")).otherwise(c("src")).alias("src"), F.when(back, c("src")).otherwise(c("dst")).alias("dst"), "n")
    return arrows.select("src", "dst").distinct().join(rode, ["src", "dst"]).groupBy("src", "dst").agg(F.array_sort(F.collect_list("n")).alias("numbers"))


def checked_messages(messages: DataFrame, ids: DataFrame, placed: DataFrame, rels: DataFrame) -> DataFrame:
    """messages (journey, ord, src, dst, kind, by, from_path, to_path, label) as they hold now, with their source.

    An end with a path is the component of its file, unless it is a person or external; else it must be an
    element. What then has no end, or stays in place, goes. A return is backed by an earlier message the other
    way; else the relationship of its ends, or of their containers, tells; else an engine's message with two
    paths is code, a person's survey, and the rest claimed.
    """
    at = placed.select("path", "component")
    out = messages
    for end in ("src", "dst"):
        p = {"src": "from_path", "dst": "to_path"}[end]
        fixed = c(end).startswith("p:") | c(end).startswith("x:")
        file = F.when(~fixed & (F.coalesce(c(p), F.lit("")) != ""), F.substring_index(p, "#", 1))
        out = out.withColumn("path", file).join(at, "path", "left").drop("path").join(ids.select(c("id").alias(end), F.lit(True).alias("real")), end, "left")
        out = out.withColumn(end, F.coalesce("component", F.when(c("real"), c(end)))).drop("component", "real")
    out = out.filter("src is not null and dst is not null and src <> dst").withColumn("kind", F.when(c("kind").isin("call", "flow", "store", "return"), c("kind")).otherwise("call")).withColumn("by", F.coalesce(F.nullif("by", F.lit("")), F.lit("engine")))
    back = c("kind") == "return"
    out = out.withColumn("a", F.when(back, c("dst")).otherwise(c("src"))).withColumn("b", F.when(back, c("src")).otherwise(c("dst")))
    forth = out.filter("kind <> 'return'").groupBy("journey", "a", "b").agg(F.min("ord").alias("forth"))
    one = rels.groupBy("src", "dst").agg(F.min("source").alias("source"))
    own, up = one.select(c("src").alias("a"), c("dst").alias("b"), c("source").alias("own")), one.select(c("src").alias("ca"), c("dst").alias("cb"), c("source").alias("up"))
    out = out.join(forth, ["journey", "a", "b"], "left").join(own, ["a", "b"], "left").withColumn("ca", container_of(c("a"))).withColumn("cb", container_of(c("b"))).join(up, ["ca", "cb"], "left")
    walked = (F.coalesce("from_path", F.lit("")) != "") & (F.coalesce("to_path", F.lit("")) != "") & (c("by") == "engine")
    source = F.when(back & (c("forth") < c("ord")), "code").otherwise(F.coalesce("own", "up", F.when(walked, "code").when(c("a").startswith("p:"), "survey").otherwise("claimed")))
    return out.select("journey", "ord", "src", "dst", "kind", "by", "from_path", "to_path", "label", source.alias("source"))


def trace_messages(steps: DataFrame, nodes: DataFrame, m: Model) -> DataFrame:
    """(journey, ord, src, dst, kind, label, by, from_path, to_path) of traces (see traces.traces): a person's start, then
    each crossing and each change of component once, and each external system where a component's data rests."""
    at = nodes.select(c("id").alias("node"), "name", "path", F.array_intersect("tags", F.array(*[F.lit(t) for t in SINK_TAGS])).alias("sinks"))
    at = at.withColumn("file", F.substring_index("path", "#", 1)).join(m.placed.select(c("path").alias("file"), "component"), "file").drop("file")
    here = steps.select("entry", "step", "parent", "node", "via", "flow").join(at, "node")
    above = here.select("entry", c("step").alias("parent"), c("component").alias("src"), c("path").alias("from_path"))
    moves = here.filter("parent is not null").join(above, ["entry", "parent"])
    crossing = F.coalesce(c("flow"), F.lit(False))
    label = F.when(crossing, F.coalesce("via", F.lit("flow"))).otherwise(F.concat(F.lit("calls "), "name"))
    made = moves.filter(crossing | (c("src") != c("component"))).select(c("entry").alias("journey"), (c("step") * 2).alias("ord"), "src", c("component").alias("dst"), F.when(crossing, "flow").otherwise("call").alias("kind"), label.alias("label"), "from_path", c("path").alias("to_path"), F.when(crossing, F.coalesce("via", F.lit(""))).otherwise("").alias("once"))
    kinds = F.create_map(*[F.lit(x) for k, v in STORES.items() for x in (v[0], k)], F.lit("process"), F.lit("process"))
    verb = F.when(F.array_contains("sinks", "db"), "reads and writes").when(F.array_contains("sinks", "queue"), "puts work on").otherwise("touches")
    rests = moves.select("entry", "step", "component", "path", verb.alias("label"), F.posexplode("sinks").alias("pos", "sink")).withColumn("kind", F.try_element_at(kinds, c("sink")))
    rests = rests.join(m.externals.groupBy("kind").agg(F.min("id").alias("dst")), "kind").groupBy("entry", "step", "component", "path", "label").agg(F.min_by("dst", "pos").alias("dst"))
    stored = rests.select(c("entry").alias("journey"), (c("step") * 2 + 1).alias("ord"), c("component").alias("src"), "dst", F.lit("store").alias("kind"), "label", c("path").alias("from_path"), F.lit("").alias("to_path"), F.lit("\0sink").alias("once"))
    once = first_per(made.unionByName(stored), ["journey", "src", "dst", "once"], c("ord")).drop("once")
    use = m.relationships.filter(c("src").startswith("p:")).groupBy(c("dst").alias("up")).agg(F.min_by(F.struct("src", "label"), "src").alias("u"))
    starts = here.filter("step = 0").withColumn("up", container_of(c("component"))).join(use, "up").select(c("entry").alias("journey"), F.lit(-1).cast("long").alias("ord"), c("u.src").alias("src"), c("component").alias("dst"), F.lit("call").alias("kind"), c("u.label").alias("label"), F.lit("").alias("from_path"), c("path").alias("to_path"))
    return starts.unionByName(once).withColumn("by", F.lit("engine"))


def brief(f: Facts) -> DataFrame:
    """(package, section, n, line): what to read of each container first: all its files with their parts and tags, then at most
    BRIEF_LINES dependencies each inside it, out of it and into it."""
    part = f.nodes.filter("kind = 'symbol'").select(c("parent").alias("file"), "id", "name")
    parts = first_k(part, ["file"], ["id", "name"], BRIEF_PARTS).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_", "name"))), lambda x: x["name"]), ", ").alias("parts"))
    tags = f.tags.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]), " ").alias("tags"))
    told = F.concat("path", F.lit(" ("), c("loc").cast("string"), F.lit(" lines)"), F.coalesce(F.concat(F.lit("; parts: "), "parts"), F.lit("")), F.coalesce(F.concat(F.lit("; touches: "), "tags"), F.lit("")))
    files = f.files.join(parts, "file", "left").join(tags, "path", "left").select("package", F.lit("files").alias("section"), F.row_number().over(Window.partitionBy("package").orderBy("path")).alias("n"), told.alias("line"))
    end = lambda k, p, q: f.files.select(c("file").alias(k), c("package").alias(p), c("path").alias(q))
    e = f.edges.join(end("a", "pa", "fa"), "a").join(end("b", "pb", "fb"), "b")
    line = F.concat("fa", F.lit(" "), "via", F.lit(" "), "fb", F.coalesce(F.concat(F.lit(" ("), "label", F.lit(")")), F.lit("")))
    side = lambda p, s: F.struct(c(p).alias("package"), F.lit(s).alias("section"))
    sides = F.when(c("pa") == c("pb"), F.array(side("pa", "inside"))).otherwise(F.array(side("pa", "out"), side("pb", "in")))
    deps = e.select(F.explode(sides).alias("s"), line.alias("line")).select("s.*", "line").distinct()
    return files.unionByName(first_k(deps, ["package", "section"], ["line"], BRIEF_LINES).select("package", "section", c("n_").alias("n"), "line"))
