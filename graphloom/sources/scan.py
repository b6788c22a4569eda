"""From source files to the code graph: tables in, tables out.

files: path, text. manifests: path, text. The walk of a local tree fills both; any table of sources will do
instead. Extraction runs where the files are (one pass of Python over each), everything after it is joins.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions.builtins import builtin
from graphloom.functions.text import LANGUAGES, language, minified, nonblank_lines
from graphloom.plans.routes import matched
from graphloom.sources import tree
from graphloom.sources.extract import environment, extract

MOST_BYTES = 2 << 20
# Directories that are never searched, and manifests with the rank of their kind.
SKIPPED = ("node_modules", "target", "dist", "build", "out", "vendor", "venv", ".venv", "__pycache__", ".git", "coverage", ".next", ".turbo", ".cache", "site-packages", ".tox", "Pods")
MANIFESTS = {"Cargo.toml": ("cargo", 4), "go.mod": ("go", 3), "pyproject.toml": ("python", 2), "package.json": ("npm", 1)}
GO_FILES = 8

FACT = "fact string, ord long, name string, leaf string, scope long, start long, end long, kind string, strings array<string>, idents array<string>, attrs array<string>, names array<string>, candidates array<string>, package_dir string, external string"


def walk(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Sources and manifests (path, text) below a folder that driver and tasks see; hidden ones, links, SKIPPED,
    what ignore files leave out and files beyond MOST_BYTES are not among them. The driver lists names only:
    Spark's file sources would drop those that begin with an underscore."""
    found = tree.files(spark, root, SKIPPED).filter(F.col("bytes") <= MOST_BYTES)
    name, end = F.substring_index("path", "/", -1), F.substring_index("path", ".", -1)
    source = F.contains(name, F.lit(".")) & end.isin(*LANGUAGES) & ~F.endswith(name, F.lit(".d.ts")) & ~name.isin(*MANIFESTS)
    return tree.read(found.filter(source), root), tree.read(found.filter(name.isin(*MANIFESTS)), root)


def packages(manifests: DataFrame) -> list[dict]:
    """dir, name, kind, module of each package, the deepest first; a root package where none is at the top.
    Manifests are few, so the driver reads them; of several in a folder the highest rank counts."""
    best: dict[str, tuple] = {}
    for r in manifests.orderBy("path").toLocalIterator():
        d, n = posixpath.split(r.path)
        kind, rank = MANIFESTS[n]
        if kind == "npm":
            try:
                name = json.loads(r.text).get("name")
            except (ValueError, AttributeError):
                name = None
        elif kind == "go":
            m = re.search(r"(?m)^module\s+(\S+)", r.text)
            name = m[1] if m else None
        else:
            m = re.search(r"(?ms)^\[(?:package|project|tool\.poetry)\]\s*$(.*?)(?=^\[|\Z)", r.text)
            if not m and kind == "cargo":
                continue
            m = m and re.search(r"(?m)^name\s*=\s*[\"']([^\"']+)[\"']", m[1])
            name = m[1] if m else None
        if d not in best or rank > best[d][0]:
            own = name.split("/")[-1] if kind == "go" and name else name
            best[d] = (rank, {"dir": d, "name": own or d.split("/")[-1] or "root", "kind": kind, "module": name if kind == "go" else None})
    if "" not in best:
        best[""] = (0, {"dir": "", "name": "root", "kind": "root", "module": None})
    return sorted((p for _, p in best.values()), key=lambda p: (-len(p["dir"]), p["dir"]))


def package_of(path: str, packs: list[dict]) -> dict:
    return next(p for p in packs if not p["dir"] or path.startswith(p["dir"] + "/"))


def candidates(path: str, lang: str, module: str, names: list[str], packs: list[dict]) -> tuple[list[str], str | None, str | None]:
    """Where an import may lead: files in order of preference, a folder (Go), or the external it names."""
    here, own = posixpath.dirname(path), package_of(path, packs)
    join = lambda *p: posixpath.normpath(posixpath.join(*p)).lstrip("./") if any(p) else ""
    if lang in ("typescript", "javascript"):
        ends = (".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs")

        def spots(base: str) -> list[str]:
            bare = re.sub(r"\.(js|jsx|mjs)$", "", base)
            return [base, *(bare + e for e in ends), *(f"{base}/index{e}" for e in ends)]

        if module.startswith("."):
            return spots(join(here, module)), None, None
        for alias in ("@/", "~/", "src/"):
            if module.startswith(alias):
                rest = module[len(alias) :]
                return [x for base in (join(own["dir"], "src", rest), join(own["dir"], rest), join("src", rest), rest) for x in spots(base)], None, None
        for p in packs:
            if p["kind"] == "npm" and (module == p["name"] or module.startswith(p["name"] + "/")):
                return [x for b in ("src/index", "index", "src/main") for x in spots(join(p["dir"], b))], None, None
        return [], None, "/".join(module.split("/")[: 2 if module.startswith("@") else 1])
    if lang == "python":
        dots = len(module) - len(module.lstrip("."))
        parts = [x for x in module.lstrip(".").split(".") if x]
        if dots:
            base = here
            for _ in range(dots - 1):
                base = posixpath.dirname(base)
            bases = [base]
        else:
            up, bases = here, ["", own["dir"], join(own["dir"], "src"), "src"]
            while up:
                bases.append(up)
                up = posixpath.dirname(up)
        out = []
        tries = [parts + [n] for n in names if n != "*" and (parts or dots)] + [parts[:k] for k in range(len(parts), 0, -1)] + ([[]] if dots and not parts else [])
        for t in tries:
            for b in bases:
                stem = join(b, *t)
                out += ([f"{stem}.py"] if t else []) + [f"{stem}/__init__.py" if stem else "__init__.py"]
        return list(dict.fromkeys(out)), None, None if dots else parts[0] if parts else None
    if lang == "rust":
        src = join(own["dir"], "src")
        stem = posixpath.basename(path)[:-3]
        inner = here if stem in ("lib", "main", "mod") else join(here, stem)
        files = lambda base, parts: [f for k in range(len(parts), 0, -1) for f in (join(base, *parts[:k]) + ".rs", join(base, *parts[:k]) + "/mod.rs")]
        if module.startswith("mod:"):
            return files(inner, [module[4:]]), None, None
        parts = [p for p in module.split("::") if p]
        if not parts:
            return [], None, None
        if parts[0] == "crate":
            return [*files(src, parts[1:]), f"{src}/lib.rs", f"{src}/main.rs"], None, None
        if parts[0] == "self":
            return files(inner, parts[1:]), None, None
        if parts[0] == "super":
            base = posixpath.dirname(inner)
            parts = parts[1:]
            while parts and parts[0] == "super":
                base, parts = posixpath.dirname(base), parts[1:]
            return files(base, parts), None, None
        if parts[0] in ("std", "core", "alloc"):
            return [], None, "std"
        for p in packs:
            if p["kind"] == "cargo" and p["name"].replace("-", "_") == parts[0]:
                base = join(p["dir"], "src")
                return [*files(base, parts[1:]), f"{base}/lib.rs"], None, None
        return files(inner, parts[:1]), None, parts[0]
    for p in packs:
        if p["module"] and (module == p["module"] or module.startswith(p["module"] + "/")):
            return [], join(p["dir"], module[len(p["module"]) + 1 :]), None
    head = module.split("/")
    return [], None, "/".join(head[:3]) if "." in head[0] else module


@dataclass
class Scan:
    nodes: DataFrame  # id, kind, name, path, lang, parent, loc, tags, external
    edges: DataFrame  # src, dst, kind, label, weight
    unresolved: DataFrame  # file, callee


def scan(files: DataFrame, manifests: DataFrame, builtins: bool = False) -> Scan:
    """The graph of a source tree. Ids are paths: packages `package:<dir>`, files their path, symbols
    `<file>#<name>`, externals `external:<name>:<lang>`. Files over MOST_BYTES and minified ones are left out.

    builtins: whether to look for the definitions of callees that languages bring along, too.
    """
    spark, packs = files.sparkSession, packages(manifests)
    c = F.col
    kept = files.filter((F.octet_length("text") <= MOST_BYTES) & ~minified(c("text"))).withColumn("lang", language(c("path"))).filter("lang is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FACT.split(", ")]
        for pdf in batches:
            rows = []
            for path, text, lang in zip(pdf["path"], pdf["text"], pdf["lang"], strict=True):
                facts, blank = extract(text, lang), dict.fromkeys(names)
                add = lambda **k: rows.append({"file": path, "lang": lang, **blank, **k})  # noqa: B023, E731
                for k, d in enumerate(facts.defs):
                    add(fact="def", ord=k, name=d["name"], leaf=re.split(r"[.:]", d["name"])[-1], kind=d["kind"], start=d["start"], end=d["end"], attrs=d["attrs"])
                for k, x in enumerate(facts.calls):
                    add(fact="call", ord=k, name=x["callee"], leaf=x["leaf"], scope=facts.scope(x["line"]), start=x["line"], strings=x["strings"], idents=x["idents"])
                k = 0
                for x in facts.imports:
                    for own in [[n] for n in x["names"]] if lang == "python" else [x["names"]]:
                        spots, folder, external = candidates(path, lang, x["module"], own, packs)
                        add(fact="import", ord=k, name=x["module"], start=x["line"], names=own, candidates=spots, package_dir=folder, external=external)
                        k += 1
                for k, (line, name) in enumerate(environment(text)):
                    add(fact="env", ord=k, name=name, scope=facts.scope(line), start=line)
            yield pd.DataFrame(rows, columns=["file", "lang", *names])

    facts = kept.mapInPandas(run, f"file string, lang string, {FACT}").persist()
    pack_rows = spark.createDataFrame([(p["dir"], p["name"]) for p in packs], "dir string, name string")
    prefix = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    owner = kept.select("path", F.explode(prefix).alias("dir")).join(F.broadcast(pack_rows.select("dir")), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    of_file = kept.join(owner, "path").select("path", "lang", "dir", nonblank_lines(c("text")).alias("loc"))

    defs = facts.filter("fact = 'def'").withColumn("nth", F.row_number().over(Window.partitionBy("file", "name").orderBy("ord")))
    defs = defs.withColumn("id", F.concat("file", F.lit("#"), "name", F.when(c("nth") > 1, F.concat(F.lit("@"), c("nth").cast("string"))).otherwise(""))).select("file", "lang", c("ord").alias("def"), "id", "name", "leaf", "kind", "attrs", "start", "end")

    # imports: the first candidate that exists, the files of a folder, or an external
    imports = facts.filter("fact = 'import'").select("file", "lang", "ord", "names", "candidates", "package_dir", "external")
    paths = kept.select(c("path").alias("target"))
    to_file = imports.select("file", "ord", "names", F.posexplode("candidates").alias("prio", "target")).join(paths, "target").groupBy("file", "ord").agg(F.min_by("target", "prio").alias("target"), F.first("names").alias("names"))
    in_dir = kept.filter((c("lang") == "go") & ~c("path").endswith("_test.go")).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("package_dir"), c("path").alias("target"))
    in_dir = in_dir.withColumn("n", F.row_number().over(Window.partitionBy("package_dir").orderBy("target"))).filter(c("n") <= GO_FILES).drop("n")
    to_dir = imports.filter("package_dir is not null").join(in_dir, "package_dir").select("file", "ord", "target", "names")
    targets = to_file.select("file", "ord", "target", "names").unionByName(to_dir).filter("file <> target")
    outside = imports.filter("external is not null").join(targets.select("file", "ord"), ["file", "ord"], "left_anti").select("file", "lang", "external")
    external_id = F.concat(F.lit("external:"), "external", F.lit(":"), "lang")

    # calls: same file by full name, without its receiver, by leaf; then imported files, those that name it first
    from_id = defs.select("file", c("def").alias("scope"), c("id").alias("from"))
    calls = facts.filter("fact = 'call'").select("file", "lang", "ord", "name", "leaf", "scope", "strings", "idents")
    calls = calls.join(from_id, ["file", "scope"], "left").withColumn("from", F.coalesce("from", "file"))
    wanted = calls if builtins else calls.filter(~builtin(c("name"), c("lang")))
    bare = wanted.select("file", "ord", "from", F.regexp_replace("name", "!$", "").alias("callee"), F.regexp_replace("leaf", "!$", "").alias("leaf"))
    stripped = F.regexp_replace("callee", r"^(?:self\.|this\.|Self::)+", "")
    keys = bare.select("*", F.posexplode(F.array(c("callee"), stripped, c("leaf"))).alias("prio", "key")).select("file", "ord", "from", "leaf", "callee", "prio", "key")
    known = defs.select("file", c("name").alias("key"), "id", "def").unionByName(defs.filter("leaf <> name").select("file", c("leaf").alias("key"), "id", "def")).groupBy("file", "key").agg(F.min_by("id", "def").alias("id"))
    local = keys.join(known, ["file", "key"]).select("file", "ord", "from", "leaf", "id", "prio", F.lit(0).cast("long").alias("place"))
    head = F.regexp_extract("callee", r"^([^.:]*)", 1)
    far = bare.join(targets.select("file", c("ord").alias("place"), "target", "names"), "file").join(known.select(c("file").alias("target"), c("key").alias("leaf"), "id"), ["target", "leaf"])
    named = F.array_contains("names", head) | F.array_contains("names", c("leaf")) | (F.size("names") == 0)
    remote = far.select("file", "ord", "from", "leaf", "id", F.when(named, 3).otherwise(4).alias("prio"), "place")
    resolved = local.unionByName(remote).groupBy("file", "ord", "from", "leaf").agg(F.min_by("id", F.struct("prio", "place")).alias("to"))
    unresolved = wanted.join(resolved.select("file", "ord"), ["file", "ord"], "left_anti").select("file", c("name").alias("callee"))

    # tags and bindings
    classed = calls.withColumn("class", rules.call_class(c("name"), c("lang"), c("strings"))).filter("class is not null")
    tag = lambda df, id_, tags, ord_: df.select(id_.alias("id"), F.explode(tags).alias("tag"), ord_.cast("long").alias("o"))
    tagged = tag(classed.filter("class <> 'ipc-server'"), c("from"), rules.call_tags(c("class"), c("strings")), c("ord") + 1000)
    env = facts.filter("fact = 'env'").join(from_id, ["file", "scope"], "left")
    tagged = tagged.unionByName(env.select(F.coalesce("from", "file").alias("id"), F.explode(F.array(F.lit("env"), F.concat(F.lit("env:"), "name"))).alias("tag"), (c("ord") + 1_000_000).alias("o")))
    marked = defs.select("id", F.explode(rules.mark_bindings(c("attrs"), c("name"))).alias("key"))
    by_call = classed.withColumn("key", rules.call_binding(c("class"), c("strings"))).filter("key is not null").select("file", "ord", "from", "key", F.regexp_replace(F.get("idents", F.lit(0)), r"^(?:Self::|self\.)", "").alias("handler"))
    handlers = by_call.join(known.select("file", c("key").alias("handler"), c("id").alias("h")), ["file", "handler"], "left").select(F.coalesce("h", "from").alias("id"), "key")
    servers = marked.unionByName(handlers).distinct()
    role = F.when(c("key").startswith("ipc:"), "ipc-server").otherwise("http-server")
    tagged = tagged.unionByName(servers.select("id", F.explode(F.array(role, c("key"))).alias("tag"), F.lit(0).cast("long").alias("o")))
    tags = tagged.groupBy("id", "tag").agg(F.min("o").alias("o")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda x: x["tag"]).alias("tags"))

    # flows: clients' keys against servers'
    clients = tagged.filter(c("tag").startswith("route:") | c("tag").startswith("ipc:")).select("id", c("tag").alias("key")).distinct()
    is_client = tagged.filter(c("tag").isin("http-client", "ipc-client")).select("id").distinct()
    clients = clients.join(is_client, "id", "left_semi")
    route = lambda df, name, id_: df.filter(c("key").startswith("route:")).select(c("id").alias(id_), F.substring("key", 7, 10_000).alias(name))
    a, b = route(clients, "client", "src"), route(servers, "server", "dst")
    pairs = matched(a.select(c("client").alias("route")).distinct(), b.select(c("server").alias("route")).distinct())
    http = pairs.join(a, "client").join(b, "server").select("src", "dst", F.concat(F.lit("http "), "server").alias("label"))
    ipc = clients.filter(c("key").startswith("ipc:")).select(c("id").alias("src"), "key").join(servers.select(c("id").alias("dst"), "key"), "key").select("src", "dst", F.concat(F.lit("ipc "), F.substring("key", 5, 10_000)).alias("label"))
    flows = http.unionByName(ipc).filter("src <> dst")

    none = F.array().cast("array<string>")
    node = lambda df, id_, kind, name, path, lang, parent, loc, external=False: df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), lang.cast("string").alias("lang"), parent.cast("string").alias("parent"), loc.cast("long").alias("loc"), F.lit(external).alias("external"))
    dirs = [p["dir"] for p in packs]
    nested = {d: max((x for x in dirs if x != d and (not x or d.startswith(x + "/"))), key=len, default=None) for d in dirs}
    pack_nodes = spark.createDataFrame([(f"package:{p['dir']}", p["name"], p["dir"], "repo" if nested[p["dir"]] is None else f"package:{nested[p['dir']]}") for p in packs], "id string, name string, path string, parent string")
    nodes = node(spark.range(1), F.lit("repo"), "repo", F.lit("repo"), F.lit(""), F.lit(None), F.lit(None), F.lit(0))
    nodes = nodes.unionByName(node(pack_nodes, c("id"), "package", c("name"), c("path"), F.lit(None), c("parent"), F.lit(0)))
    nodes = nodes.unionByName(node(outside.distinct().select("external", "lang").distinct(), external_id, "package", c("external"), F.concat(F.lit("external:"), "external"), c("lang"), F.lit("repo"), F.lit(0), True))
    nodes = nodes.unionByName(node(of_file, c("path"), "file", F.substring_index("path", "/", -1), c("path"), c("lang"), F.concat(F.lit("package:"), "dir"), c("loc")))
    nodes = nodes.unionByName(node(defs, c("id"), "symbol", c("name"), F.concat("file", F.lit("#"), "name"), c("lang"), c("file"), c("end") - c("start") + 1))
    nodes = nodes.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", none))

    edge = lambda df, src, dst, kind, label: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), label.cast("string").alias("label"))
    raw = edge(targets, c("file"), c("target"), "imports", F.lit(None)).unionByName(edge(outside, c("file"), external_id, "imports", F.lit(None)))
    raw = raw.unionByName(edge(resolved.filter(c("from") != c("to")), c("from"), c("to"), "calls", c("leaf"))).unionByName(edge(flows, c("src"), c("dst"), "flow", c("label")))
    raw = raw.unionByName(edge(nodes.filter("parent is not null"), c("parent"), c("id"), "contains", F.lit(None)))
    return Scan(nodes, raw.groupBy("src", "dst", "kind", "label").agg(F.count("*").alias("weight")), unresolved)
