"""A source tree as tables: the driver lists names, joins decide what ignore files leave out, tasks read texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 10_000
BATCH_FILES = 64
# Files with rules, the later the stronger, and the folder that makes a tree a repository.
IGNORE_FILES = ("exclude", ".gitignore", ".ignore")
REPOSITORY = ".git"


def listing(root: str, skipped: tuple[str, ...]) -> tuple[list[tuple[str, int]], list[tuple[str, int, str]]]:
    """(path, bytes) of the files below a local folder but hidden ones, links and what lies in skipped folders; and
    (dir, rank, text) of its ignore files. Those of a repository count only if the folder is in one; `exclude`
    is the one of a repository at the root."""
    paths, rules = [], []
    above = os.path.abspath(root)
    while not (within := os.path.exists(os.path.join(above, REPOSITORY))) and above != os.path.dirname(above):
        above = os.path.dirname(above)

    def rule_file(full: str, at: str) -> None:
        if os.path.isfile(full) and (within or full.endswith(".ignore")):
            with open(full, encoding="utf-8", errors="replace") as f:
                rules.append((at, IGNORE_FILES.index(os.path.basename(full)), f.read()))

    rule_file(os.path.join(root, REPOSITORY, "info", "exclude"), "")
    for at, dirs, names in os.walk(root):
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        for name in IGNORE_FILES[1:]:
            if name in names:
                rule_file(os.path.join(at, name), rel)
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in skipped and not os.path.islink(os.path.join(at, d)))
        paths += [(f"{rel}/{n}" if rel else n, os.path.getsize(os.path.join(at, n))) for n in sorted(names) if not n.startswith(".") and os.path.isfile(os.path.join(at, n)) and not os.path.islink(os.path.join(at, n))]
    return paths, rules


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(pattern as a regular expression over paths below the rule's folder, negated, folders only); None for a
    blank line, a comment, or a pattern that is not well formed."""
    line = re.sub(r"(?<!\\) +\Z", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + len(re.match(r"\*+", line[i:])[0])
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", line[i:])):
            inner = re.sub(r"([\[\]&~^\\])", r"\\\1", m[2].replace("\\", ""))
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", i + len(m[0])
        elif c == "[" or (c == "\\" and i + 1 == len(line)):
            return None
        else:
            i += c == "\\"
            out, i = out + re.sub(r"([^\w\s/])", r"\\\1", line[i]), i + 1
    return f"(?s)\\A{out}\\z", negated, folders


def rules(files: DataFrame) -> DataFrame:
    """(dir, rank, ord, regex, negated, folders): the rules of ignore files (dir, rank, text), a null text none."""
    read = F.udf(rule, "regex string, negated boolean, folders boolean")
    lines = files.select("dir", "rank", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return lines.select("dir", "rank", "ord", read("line").alias("r")).filter("r is not null").select("dir", "rank", "ord", "r.*")


def _below(path: Column, dir: Column) -> Column:
    return F.when(dir == "", path).otherwise(F.substr(path, F.length(dir) + 2))


def not_ignored(paths: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of paths (path, ...) that no rule of known (see rules()) leaves out.

    A file or folder goes by the rule that matches it last: of the strongest kind of file, then of the deepest
    folder, then of the lowest line; a rule with `!` keeps it. What lies in a folder that goes, goes too. A null
    path stays. Each folder is looked at once, whatever it holds: paths become their folders and themselves,
    these meet the rules of the folders above them, an equi-join on the folder, and verdicts are joined back.
    Rules are broadcast up to BROADCAST_RULES.
    """
    parts = F.split("path", "/")
    many = F.size(parts)
    chain = F.transform(F.sequence(F.lit(1), many), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("item"), (k < many).alias("folder")))
    items = paths.filter("path is not null").select(F.inline(chain)).distinct()
    own = F.split("item", "/")
    above = items.select("item", "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.array_join(F.slice(own, 1, k), "/"))).alias("dir"))
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = above.join(F.broadcast(known) if few else known, "dir").filter((F.col("folder") | ~F.col("folders")) & F.rlike(_below(F.col("item"), F.col("dir")), F.col("regex")))
    order = F.struct("rank", F.length("dir"), "ord")
    gone = hits.groupBy("item", "folder").agg(F.max_by("negated", order).alias("kept")).filter("not kept").select("item", "folder")
    lost = paths.filter("path is not null").select("path", F.inline(chain)).join(gone, ["item", "folder"]).select("path").distinct()
    return paths.join(lost, "path", "left_anti")


def read(paths: DataFrame, root: str) -> DataFrame:
    """(path, text) of the files of paths below root, read by the tasks, which must see root; a file that is gone
    by then has a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BATCH_FILES):
                out = []
                for path in batch["path"].iloc[i : i + BATCH_FILES]:
                    try:
                        with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                            out.append((path, f.read()))
                    except FileNotFoundError:
                        out.append((path, None))
                yield pd.DataFrame(out, columns=["path", "text"])

    return paths.select("path").mapInPandas(run, "path string, text string")


def files(spark: SparkSession, root: str, skipped: tuple[str, ...]) -> DataFrame:
    """(path, bytes) of all files below root that no ignore file leaves out."""
    paths, texts = listing(root, skipped)
    found = spark.createDataFrame(paths, "path string, bytes long")
    return not_ignored(found, rules(spark.createDataFrame(texts, "dir string, rank int, text string"))) if texts else found
