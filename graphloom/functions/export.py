"""Text forms of results: compact tables (TOON), sequence diagrams (Mermaid) and models (Structurizr).

Models and diagrams have a size that people read, so rows are gathered in order and formatted here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identifier(name: Column) -> Column:
    """ASCII letters, digits and underscores, not beginning with a digit."""
    flat = F.regexp_replace(name, "[^A-Za-z0-9]", "_")
    return F.when(flat.rlike("^[0-9]"), F.concat(F.lit("_"), flat)).otherwise(flat)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def mermaid(messages: DataFrame, names: DataFrame, title: str, summary: str) -> str:
    """One journey as a sequence diagram: messages (ord, src, dst, label, kind, source), names (id, name).
    Participants come in the order in which they first appear; claimed messages are marked."""
    ends = messages.select(F.col("src").alias("id"), (F.col("ord") * 2).alias("o")).unionByName(messages.select(F.col("dst").alias("id"), (F.col("ord") * 2 + 1).alias("o")))
    who = ends.groupBy("id").agg(F.min("o").alias("o")).join(names, "id", "left")
    kind = F.when(F.col("id").startswith("p:"), "actor").otherwise("participant")
    heads = who.select("o", F.concat(F.lit("    "), kind, F.lit(" "), identifier(F.col("id")), F.lit(" as "), F.replace(F.coalesce("name", "id"), F.lit('"'), F.lit("'"))).alias("line")).orderBy("o")
    arrow = F.when(F.col("kind") == "return", "-->>").otherwise("->>")
    mark = F.when(F.col("source") == "claimed", " (claimed)").otherwise("")
    body = messages.select("ord", F.concat(F.lit("    "), identifier(F.col("src")), F.lit(" "), arrow, F.lit(" "), identifier(F.col("dst")), F.lit(": "), F.replace("label", F.lit(":"), F.lit(" -")), mark).alias("line")).orderBy("ord")
    return "\n".join(["sequenceDiagram", f"    %% {title}: {summary}", *(r.line for r in heads.collect()), *(r.line for r in body.collect())]) + "\n"


def structurizr(system: tuple[str, str], containers: DataFrame, components: DataFrame, relationships: DataFrame) -> str:
    """A model as Structurizr DSL: containers (ord, id, name, description, technology), components (container,
    ord, id, name), relationships (src, dst, label, source)."""
    esc = lambda s: '"' + (s or "").replace("\\", "\\\\").replace('"', '\\"') + '"'
    inner: dict[str, list[str]] = {}
    for r in components.orderBy("container", "ord").select("container", F.concat(identifier(F.col("id")), F.lit(" = component "), quoted(F.col("name"))).alias("line")).collect():
        inner.setdefault(r.container, []).append(r.line)
    boxes = containers.orderBy("ord").select("id", identifier(F.col("id")).alias("i"), F.concat(identifier(F.col("id")), F.lit(" = container "), quoted(F.col("name")), F.lit(" "), quoted(F.col("description")), F.lit(" "), quoted(F.col("technology"))).alias("line")).collect()
    links = relationships.orderBy("src", "dst").select(F.concat(identifier(F.col("src")), F.lit(" -> "), identifier(F.col("dst")), F.lit(" "), quoted(F.col("label")), F.when(F.col("source") == "claimed", F.lit(' "claimed"')).otherwise("")).alias("line")).collect()
    out = [f"workspace {esc(system[0])} {esc(system[1])} {{", "    model {", f"        s = softwareSystem {esc(system[0])} {esc(system[1])} {{"]
    for b in boxes:
        out += [f"            {b.line} {{", *(f"                {x}" for x in inner.get(b.id, [])), "            }"]
    out += ["        }", *(f"        {x.line}" for x in links), "    }", "    views {"]
    for head in ["systemContext s", "container s", *(f"component {b.i}" for b in boxes)]:
        out += [f"        {head} {{", "            include *", "            autolayout tb", "        }"]
    return "\n".join([*out, "    }", "}"]) + "\n"


def _text(s: str) -> str:
    return '"' + s.translate({34: '\\"', 92: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t"}) + '"'


def _scalar(v: object) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if not isinstance(v, str):
        return repr(v)
    odd = not v or v != v.strip() or re.search(r'[,:"\n\r\t\[\]{}]', v) or v.startswith("-") or v in ("true", "false", "null")
    try:
        odd = odd or float(v) is not None
    except ValueError:
        pass
    return _text(v) if odd else v


def toon(value: dict, depth: int = 0) -> str:
    """A dict as TOON: lists of flat dicts with equal keys become tables, lists of scalars one line."""
    out, pad = [], "  " * depth
    flat = lambda v: not isinstance(v, (dict, list))
    for k, v in value.items():
        name = _text(k) if not k or re.search(r'[\s:,"\[\]{}]', k) else k
        if flat(v):
            out.append(f"{pad}{name}: {_scalar(v)}")
        elif isinstance(v, dict):
            out += [f"{pad}{name}:", toon(v, depth + 1).rstrip("\n")] if v else [f"{pad}{name}:"]
        elif all(map(flat, v)):
            out.append(f"{pad}{name}[{len(v)}]:" + (" " + ",".join(map(_scalar, v)) if v else ""))
        elif all(isinstance(x, dict) and list(x) == list(v[0]) and all(map(flat, x.values())) for x in v):
            keys = list(v[0])
            out.append(f"{pad}{name}[{len(v)}]{{{','.join(keys)}}}:")
            out += [f"{pad}  " + ",".join(_scalar(x[c]) for c in keys) for x in v]
        else:
            out.append(f"{pad}{name}[{len(v)}]:")
            for x in v:
                lines = toon(x, depth + 2).rstrip("\n") if isinstance(x, dict) else "  " * (depth + 2) + _scalar(x)
                out.append(f"{pad}  - " + lines[2 * (depth + 2) :])
    return "\n".join(out) + "\n"


def table(df: DataFrame, name: str, limit: int = 40) -> str:
    """The first rows of df as TOON, with how many there are."""
    total, rows = df.count(), df.limit(limit).collect()
    return toon({"count": f"{len(rows)} of {total}", name: [r.asDict(recursive=True) for r in rows]})
