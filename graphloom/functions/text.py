"""Scalar rules over paths, routes and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go"}
PARAMETER = r"^[:*$].*|^\{.*\}$|^<.*>$|^[0-9]+$|.*\*.*"


def normalize_route(raw: Column) -> Column:
    """The path of a URL or route with parameters as `*`; null if it is none."""
    s = F.trim(raw)
    path = F.when(F.contains(s, F.lit("://")), F.coalesce(F.nullif(F.regexp_extract(s, r"://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))).otherwise(s)
    cut = F.regexp_extract(path, r"^([^?#]*)", 1)
    parts = F.transform(F.split(cut, "/"), lambda x: F.when(F.trim(x).rlike(PARAMETER), "*").otherwise(F.trim(x)))
    out = F.array_join(parts, "/")
    out = F.coalesce(F.nullif(F.regexp_replace(out, r"/+$", ""), F.lit("")), F.lit("/"))
    return F.when((s != "") & path.startswith("/"), out)


def routes_match(a: Column, b: Column) -> Column:
    """Whether two normalised routes fit: equal or `*` part by part; a trailing `*` of the shorter takes the rest."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = lambda p, q: (p == q) | (p == "*") | (q == "*")
    n = F.least(F.size(x), F.size(y))
    equal = F.forall(F.zip_with(x, y, same), lambda v: v)
    shorter = F.when(F.size(x) < F.size(y), x).otherwise(y)
    prefix = F.forall(F.zip_with(F.slice(x, 1, n - 1), F.slice(y, 1, n - 1), same), lambda v: v)
    return F.when(F.size(x) == F.size(y), equal).otherwise((F.element_at(shorter, -1) == "*") & prefix)


def slug(name: Column) -> Column:
    small = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(small, "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("x"))


def title_case(name: Column) -> Column:
    words = F.filter(F.split(name, "[-_ ]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def language(path: Column) -> Column:
    """By what follows the last dot of the whole path; a path without a dot is its own extension."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.element_at(F.split(path, r"\."), -1))


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\f\r]"))).cast("long")


def minified(text: Column) -> Column:
    size, lines = F.octet_length(text), F.greatest(F.length(text) - F.length(F.replace(text, F.lit("\n"))), F.lit(1))
    return (size >= 4096) & (F.floor(size / lines) > 400)


def stem(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^([^.]*)", 1)
