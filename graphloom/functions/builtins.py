"""Callees that a language brings along, which no file of a source tree defines."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Callees(NamedTuple):
    """Whole names, last parts (behind a dot), and beginnings."""

    names: tuple[str, ...]
    endings: tuple[str, ...]
    beginnings: tuple[str, ...]


# What each language brings along.
RUST = Callees(
    names=(
        "println", "eprintln", "print", "eprint", "format", "vec", "assert", "assert_eq", "assert_ne", "debug_assert", "panic", "todo",
        "unimplemented", "unreachable", "matches", "write", "writeln", "Some", "Ok", "Err", "Box::new", "String::from", "Vec::new",
        "Vec::with_capacity", "HashMap::new", "HashSet::new", "Default::default", "drop", "dbg", "include_str", "include_bytes", "cfg", "concat",
        "stringify", "env", "option_env", "thread_local", "info", "warn", "error", "debug", "trace",
    ),
    endings=(
        "clone", "to_string", "unwrap", "into", "len", "iter", "collect", "map", "as_ref", "to_owned", "push", "get", "expect", "as_str", "is_empty",
        "unwrap_or", "unwrap_or_default", "to_vec", "contains", "join", "starts_with", "ends_with", "trim", "lock", "await", "and_then", "ok",
        "insert", "filter", "find", "sort", "cloned", "copied", "unwrap_or_else", "map_err", "ok_or", "unwrap_err", "entry",
    ),
    beginnings=(
        "Some(",
    ),
)
SCRIPT = Callees(
    names=(
        "parseInt", "parseFloat", "String", "Number", "Boolean", "Array.isArray", "Object.keys", "Object.values", "Object.entries", "Object.assign",
        "Object.freeze", "JSON.parse", "JSON.stringify", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "requestAnimationFrame",
        "cancelAnimationFrame", "Promise.all", "Promise.resolve", "Promise.reject", "Error", "Date.now", "performance.now", "Symbol", "Map", "Set",
        "Array.from", "isNaN", "document.getElementById", "document.querySelector", "document.querySelectorAll", "document.createElement",
        "Number.isFinite", "structuredClone", "encodeURIComponent", "decodeURIComponent", "btoa", "atob",
    ),
    endings=(
        "push", "map", "filter", "forEach", "reduce", "find", "some", "every", "join", "split", "slice", "splice", "indexOf", "includes", "toString",
        "toFixed", "trim", "toLowerCase", "toUpperCase", "get", "set", "has", "delete", "add", "keys", "values", "entries", "sort", "concat",
        "addEventListener", "removeEventListener", "appendChild", "querySelector", "querySelectorAll", "setAttribute", "classList.add",
        "classList.remove", "classList.toggle", "then", "catch", "finally", "bind", "call", "apply", "startsWith", "endsWith", "replace", "padStart",
        "padEnd", "fill", "flat", "flatMap", "at", "pop", "shift", "unshift", "reverse", "localeCompare", "charCodeAt", "substring", "preventDefault",
        "stopPropagation", "focus", "blur", "remove", "getBoundingClientRect", "closest", "matches", "clear", "now",
    ),
    beginnings=(
        "gl.", "ctx.", "Math.", "console.",
    ),
)
PYTHON = Callees(
    names=(
        "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "isinstance", "enumerate", "zip", "map", "filter", "sorted",
        "reversed", "min", "max", "sum", "abs", "any", "all", "open", "iter", "next", "getattr", "setattr", "hasattr", "super", "type", "id", "hash",
        "repr", "format", "input", "round", "bool", "bytes", "ord", "chr", "vars", "dir", "property", "staticmethod", "classmethod", "Exception",
        "ValueError", "TypeError", "KeyError", "RuntimeError", "frozenset", "object", "dataclass", "field", "logging.getLogger", "logger.info",
        "logger.debug", "logger.warning", "logger.error", "logger.exception",
    ),
    endings=(
        "append", "extend", "get", "items", "keys", "values", "join", "split", "strip", "format", "update", "pop", "lower", "upper", "startswith",
        "endswith", "replace", "encode", "decode", "add", "remove", "sort", "copy", "setdefault", "index", "count", "isoformat", "strftime", "dict",
        "json", "model_dump",
    ),
    beginnings=(),
)
GO = Callees(
    names=(
        "len", "cap", "make", "new", "append", "copy", "delete", "panic", "recover", "print", "println", "close", "string", "int", "int64", "float64",
        "byte", "error", "errors.New", "fmt.Println", "fmt.Printf", "fmt.Sprintf", "fmt.Errorf", "fmt.Fprintf", "fmt.Print", "log.Println",
        "log.Printf", "log.Fatal", "log.Fatalf", "log.Fatalln", "strings.Split", "strings.Join", "strings.TrimSpace", "strings.HasPrefix",
        "strings.HasSuffix", "strings.Contains", "strconv.Itoa", "strconv.Atoi", "time.Now", "time.Since", "context.Background", "context.WithCancel",
        "context.WithTimeout", "json.Marshal", "json.Unmarshal", "json.NewEncoder", "json.NewDecoder", "sync.WaitGroup", "defer",
    ),
    endings=(
        "Error", "String", "Lock", "Unlock", "Done", "Add", "Wait", "Close", "Write", "WriteHeader", "Header", "Encode", "Decode", "Err", "Context",
        "Printf", "Println",
    ),
    beginnings=(),
)
BY_LANGUAGE = {"rust": RUST, "typescript": SCRIPT, "javascript": SCRIPT, "python": PYTHON, "go": GO}


def pattern(callees: Callees) -> str:
    """One expression for the three tables of a language."""
    one = lambda names: "|".join(map(re.escape, names))
    found = [f"^({one(callees.names)})\\z", f"\\.({one(callees.endings)})\\z"] + ([f"^({one(callees.beginnings)})"] if callees.beginnings else [])
    return "|".join(found)


def builtin(callee: Column, lang: Column) -> Column:
    """Whether a call needs no definition in the sources; in a language without tables none does. Marks of macros at the end
    do not count."""
    name = F.regexp_replace(callee, r"!+\z", "")
    out = None
    for language, callees in BY_LANGUAGE.items():
        fits = name.rlike(pattern(callees))
        out = F.when(lang == language, fits) if out is None else out.when(lang == language, fits)
    return out.otherwise(True)
