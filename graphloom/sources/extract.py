"""Facts of source files: imports, definitions, calls and environment names.

Python files are parsed with the standard library. TypeScript and JavaScript, Go and Rust go through one
scanner: comments and strings are blanked (their places kept), definitions are found by their heads and
closed by bracket matching, calls by names before a parenthesis. It tolerates broken files and does not
build a syntax tree, so calls of computed values are not seen.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

ENV = re.compile(r"process\.env\.([A-Z0-9_]+)|import\.meta\.env\.([A-Z0-9_]+)|os\.environ\[[\"']([A-Z0-9_]+)[\"']\]|process\.env\[[\"']([A-Z0-9_]+)[\"']\]")
MOST_STRINGS = 3
_KEYWORDS = set("if for while switch return func function match catch fn in of new await typeof else case defer go let const var import super def class".split())
_CALL = re.compile(r"(?<![\w$.:])([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*!?)(?:(?:::)?<[^<>()]*>)?\s*\(")


@dataclass
class Facts:
    imports: list[dict] = field(default_factory=list)
    defs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)

    def scope(self, line: int) -> int | None:
        """The innermost definition around a line: the shortest, the first of equals."""
        around = [(d["end"] - d["start"], k) for k, d in enumerate(self.defs) if d["start"] <= line <= d["end"]]
        return min(around)[1] if around else None


def blanked(src: str, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The source with comments and strings as spaces, and each string's place and text. A template's or format
    string's variable part ends its text with `*`."""
    out, found, i, n = list(src), [], 0, len(src)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two = src[i : i + 2]
        if two == "//":
            stop = src.find("\n", i)
            stop = n if stop < 0 else stop
            wipe(i, stop)
            i = stop
        elif two == "/*":
            stop = src.find("*/", i + 2)
            stop = n if stop < 0 else stop + 2
            wipe(i, stop)
            i = stop
        elif src[i] == '"' or (src[i] == "'" and lang in ("typescript", "javascript")) or (src[i] == "`" and lang != "rust"):
            quote, k = src[i], i + 1
            while k < n and src[k] != quote:
                k += 2 if src[k] == "\\" and not (quote == "`" and lang == "go") else 1
            text = src[i + 1 : k]
            if quote == "`" and "${" in text:
                text = text[: text.index("${")] + "*"
            found.append((i, k + 1, text))
            wipe(i, k + 1)
            i = k + 1
        elif src[i] == "'" and lang in ("rust", "go"):
            m = re.match(r"'(\\.[^']*|[^'\\])'", src[i : i + 12])
            stop = i + m.end() if m else i + 1
            wipe(i, stop if m else i)
            i = stop
        else:
            i += 1
    return "".join(out), found


def _close(code: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`, or the end."""
    pair = {"(": ")", "{": "}", "[": "]"}[code[at]]
    depth = 0
    for k in range(at, len(code)):
        if code[k] == code[at]:
            depth += 1
        elif code[k] == pair:
            depth -= 1
            if not depth:
                return k
    return len(code) - 1


def _span(code: str, at: int) -> int:
    """The end of a definition whose head begins at `at`: its body's closing brace, or its line."""
    k, depth = at, 0
    while k < len(code):
        c = code[k]
        if c in "([":
            k = _close(code, k)
        elif c == "{":
            return _close(code, k)
        elif c == ";" and not depth or c == "\n" and code[k + 1 : k + 2] == "\n":
            return k
        k += 1
    return len(code) - 1


_HEADS = {
    "typescript": [
        ("function", r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([\w$]+)"), ("class", r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)"),
        ("interface", r"(?m)^[ \t]*(?:export\s+)?interface\s+([\w$]+)"), ("type", r"(?m)^[ \t]*(?:export\s+)?(?:type|enum)\s+([\w$]+)"), ("function", r"(?m)^[ \t]*(?:export\s+)?(?:const|let)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
        ("const", r"(?m)^(?:export\s+)?const\s+([\w$]+)\b(?![\w$]|\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"),
    ],
    "go": [("function", r"(?m)^func\s+([A-Za-z_]\w*)\s*[\[(]"), ("method", r"(?m)^func\s+\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*(\w+)\s*\("), ("type", r"(?m)^type\s+(\w+)")],
    "rust": [("function", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("type", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type|union)\s+(\w+)"), ("const", r"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)\s*:"), ("module", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{")],
}
_HEADS["javascript"] = _HEADS["typescript"]


def _defs(src: str, code: str, lang: str, line_of) -> list[dict]:
    found = []
    owners = []
    if lang == "rust":
        for m in re.finditer(r"(?m)^[ \t]*impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?(\w+)[^{;]*\{", code):
            owners.append((m.start(), _close(code, m.end() - 1), f"{m[2]} as {m[1]}" if m[1] else m[2]))
    if lang in ("typescript", "javascript"):
        for m in re.finditer(r"(?m)\bclass\s+([\w$]+)[^{]*\{", code):
            end = _close(code, m.end() - 1)
            owners.append((m.start(), end, m[1]))
            for x in re.finditer(r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|override)\s+)*([\w$]+)\s*(?:<[^>]*>)?\([^)]*\)[^;{\n]*\{", code[m.end() : end]):
                if x[1] not in _KEYWORDS:
                    at = m.end() + x.start()
                    found.append((at, _span(code, at), "method", f"{m[1]}.{x[1]}"))
    for kind, pattern in _HEADS[lang]:
        for m in re.finditer(pattern, code):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            name = f"{m[1]}.{m[2]}" if kind == "method" else m[1]
            own = [o for o in owners if o[0] < at < o[1]]
            if own and lang == "rust" and kind == "function":
                kind_, name = "method", f"{own[-1][2]}::{name}"
            else:
                kind_ = kind
            found.append((at, _span(code, m.end()), kind_, name))
    out = []
    for at, end, kind, name in sorted(set(found)):
        attrs, before = [], src[:at].rstrip()
        while True:  # attributes and decorators on the lines above
            m = re.search(r"(?:^|\n)[ \t]*(#\[[^\n]*\]|@[^\n]+)$", before)
            if not m:
                break
            attrs.insert(0, m[1])
            before = before[: m.start()].rstrip()
        out.append({"name": name, "kind": kind, "start": line_of(at), "end": line_of(end), "attrs": attrs})
    return out


def _calls(code: str, strings: list[tuple[int, int, str]], line_of) -> list[dict]:
    out = []
    for m in _CALL.finditer(code):
        name = m[1]
        head = code[: m.start()].rstrip()
        if name in _KEYWORDS or re.search(r"(?:\bfunction|\bfunc|\bfn|\bclass|\)\s*\*?)$", head[-12:]) and head.endswith(("function", "func", "fn", "class")):
            continue
        end = _close(code, m.end() - 1)
        texts = [t for a, b, t in strings if m.end() <= a < end][:MOST_STRINGS]
        idents = re.findall(r"(?<![\w$.:\"])([A-Za-z_$][\w$]*(?:::[\w$]+)*)(?=\s*(?:,|$))", code[m.end() : end])
        out.append({"callee": name, "leaf": re.split(r"\.|::", name)[-1], "line": line_of(m.start()), "strings": texts, "idents": idents})
    return out


def expand_use(tree: str) -> list[str]:
    """`a::{b, c::{d, e as F}, self}` as flat paths, aliases dropped."""
    tree = tree.strip()
    at = tree.find("{")
    if at < 0:
        return [re.split(r"\s+as\s+", tree)[0].strip()] if tree else []
    head, inner, depth, parts, last = tree[:at], tree[at + 1 : tree.rfind("}")], 0, [], 0
    for k, c in enumerate(inner):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(inner[last:k])
            last = k + 1
    parts.append(inner[last:])
    return [head + x for p in parts if p.strip() for x in expand_use(p)]


def _imports(code: str, src: str, strings: list[tuple[int, int, str]], lang: str, line_of) -> list[dict]:
    out = []
    text_at = {a: t for a, _, t in strings}
    if lang in ("typescript", "javascript"):
        for m in re.finditer(r"(?m)^[ \t]*(?:import|export)\b([^;'\"]*?)(?:\bfrom\s*)?(?=['\"])", src):
            if m.end() in text_at:
                names = re.findall(r"(?:(?<=[{,\s]))(?:type\s+)?([A-Za-z_$][\w$]*)(?:\s+as\s+[\w$]+)?(?=\s*[,}])|^\s*([A-Za-z_$][\w$]*)\s*(?:,|$)", re.sub(r"\bfrom\s*$|^\s*type\s", " ", m[1]))
                out.append({"module": text_at[m.end()], "names": [a or b for a, b in names if (a or b) != "from"], "line": line_of(m.start())})
        for m in re.finditer(r"\b(?:require|import)\s*\(\s*", code):
            if m.end() in text_at:
                out.append({"module": text_at[m.end()], "names": [], "line": line_of(m.start())})
    elif lang == "go":
        for m in re.finditer(r"(?m)^import\s*(\()?", code):
            stop = _close(code, m.end() - 1) if m[1] else (code.find("\n", m.end()) + 1 or len(code))
            for a, _, t in strings:
                if m.end() <= a < stop:
                    out.append({"module": t, "names": [t.split("/")[-1]], "line": line_of(a)})
    elif lang == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code):
            for path in expand_use(re.sub(r"\s+", " ", m[1])):
                out.append({"module": path, "names": [path.split("::")[-1]], "line": line_of(m.start())})
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", code):
            out.append({"module": f"mod:{m[1]}", "names": [m[1]], "line": line_of(m.start())})
    return sorted(out, key=lambda x: x["line"])


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else f"().{node.attr}" if isinstance(node.value, ast.Call) else None
    return None


def _python(src: str) -> Facts:
    facts, tree = Facts(), ast.parse(src)

    def defs(body: list[ast.stmt], owner: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{n.name}" if owner else n.name
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if owner else "function"
                facts.defs.append({"name": name, "kind": kind, "start": n.lineno, "end": n.end_lineno, "attrs": [ast.unparse(d) for d in n.decorator_list]})
                defs(n.body, name if kind == "class" else owner)
            elif hasattr(n, "body"):
                defs(n.body, owner)

    defs(tree.body, "")
    marks = {id(x) for n in ast.walk(tree) for d in getattr(n, "decorator_list", []) for x in ast.walk(d)}
    for n in ast.walk(tree):
        if id(n) in marks:  # decorators tell of their definition and are not calls
            continue
        if isinstance(n, ast.Import):
            facts.imports += [{"module": a.name, "names": [a.asname or a.name.split(".")[0]], "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            facts.imports += [{"module": "." * n.level + (n.module or ""), "names": [a.name], "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.Call) and (name := _dotted(n.func)):
            texts, idents = [], []
            for a in [*n.args, *(k.value for k in n.keywords)]:
                if isinstance(a, ast.Constant) and isinstance(a.value, str):
                    texts.append(a.value)
                elif isinstance(a, ast.JoinedStr):
                    first = a.values[0] if a.values else None
                    texts.append((first.value if isinstance(first, ast.Constant) else "") + "*")
                elif isinstance(a, ast.Name):
                    idents.append(a.id)
            facts.calls.append({"callee": name, "leaf": name.split(".")[-1], "line": n.lineno, "strings": texts[:MOST_STRINGS], "idents": idents})
    facts.imports.sort(key=lambda x: x["line"])
    facts.calls.sort(key=lambda x: x["line"])
    return facts


def extract(src: str, lang: str) -> Facts:
    if lang == "python":
        try:
            return _python(src)
        except (SyntaxError, ValueError, RecursionError):
            return Facts()
    code, strings = blanked(src, lang)
    starts = [0] + [k + 1 for k, c in enumerate(src) if c == "\n"]
    import bisect

    line_of = lambda at: bisect.bisect_right(starts, at)
    facts = Facts(_imports(code, src, strings, lang, line_of), _defs(src, code, lang, line_of))
    facts.calls = _calls(code, strings, line_of)
    return facts


def environment(src: str) -> list[tuple[int, str]]:
    return [(k, next(filter(None, m.groups()))) for k, line in enumerate(src.split("\n"), 1) for m in ENV.finditer(line)]
