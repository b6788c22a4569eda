"""A small shop in four languages, from sources to traces."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.builtins import builtin
from graphloom.operators import traces as R
from graphloom.sources.extract import expand_use, extract
from graphloom.sources.scan import scan, walk

SHOP = {
    "package.json": '{"name": "shop"}',
    "ui/package.json": '{"name": "shop-ui"}',
    "ui/src/client.ts": 'import { invoke } from "@shell/core";\n\nexport async function loadItems(): Promise<Item[]> {\n  const r = await fetch("/items");\n  return r.json();\n}\n\nexport async function loadItem(id: number) {\n  return fetch(`/items/${id}`);\n}\n\nexport const pack = (p: string) => invoke<string>("pack_box", { p });\n\nexport async function loadPrices() {\n  return fetch("/prices");\n}\n',
    "ui/src/page.ts": 'import { loadItems, pack } from "./client";\n\nexport async function start() {\n  const all = await loadItems();\n  await pack(import.meta.env.VITE_BOX);\n}\n',
    "back/pyproject.toml": '[project]\nname = "shop-back"\n',
    "back/app.py": 'import os\nfrom fastapi import FastAPI\nfrom parts.items import find_items\nfrom parts import mail\n\napp = FastAPI()\nURL = os.environ["SHOP_DB"]\n\n\n@app.get("/items")\ndef items():\n    return find_items()\n\n\n@app.get("/items/{item_id}")\ndef item(item_id: int):\n    mail.tell("x")\n    return find_items(item_id)\n\n\n@app.get("/alive")\ndef alive():\n    return 1\n',
    "back/parts/__init__.py": "",
    "back/parts/items.py": 'import sqlite3\n\n\ndef find_items(only=None):\n    c = sqlite3.connect("s.db")\n    return c.execute("SELECT 1")\n',
    "back/parts/mail.py": 'import os\n\n\ndef tell(name):\n    send.delay(name, os.environ.get("MAIL_URL"))\n\n\ndef send(name):\n    print(name)\n',
    "jobs/go.mod": "module shop.org/jobs\n",
    "jobs/main.go": 'package main\n\nimport (\n\t"net/http"\n\t"os"\n\n\t"shop.org/jobs/store"\n)\n\nfunc handle(w http.ResponseWriter, r *http.Request) {\n\tstore.All()\n}\n\nfunc main() {\n\thttp.HandleFunc("/boxes", handle)\n}\n',
    "jobs/store/store.go": 'package store\n\nimport "os"\n\ntype Box struct {\n\tID int\n}\n\nfunc open() *DB {\n\treturn sql.Open("pg", os.Getenv("SHOP_DB"))\n}\n\nfunc All() []Box {\n\tdb := open()\n\tdb.Query("SELECT 1")\n\treturn nil\n}\n',
    "shell/Cargo.toml": '[package]\nname = "shop-shell"\n',
    "shell/src/lib.rs": "mod boxes;\nmod cmds;\n\npub use cmds::pack_box;\n\npub fn run() {\n    boxes::sync();\n}\n",
    "shell/src/cmds.rs": "use crate::boxes::sync;\n\n#[tauri::command]\npub fn pack_box(p: String) -> String {\n    sync();\n    std::fs::read_to_string(&p).unwrap_or_default()\n}\n",
    "shell/src/boxes.rs": 'pub struct Box {\n    pub id: u32,\n}\n\nimpl Box {\n    pub fn all() -> Vec<Box> {\n        let _b = reqwest::blocking::get("http://localhost:1/boxes");\n        vec![]\n    }\n}\n\npub fn sync() {\n    let _x = Box::all();\n}\n',
    "ui/node_modules/x/index.js": "export function gone() {}\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in SHOP.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    s = scan(*walk(spark, str(root)))
    s.nodes, s.edges = s.nodes.cache(), s.edges.cache()
    return s


def edges(shop, kind):
    return {(r.src, r.dst, r.label) for r in shop.edges.filter(f"kind = '{kind}'").collect()}


def test_nodes(shop):
    rows = {r.id: r for r in shop.nodes.collect()}
    assert sum(r.kind == "file" for r in rows.values()) == 11
    assert {r.name for r in rows.values() if r.kind == "package" and not r.external} == {"shop", "shop-ui", "shop-back", "jobs", "shop-shell"}
    assert {i for i in rows if i.startswith("external:os:")} == {"external:os:python", "external:os:go"}
    assert rows["back/parts/__init__.py"].loc == 0 and rows["jobs/main.go"].parent == "package:jobs"
    tags = {i: set(r.tags) for i, r in rows.items()}
    assert "db" in tags["back/parts/items.py#find_items"] and "db" in tags["jobs/store/store.go#All"]
    assert "env:SHOP_DB" in tags["back/app.py"] and "env:SHOP_DB" in tags["jobs/store/store.go#open"] and "env:VITE_BOX" in tags["ui/src/page.ts#start"]
    assert "fs" in tags["shell/src/cmds.rs#pack_box"] and {"ipc-server", "ipc:pack_box"} <= tags["shell/src/cmds.rs#pack_box"]
    assert {"http-server", "route:/items/*"} <= tags["back/app.py#item"] and "queue" in tags["back/parts/mail.py#tell"]


def test_imports(shop):
    got = {(a, b) for a, b, _ in edges(shop, "imports")}
    assert {("back/app.py", "back/parts/items.py"), ("back/app.py", "back/parts/mail.py"), ("ui/src/page.ts", "ui/src/client.ts"), ("ui/src/client.ts", "external:@shell/core:typescript"), ("jobs/main.go", "jobs/store/store.go"), ("shell/src/lib.rs", "shell/src/cmds.rs"), ("shell/src/lib.rs", "shell/src/boxes.rs"), ("shell/src/cmds.rs", "shell/src/boxes.rs"), ("back/app.py", "external:fastapi:python")} <= got


def test_calls(shop):
    got = {(a.split("/")[-1], b.split("/")[-1]) for a, b, _ in edges(shop, "calls")}
    assert {("app.py#items", "items.py#find_items"), ("app.py#item", "mail.py#tell"), ("page.ts#start", "client.ts#loadItems"), ("page.ts#start", "client.ts#pack"), ("main.go#handle", "store.go#All"), ("store.go#All", "store.go#open"), ("boxes.rs#sync", "boxes.rs#Box::all"), ("cmds.rs#pack_box", "boxes.rs#sync"), ("lib.rs#run", "boxes.rs#sync")} <= got


def test_unresolved_leaves_out_what_languages_bring(spark, shop):
    got = {(r.file, r.callee) for r in shop.unresolved.collect()}
    assert ("jobs/store/store.go", "db.Query") in got and ("shell/src/boxes.rs", "reqwest::blocking::get") in got
    assert not {c for _, c in got} & {"print", "vec!", "vec"}
    calls = [("print", "python", True), ("x.append", "python", True), ("append", "python", False), ("vec!", "rust", True), ("a.b.clone", "rust", True), ("clone", "rust", False), ("Math.tan", "javascript", True), ("el.classList.add", "typescript", True), ("fetch", "typescript", False), ("mux.Close", "go", True), ("fmt.Sprint", "go", False), ("anything", "cobol", True), ("Some(x).y", "rust", True)]
    rows = spark.createDataFrame(calls, "callee string, lang string, want boolean").withColumn("got", builtin(F.col("callee"), F.col("lang"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_flows(shop):
    assert edges(shop, "flow") == {
        ("ui/src/client.ts#loadItems", "back/app.py#items", "http /items"), ("ui/src/client.ts#loadItem", "back/app.py#item", "http /items/*"),
        ("ui/src/client.ts#pack", "shell/src/cmds.rs#pack_box", "ipc pack_box"), ("shell/src/boxes.rs#Box::all", "jobs/main.go#handle", "http /boxes"),
    }


def test_endpoints_and_traces(shop):
    ends = {(r.key, r.status) for r in R.endpoints(shop.nodes, shop.edges).collect()}
    assert {("/items", "ok"), ("/boxes", "ok"), ("pack_box", "ok"), ("/items/*", "ok"), ("/alive", "no-callers"), ("/prices", "no-handler")} <= ends
    steps = R.traces(shop.nodes, shop.edges)
    top = R.summary(steps, shop.nodes).collect()
    assert top[0].entry == "ui/src/page.ts#start" and top[0].hops == 3 and top[0].langs == ["typescript", "python", "rust", "go"]
    assert {r.entry for r in top} >= {"ui/src/page.ts#start", "shell/src/lib.rs#run", "ui/src/client.ts#loadItem"}


def test_use_trees_and_broken_files():
    assert expand_use("crate::a::{b, c::{d, e as F}, self}") == ["crate::a::b", "crate::a::c::d", "crate::a::c::e", "crate::a::self"]
    for lang in ("python", "typescript", "javascript", "go", "rust"):
        for text in ("", "(((", "}}}}", "def f(:", 'fn x() { "', "`${", "import {", "class A {"):
            extract(text, lang)
