import pytest

from graphloom.functions import export
from graphloom.sources import store


def test_toon():
    ports = [{"port": "8080", "up": True, "note": "-"}, {"port": "tcp/9", "up": None, "note": "a: b"}]
    assert export.toon({"ports": ports}) == 'ports[2]{port,up,note}:\n  "8080",true,"-"\n  tcp/9,null,"a: b"\n'
    assert export.toon({"odd key": "", "pad": " x", "tab": "a\tb", "word": "nulls", "is": "null"}) == '"odd key": ""\npad: " x"\ntab: "a\\tb"\nword: nulls\nis: "null"\n'
    assert export.toon({"outer": {"none": [], "mixed": [{"k": 1.5}, {"k": 2, "deep": {"z": "q"}}, "end"]}}) == "outer:\n  none[0]:\n  mixed[3]:\n    - k: 1.5\n    - k: 2\n      deep:\n        z: q\n    - end\n"


def test_diagrams(spark):
    m = spark.createDataFrame([(0, "p:you", "c:web", "open: it", "call", "code"), (1, "c:web", "c:api", "get", "http", "claimed"), (2, "c:api", "c:web", "", "return", "code")], "ord int, src string, dst string, label string, kind string, source string")
    names = spark.createDataFrame([("c:web", 'The "web"'), ("c:api", "Api")], "id string, name string")
    assert export.mermaid(m, names, "J", "s").splitlines() == ["sequenceDiagram", "    %% J: s", "    actor p_you as p:you", "    participant c_web as The 'web'", "    participant c_api as Api", "    p_you ->> c_web: open - it", "    c_web ->> c_api: get (claimed)", "    c_api -->> c_web: "]
    boxes = spark.createDataFrame([(0, "c:web", 'W"', "d", "t")], "ord int, id string, name string, description string, technology string")
    parts = spark.createDataFrame([("c:web", 0, "c:web/core", "Core")], "container string, ord int, id string, name string")
    links = spark.createDataFrame([("c:web", "x:db", "uses", "claimed")], "src string, dst string, label string, source string")
    text = export.structurizr(("S", "p"), boxes, parts, links)
    assert '            c_web = container "W\\"" "d" "t" {\n                c_web_core = component "Core"' in text and '        c_web -> x_db "uses" "claimed"' in text and text.count("{") == text.count("}")


def test_store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "file"), ("a#f", "symbol")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "flow", 1)], "src string, dst string, kind string, weight int")
    base = str(tmp_path / "g")
    folder = store.save(nodes, edges, base, "/r/one", "2024-01-01T00:00:00Z")
    store.save(nodes, edges, base, "/r/one/in", "2024-02-01T00:00:00Z")
    n, e = store.load(spark, folder)
    assert sorted(r.id for r in n.collect()) == ["a", "a#f"] and e.count() == 1
    entries = store.catalogue(spark, base)
    assert [(r.root, r.files, r.symbols, r.flows) for r in entries.collect()] == [("/r/one/in", 1, 1, 1), ("/r/one", 1, 1, 1)]
    assert entries.filter("root = '/r/one'").first()["folder"] == folder
    got = store.nearest(entries, spark.createDataFrame([("/r/one/x",), ("/r/one/in/y",), ("/q",)], "path string")).collect()
    assert {(r.path, r.root) for r in got} == {("/r/one/x", "/r/one"), ("/r/one/in/y", "/r/one/in")}
    spark.createDataFrame([(9,)], "version int").write.mode("overwrite").parquet(f"{folder}/meta")
    with pytest.raises(ValueError):
        store.load(spark, folder)
