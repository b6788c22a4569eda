import itertools

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.chat_format import ROLES, STATES, Model, best_path, features, fit, parse, raw_lines, transfer


def random_model(r):
    lo = lambda *s: np.log(r.dirichlet(np.ones(s[-1]), s[:-1] or None))
    return Model(lo(STATES), lo(STATES, STATES), lo(STATES, 64))


def score(m, path, symbols):
    return m.start[path[0]] + sum(m.step[a, b] for a, b in zip(path, path[1:])) + sum(m.emit[p, s] for p, s in zip(path, symbols))


def test_best_path_equals_all_paths():
    r = np.random.default_rng(1)
    for _ in range(20):
        m, symbols = random_model(r), r.integers(0, 64, 5)
        want = max(itertools.product(range(STATES), repeat=5), key=lambda p: score(m, p, symbols))
        assert best_path(m, symbols, None, None).tolist() == list(want)
        assert abs(transfer(m, symbols, True)[0].max() - score(m, want, symbols)) < 1e-9


def spark_model(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = raw_lines(conv)
    return conv, lines, fit(lines.withColumn("symbol", features(F.col("line"))), conv)


def test_blocks_change_nothing_and_roles_come_back(spark):
    conv, lines, model = spark_model(spark)
    whole = {(r.conv_id, r.turn): (r.role, r.text, r.rendered) for r in parse(lines, model, 10**6).collect()}
    cut = {(r.conv_id, r.turn): (r.role, r.text, r.rendered) for r in parse(lines, model, 2).collect()}
    assert whole == cut
    # where every turn has a marker, roles and texts come back; elsewhere most do
    bare = {r.conv_id for r in lines.filter("line_no = 0").filter(F.trim("line") == F.col("line")).filter(~F.col("line").rlike("^###|^\\[|^(System|User|Assistant|Instructions|Q|A):")).collect()}
    truth = {(r.conv_id, r.turn): (r.role, r.text.strip()) for r in conv.collect()}
    marked = [k for k in truth if k[0] not in bare]
    right = sum(whole.get(k, (None,))[:2] == truth[k] for k in marked)
    assert len(marked) > 50 and right >= 0.98 * len(marked), (right, len(marked))
    assert sum(whole.get(k, (None,))[0] == v[0] for k, v in truth.items()) > 0.85 * len(truth)
    assert all(v[2].startswith("<|im_start|>" + v[0] + "\n") and v[2].endswith("<|im_end|>\n") for v in whole.values())
    # against one search over each transcript
    rows = {}
    for r in lines.withColumn("symbol", features(F.col("line"))).orderBy("conv_id", "ord", "line_no").collect():
        rows.setdefault(r.conv_id, []).append(r.symbol)
    for c, symbols in rows.items():
        path = best_path(model, np.array(symbols), None, None)
        assert [whole[(c, t)][0] for t in range(int((path % 2 == 0).sum()))] == [ROLES[p // 2] for p in path if p % 2 == 0]


def test_odd_rows(spark):
    _, _, model = spark_model(spark)
    rows = [(1, 0, 0, "User: hi"), (1, 0, 0, "User: hi"), (1, 1, 0, None), (1, 2, 0, "Assistant: " + "x" * 200000), (2, 0, 0, None), (None, 0, 0, "User: a"), (3, None, 0, "b"), (4, 5, 0, "")]
    df = spark.createDataFrame(rows, "conv_id long, ord long, line_no int, line string").selectExpr("*", "1 AS block", "2 AS symbol", "3 AS turn", "4 AS role")
    got = {(r.conv_id, r.turn): (r.role, len(r.text)) for r in parse(df, model).collect()}
    assert got[(1, 0)] == ("user", 2) and got[(1, 1)] == ("assistant", 200000) and {c for c, _ in got} == {1, 2, 4}
    assert parse(df.limit(0), model).count() == 0
    empty = fit(spark.createDataFrame([], "role string, first boolean, symbol int"), spark.createDataFrame([], "conv_id long, turn long, role string"))
    assert parse(df, empty).count() >= 3
