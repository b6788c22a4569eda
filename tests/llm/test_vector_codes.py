import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import vector_codes as V
from tests.llm.oracle import rows, sql_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(table, entries=64, parts=16, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: k[:2]):
        first.setdefault(i, v)
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for v in list(first.values())[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, p: min((far(part, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        put = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                put[p][near(part, p)[1]].append(part)
        books = [[[sum(c) // len(ps) for c in zip(*ps, strict=True)] if ps else books[p][e] for e, ps in enumerate(put[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, g in kept:
        found = [near(part, p) for p, part in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), g))
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == g), digest) for i, c, e, g in out), key=str)


def run(spark, table, **how):
    got = V.vector_codes(spark.createDataFrame(table, SCHEMA), **how)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 7), st.integers(1, 60), st.integers(0, 9999))
def test_nearest_equals_a_full_search(k, d, n, seed):
    r = np.random.default_rng(seed)
    book, x = r.integers(-4, 5, (k, d)), r.integers(-6, 7, (n, d))
    all_far = ((x[:, None] - book[None]) ** 2).sum(2)
    index, best = V.nearest(x, book)
    assert (index == all_far.argmin(1)).all() and (best == all_far.min(1)).all()


def test_equals_brute_force_with_odd_rows(spark):
    r = random.Random(3)
    table = [(i, [r.choice([-1.0, -0.51, -0.001, 0.0, 0.25, 0.7, 1.3]) for _ in range(32)], r.choice([None, 1, 1, 2])) for i in range(150)]
    table += [(3, table[3][1], 2), (3, table[3][1], 2), (4, table[9][1], None), (None, table[5][1], 1)]
    odd = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [0.0] * 31 + [float("inf")], 1), (-5, [0.0] * 31 + [None], 2)]
    assert run(spark, table + odd) == brute(table + odd)
    assert run(spark, table[:5] + odd) == brute(table[:5] + odd)  # fewer ids than entries


def test_vectors_that_cannot_be_coded(spark):
    table = [(i, [float(i)] * 16, 1) for i in range(1, 4)]
    odd = [(0, [], 1), (7, [1.0] * 32, 1), (8, [1.0] * 5, 2), (9, [1e30] * 16, 1)]
    got = run(spark, table + odd)
    want = {g[0]: g for g in brute(table)}
    assert {g[0]: g for g in got if g[1] is not None} == want
    assert {(g[0], g[2], g[3]) for g in got if g[1] is None} == {(0, None, 0), (7, None, 0), (8, None, None), (9, None, 0)}
    assert {g[:3] for g in run(spark, odd[:1])} == {(0, None, None)}
    assert run(spark, []) == []


def test_extra_columns_and_other_names(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, 1, 2, "x")], "id long, vec array<double>, error int, code int, slot string")
    r = V.vector_codes(df, "id", "vec", "error").collect()[0]
    assert (r.vec_id, r.code, r.error, r.label_error) == (1, "00" * 16, 0, 0)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    assert rows(V.vector_codes(spark.read.parquet(f"{sf}/embeddings.parquet"))) == sql_rows(V.ORACLE, sf)
