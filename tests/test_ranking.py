"""Picks of traces in rounds against a plain greedy walk."""

import random

from graphloom.operators import atlas as A

SCHEMA = "trace long, known boolean, start string, boundaries array<string>, packages array<string>, hops long, langs long, steps long"


def greedy(rows, k):
    left, starts, bounds, packs, out = {r[0]: r for r in rows}, [], set(), set(), []
    while left and len(out) < k:
        best = max(left.values(), key=lambda r: (6 * bool(r[1]) + 5 * (r[2] not in starts) + 4 * len(set(r[3] or []) - bounds) + 2 * len(set(r[4] or []) - packs), r[5], r[6], r[7], -r[0]))
        del left[best[0]]
        starts.append(best[2])
        bounds |= set(best[3] or [])
        packs |= set(best[4] or [])
        out.append((len(out), best[0]))
    return out


def test_picks_equal_a_greedy_walk(spark):
    r = random.Random(2)
    some = lambda x: r.choice([None, r.sample(x, r.randrange(len(x)))])
    rows = [(i, r.choice([None, True, False]), r.choice([None, "p", "q", "r"]), some(list("abcd")), some(list("pqrst")), r.randrange(3), r.randrange(2), r.randrange(3)) for i in range(60)]
    got = A.rank_traces(spark.createDataFrame([*rows, rows[0], rows[7]], SCHEMA), 8).orderBy("pick")
    assert [tuple(x) for x in got.collect()] == greedy(rows, 8)
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert [tuple(x) for x in A.rank_traces(few, 8).orderBy("pick").collect()] == greedy(rows[:3], 8)
    assert A.rank_traces(few.limit(0), 8).count() == 0
