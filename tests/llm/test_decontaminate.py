import random
from collections import Counter

import numpy as np

from graphloom.llm import textkit
from graphloom.llm.decontaminate import FEATURE, RADIUS, Items, best_window, fingerprints, hits, window_size, without_leaks


def test_bit_planes_equal_counting():
    r = np.random.default_rng(0)
    f = r.integers(0, 2**63, 300, dtype=np.uint64) * 2 + r.integers(0, 2, 300).astype(np.uint64)
    for size in (3, 5, 16, 24, 26, 47, 90):
        got = fingerprints(f, [size], {size: 1})[size]
        n = size - FEATURE + 1
        for at in range(0, 300 - n, 17):
            bits = ((f[at : at + n, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
            want = sum(1 << b for b in range(64) if bits[b] * 2 > n)
            assert int(got[at]) == want


def test_blocks_find_every_print_within_radius():
    r = random.Random(3)
    items = Items([(i, " ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(15, 60)))) for i in range(80)])
    prints = []
    for k in range(4000):
        x = int(items.prints[r.randrange(80)])
        for b in r.sample(range(64), r.randrange(22)):
            x ^= 1 << b
        prints.append(x)
    prints = np.array(prints, np.uint64)
    for _, members in items.groups:
        at, who = items.within(prints, members, items.tables(members))
        got = set(zip(at.tolist(), who.tolist()))
        want = {(i, int(k)) for i, x in enumerate(prints.tolist()) for k in members if bin(x ^ int(items.prints[k])).count("1") <= RADIUS}
        assert got == want


def test_best_window_equals_brute_force():
    r = random.Random(4)
    for _ in range(300):
        item = np.array([r.randrange(9) for _ in range(r.randrange(1, 9))], np.uint64)
        region = np.array([r.randrange(9) for _ in range(r.randrange(1, 25))], np.uint64)
        n = min(len(item), len(region))
        def jac(i):
            a, b = Counter(item.tolist()), Counter(region[i : i + n].tolist())
            return sum((a & b).values()) / sum((a | b).values())
        want = max(jac(i) for i in range(len(region) - n + 1))
        got, at = best_window(region, item)
        assert abs(got - want) < 1e-9 and abs(jac(at) - want) < 1e-9


def brute(docs, bench):
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, q in bench:
            v = (q or "").lower().split()
            n = min(len(v), len(w))
            if len(v) < 5 or n < 5:
                continue
            a = Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
            if not any(tuple(w[k : k + 5]) in a for k in range(len(w) - 4)):
                continue
            for s in range(len(w) - n + 1):
                b = Counter(tuple(w[s + k : s + k + 5]) for k in range(n - 4))
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


def test_planted_items_are_found(spark):
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    bench = [(i, " ".join(say(r.randrange(15, 62)))) for i in range(60)] + [(100, "too short"), (101, None), (102, ""), (None, " ".join(say(20)))]
    docs = []
    for d in range(500):
        w = say(r.randrange(0, 300))
        if d % 2:
            q = bench[r.randrange(60)][1].split()
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(q))
                r.choice([lambda: q.__setitem__(k, "zz"), lambda: q.insert(k, "zz"), lambda: q.pop(k)])()
            at = r.choice([0, len(w), r.randrange(len(w) + 1)])
            w[at:at] = [x.upper() for x in q]
        docs.append((d, " \n".join(w)))
    docs += [(600, None), (601, ""), (602, bench[0][1]), (602, bench[0][1]), (None, bench[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("1 AS item_id", "doc_id", "text")
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, [b for b in bench if b[0] is not None])
    for most in (4096, 25):
        got = {(x.doc_id, x.item_id) for x in hits(df, items, most).collect()}
        assert got <= want and len(got) >= 0.97 * len(want), (len(got), len(want), sorted(want - got, key=str)[:5])
    exact = {(d, i) for d, t in docs for i, q in bench[:60] if q in " ".join((t or "").lower().split())}
    assert exact <= got
    left = without_leaks(df, items, 25)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert hits(df, items.limit(0)).count() == 0 and hits(df.limit(0), items).count() == 0


def test_window_sizes_never_exceed_items():
    assert all(n * 0.9 <= window_size(n) <= n for n in range(1, 2000))


def test_items_less_words_at_their_ends_are_found(spark):
    r = random.Random(12)
    say = lambda n: [f"v{r.randrange(400)}" for _ in range(n)]
    bench = [(i, " ".join(say(n))) for i, n in enumerate([5, 6, 12, 15, 20, 24, 25, 26, 29, 30, 31, 47, 60, 61, 133, 134, 200, 401])]
    docs = []
    for i, q in bench:
        w = q.split()
        for cut in {1, 2, len(w) // 20, len(w) // 10, len(w) // 6, len(w) // 4}:
            for part in (w[cut:], w[: len(w) - cut], w[cut // 2 : len(w) - (cut - cut // 2)]):
                docs.append((len(docs), " ".join(part).upper()))
    want = brute(docs, bench)
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in hits(df, items).collect()}
    assert len(want) > 100 and got == want, (len(got), len(want), sorted(want - got)[:5])
    assert {x.doc_id for x in without_leaks(df, items, 7).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_each_planting_of_an_item_has_its_row(spark):
    r = random.Random(14)
    say = lambda n: [f"v{r.randrange(400)}" for _ in range(n)]
    item = say(30)
    near = [item[0], "zz", *item[2:]]
    docs = [(1, item + item), (2, say(9) + item + near + item + say(9)), (3, item + say(20) + item), (4, item[:20] + item[:20])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    found = hits(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).orderBy("doc_id", "first_word").collect()
    assert [(x.doc_id, x.first_word, x.end_word) for x in found] == [(1, 0, 30), (1, 30, 60), (2, 9, 39), (2, 39, 69), (2, 69, 99), (3, 0, 30), (3, 50, 80)]
