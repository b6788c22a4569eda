import random
import re

from graphloom.llm.jaccard_join import boundary_by_cost, jaccard_join


def brute(rows, k=3, percent=90):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            x, y = sets[i], sets[j]
            if j < i and a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    rows, base = [], [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 9, 11, 12, 13, 18, 20, 21, 22, 25, 31, 33, 36, 60, 63, 70, 200]))] for _ in range(25)]
    for d in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(w) + 1)
            r.choice([lambda: w.insert(at, r.choice(vocab)), lambda: w.__setitem__(min(at, len(w) - 1), "Ž" + r.choice(vocab).upper()), lambda: w.pop(min(at, len(w) - 1)) if len(w) > 1 else None, lambda: w.append("end")])()
        rows.append((d, r.choice([" ", "\n", "\t "]).join(w)))
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "x" * 200000), (904, "  a"), (5, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (None, None)]
        rows += rows[:3]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS key", "2 AS component", "'x' AS a").repartition(5)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect()), key=str)
        assert got == brute(rows)


def test_five_words_and_four_fifths_equal_brute_force(spark):
    for seed in (4, 5):
        rows = corpus(seed, 220) + [(900, None), (901, ""), (902, " a b "), (903, "A b"), (904, "a b c d e"), (905, "a b c d e")]
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 80).collect()), key=str)
        assert got == brute(rows, 5, 80)


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_lies_where_subsets_grow():
    assert 10 <= boundary_by_cost(90) <= 24


def test_tiles_join_what_pairs_join():
    import numpy as np

    from graphloom.llm.jaccard_join import joining_links

    r = np.random.default_rng(5)
    for m, n, pool in ((2, 5, 6), (40, 12, 14), (60, 30, 34), (50, 40, 4000)):
        sets = [np.unique(r.integers(0, pool, n).astype(np.uint64)) for _ in range(m)]
        sets += [np.unique(np.append(x[1:], np.uint64(9999))) for x in sets[: m // 2]]
        own = np.arange(len(sets)) // 2 * 2

        def closed(pairs):
            label = own.tolist()
            for a, b in pairs:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        sets_ = [set(x.tolist()) for x in sets]
        brute_pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets_[a] & sets_[b]) >= 90 * len(sets_[a] | sets_[b])]
        assert closed(joining_links(own, sets, 90)) == closed(brute_pairs)


def test_large_groups_of_near_copies(spark, monkeypatch):
    from graphloom.llm import jaccard_join as module

    monkeypatch.setattr(module, "TILE_SHINGLES", 3000)
    r = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for d in range(90):
            w = list(base)
            for k in r.sample(range(120), r.choice([1, 2, 3, 4])):
                w[k] = f"e{r.randrange(10**6)}"
            rows.append((g * 100 + d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in module.jaccard_join(df).collect()), key=str) == brute(rows)
