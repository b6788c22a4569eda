import random

import numpy as np
import pytest

from graphloom.llm import passage_dedup
from graphloom.llm.passage_dedup import compact_windows, overlaps, passages, repeated_passages


def brute_windows(v, span):
    out = []
    for c in range(len(v)):
        l = c
        while l and v[l - 1] > v[c]:
            l -= 1
        r = c
        while r + 1 < len(v) and v[r + 1] >= v[c]:
            r += 1
        if r - l + 1 >= span:
            out.append((l, c, r))
    return out


def test_compact_windows_equal_their_definition():
    r = np.random.default_rng(1)
    for span in (1, 2, 3, 7, 46):
        for _ in range(60):
            sizes = r.integers(0, 130, 4)
            first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            v = r.integers(0, 2**20, first[-1], dtype=np.uint64) << np.uint64(40)
            got = list(zip(*(x.tolist() for x in compact_windows(v, first, span))))
            want = [(a + l, a + c, a + x) for a, b in zip(first[:-1].tolist(), first[1:].tolist()) for l, c, x in brute_windows(v[a:b].tolist(), span)]
            assert sorted(got) == sorted(want)


def test_overlaps_equal_counting():
    r = random.Random(3)
    for _ in range(200):
        rows = [(a := r.randrange(60), a + r.randrange(-2, 25), r.randrange(4)) for _ in range(r.randrange(12))]
        got = overlaps([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], 2, 6)
        deep = [len({f for a, b, f in rows if a <= p <= b}) >= 2 for p in range(100)]
        want, p = [], 0
        while p < 100:
            q = p
            while q < 100 and deep[q]:
                q += 1
            if q - p >= 6:
                want.append((p, q - 1))
            p = q + 1
        assert got == want


def test_planted_passages(spark):
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [say(r.randrange(52, 120)) for _ in range(12)]
    docs, want = [], {}
    for d in range(300):
        w = say(r.randrange(0, 260))
        if d % 3:
            k = r.randrange(12)
            p = list(shared[k])
            if d % 3 == 2 and len(p) > 80:
                p[r.randrange(len(p))] = "zz"
            at = r.choice([0, len(w), r.randrange(len(w) + 1)])
            w[at:at] = [x.upper() for x in p]
            want.setdefault(k, []).append(d)
        docs.append((d, " ".join(w)))
    docs += [(400, "short"), (401, None), (402, ""), (None, docs[1][1]), (403, "a " * 100000), (404, docs[7][1]), (404, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("1 AS doc", "2 AS other", "text", "doc_id", "3 AS s")
    got = repeated_passages(df).collect()
    text = {d: (t or "").lower().split() for d, t in docs}
    up = {d: d for d in text}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in got:
        grams = lambda w, a, b: {tuple(w[i : i + 5]) for i in range(a, b - 4)}
        p, q = grams(text[x.doc_id], x.first_word, x.end_word), grams(text[x.other_id], x.other_first, x.other_end)
        assert len(p & q) >= 0.8 * len(p | q) and x.other_id < x.doc_id and x.end_word - x.first_word >= 40
        up[find(x.doc_id)] = find(x.other_id)
    lost = sum(find(d) != find(group[0]) for group in want.values() for d in group)
    assert lost <= 0.02 * sum(map(len, want.values())), lost
    assert {x.doc_id for x in got} | {x.other_id for x in got} <= {d for g in want.values() for d in g} | {404}
    assert find(404) == find(7)
    assert repeated_passages(df.limit(0)).count() == 0


def test_parts_of_runs_that_are_not_alike_cover_what_brute_force_finds():
    r = np.random.default_rng(5)
    new = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    for every in [26, 30, 37, 44, 0, 0]:
        x = new(600)
        y = x.copy()
        if every:  # one changed word changes five shingles
            for k in range(every, 590, every):
                y[k : k + 5] = new(5)
        else:  # equal blocks of 46 with ten or more other shingles in between
            for k in range(46, 560, 56 + int(r.integers(0, 3))):
                y[k : k + 10] = new(10)
        got = passages(x, y, 46, 0.8)
        covered = np.zeros(600, bool)
        for a, b, oa, ob, alike in got:
            p, q = set(x[a:b].tolist()), set(y[oa:ob].tolist())
            assert alike == len(p & q) / len(p | q) >= 0.8
            covered[a:b] = True
        brute = [i for i in range(600 - 45) if len(set(x[i : i + 46].tolist()) & set(y[i : i + 46].tolist())) >= 41]
        assert brute and got
        for i in brute:
            common = np.flatnonzero(x[i : i + 46] == y[i : i + 46]) + i
            assert covered[common].all(), (every, i)


def test_looser_variants_with_smaller_ids_hide_no_exact_copy(spark):
    r = random.Random(21)
    vocab = [f"v{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    docs = []
    for g in range(40):
        p = say(60)
        for z in range(g % 4):
            q = list(p)
            for k in r.sample(range(18, 42), 2):  # similarity to p under 0.8
                q[k] = f"z{g}"
            docs.append((10 * g + z, " ".join(say(30) + q + say(30))))
        docs += [(10 * g + k, " ".join(say(30) + p + say(30))) for k in (8, 9)]
    got = {(x.doc_id, x.other_id) for x in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lost = [g for g in range(40) if (10 * g + 9, 10 * g + 8) not in got]
    print(f"exact copies found {40 - len(lost)} of 40")
    assert not lost, lost


def test_recall_behind_looser_variants(spark):
    """Exact and near copies of a passage, with one to three earlier copies that are not alike, against brute force."""
    r = random.Random(31)
    vocab = [f"v{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs, want = [], []
    for g in range(150):
        p = say(r.choice([55, 60, 80, 120]))
        for z in range(1 + g % 3):
            q = list(p)
            for k in range(r.randrange(12, 20), len(q) - 8, 20):  # no fifty words of it are alike
                q[k] = f"z{g}"
            docs.append((10 * g + z, " ".join(say(30) + q + say(30))))
        q = list(p)
        if g % 2:
            q[r.randrange(len(q))] = "near"
        assert len(grams(p) & grams(q)) >= 0.8 * len(grams(p) | grams(q))
        docs += [(10 * g + 8, " ".join(say(30) + p + say(30))), (10 * g + 9, " ".join(say(30) + q + say(30)))]
        want.append((10 * g + 9, 10 * g + 8))
    got = {(x.doc_id, x.other_id) for x in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    exact, near = ([p for k, p in enumerate(want) if k % 2 == odd] for odd in (0, 1))
    found = [sum(p in got for p in x) / len(x) for x in (exact, near)]
    print(f"recall: exact {found[0]:.3f}, near {found[1]:.3f}")
    assert found[0] == 1 and sum(found) / 2 >= 0.97, found


@pytest.mark.parametrize("parts", [1, 7])
def test_recall_by_length_edit_and_variants(spark, parts):
    """Each cell: passages of so many words and copies with so many changed words, in the middle or anywhere,
    behind so many looser variants; ids in no order."""
    r = random.Random(11)
    word = lambda: f"v{r.getrandbits(48):x}"
    docs, cells = [], {}
    for words, edits in ((50, 0), (50, 1), (55, 1), (60, 1), (80, 1)):
        for variants in (1, 3, 6):
            for middle in (True, False):
                for _ in range(30):
                    base = [word() for _ in range(words)]
                    copies = []
                    for k in range(variants + 2):
                        own = list(base)
                        for at in r.sample(range(words), max(3, words // 14)) if k < variants else []:
                            own[at] = word()
                        for n in range(edits if k > variants else 0):
                            own[words // 2 + n if middle else r.randrange(5, words - 5)] = word()
                        copies.append(len(docs))
                        docs.append(" ".join([*(word() for _ in range(60)), *own, *(word() for _ in range(60))]))
                    cells.setdefault((words, edits, variants, middle), []).append(copies[-2:])
    ids = list(range(len(docs)))
    r.shuffle(ids)
    rows = repeated_passages(spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string").repartition(parts, "doc_id")).collect()
    met = {frozenset((x.doc_id, x.other_id)) for x in rows}
    share = {c: sum(frozenset((ids[a], ids[b])) in met for a, b in pairs) / len(pairs) for c, pairs in cells.items()}
    mean = sum(share.values()) / len(share)
    assert min(share.values()) >= 0.8 and mean >= 0.95, (mean, {c: round(x, 2) for c, x in share.items() if x < 0.9})


@pytest.mark.parametrize("variants", [30, 90])
def test_no_place_of_a_list_hides_a_near_copy(spark, variants):
    """One passage in variants that are not alike, each with a near copy, so that lists hold all of them (with 90, more
    than are compared pair by pair); a copy has a word changed, added or removed, or two added."""
    r = random.Random(5)
    word = lambda: f"v{r.getrandbits(48):x}"
    base = [word() for _ in range(58)]
    docs, want = [], []
    for v in range(variants):
        own = list(base)
        for at in (r.randrange(20, 28), r.randrange(32, 38)):
            own[at] = word()
        near, at = list(own), r.randrange(8, 50)
        near[at : at + (0 if v % 4 in (1, 3) else 1)] = [[word()], [word()], [], [word(), word()]][v % 4]
        want.append((len(docs), len(docs) + 1))
        docs += [" ".join([*(word() for _ in range(30)), *x, *(word() for _ in range(30))]) for x in (own, near)]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    rows = repeated_passages(spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string").repartition(3)).collect()
    met = {frozenset((x.doc_id, x.other_id)) for x in rows}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ([*x.split()[30:-30]] for x in docs)]
    found = [frozenset((ids[a], ids[b])) in met for a, b in want]
    kinds = [sum(found[k::4]) / len(found[k::4]) for k in range(4)]
    print(f"near copies found: changed {kinds[0]:.2f}, one added {kinds[1]:.2f}, removed {kinds[2]:.2f}, two added {kinds[3]:.2f}")
    assert all(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for a, b in want)
    assert sum(found) >= 0.97 * len(want), kinds


def test_long_lists_link_what_comparing_each_pair_links():
    r = np.random.default_rng(9)
    span, need = 46, 41
    sign = lambda n: r.integers(1, 256, n, dtype=np.uint8)
    base = sign(91)
    rows = []
    for d in range(60):
        if d % 3 == 0 or not rows:
            own = base.copy()
            for at in r.integers(0, 91, 6):
                own[at : at + 5] = sign(len(own[at : at + 5]))
            own[45] = base[45]
        else:
            own, at = rows[r.integers(len(rows))].copy(), int(r.integers(48, 80))
            if d % 3 == 1:
                own[at : at + 5] = sign(5)
            else:  # a word added
                own = np.concatenate([own[: at], sign(5), own[at + 4 : -1]])
        rows.append(own)
    posts = np.zeros(len(rows), passage_dedup._post_kind(span))
    posts["doc"], posts["c"] = np.arange(len(rows)), 100
    posts["signs"][:, :91] = rows
    links = [{(int(x["doc"]), int(x["other"])) for x in passage_dedup._linked(posts, span, need, compared)} for compared in (100, 1)]

    def groups(pairs):
        up = list(range(len(rows)))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in pairs:
            up[find(a)] = find(b)
        return [find(x) for x in range(len(rows))]

    same = lambda g: {(a, b) for a in range(len(g)) for b in range(a) if g[a] == g[b]}
    short, long = (same(groups(x)) for x in links)
    assert short and short == long, (len(short), sorted(short ^ long)[:5])
