import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import host_rules as H
from tests.llm.oracle import rows, sql_rows

SCHEMA = "doc_id long, text string, source string"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    twice = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(twice)


def brute(table):
    stats = [(d, s, counted(t)) for d, t, s in table]
    fails = [(w < 20, 100 * rep > 30 * w, 10 * sym > c, 100 * dup > 30 * n) for _, _, (w, c, sym, n, dup, rep) in stats]
    hosts = defaultdict(list)
    for (_, s, _), f in zip(stats, fails, strict=True):
        if s is not None:
            hosts[s].append(f)
    bad, total = set(), sum(map(len, hosts.values()))
    for r in range(4):
        count = {h: (sum(f[r] for f in fs), len(fs)) for h, fs in hosts.items()}
        p = sum(f for f, _ in count.values()) / total if total else 0
        if len(count) < 2 or p in (0, 1):
            continue
        chance = p * (1 - p)
        room = chance * (total - sum(n * n for _, n in count.values()) / total - len(count) + 1)
        rho = (sum(n * (f / n - p) ** 2 for f, n in count.values()) - chance * (len(count) - 1)) / room if room > 0 else 0
        if rho <= 0:
            continue
        k = 1 / min(rho, 0.999) - 1
        for h, (f, n) in count.items():
            q = (f + p * k) / (n + k)
            if q - 1.645 * math.sqrt(q * (1 - q) / (n + k + 1)) > 0.5:
                bad.add(h)
    return sorted(((d, w, c, sym, dup, rep, f[0] or f[1], not (f[0] or f[1]) and s not in bad) for (d, s, (w, c, sym, _, dup, rep)), f in zip(stats, fails, strict=True)), key=str), bad


def run(spark, table):
    got = H.host_rules(spark.createDataFrame(table, SCHEMA)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return sorted((tuple(r[c] for c in names) for r in got), key=str), {r.host for r in got if r.host_rejected}


def words(r, n, most=400):
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


def test_equals_brute_force(spark):
    r, table = random.Random(2), []
    for i in range(300):
        kind, host = r.random(), r.choice(["a", "a", "b", "junk", "junk", "c", None])
        text = words(r, r.choice([0, 3, 19, 20, 30, 90]))
        if kind < 0.3:
            text = "\n".join(r.choice([text, words(r, 12, 3), " ", "\t", "é漢 😀 # <a>", text[:40]]) for _ in range(r.randrange(12)))
        if host == "junk" and r.random() < 0.85:
            text = words(r, 10) if i % 2 else (words(r, 9) + "\n") * 9
        table.append((i, text, host))
    got, want = run(spark, table), brute(table)
    assert got == want
    assert any(x[5] for x in got[0])


def test_a_bad_host_takes_its_clean_documents_and_no_other_is_touched(spark):
    r = random.Random(8)
    good = [(i, words(r, 60), f"good{i % 9}") for i in range(270)]
    bad = [(1000 + i, words(r, 60) if i < 8 else (words(r, 9) + "\n") * 6, "bad") for i in range(60)]
    few = [(2000 + i, words(r, 5), "small") for i in range(2)] + [(3000, words(r, 60), "small"), (3001, words(r, 60), None)]
    got, rejected = run(spark, good + bad + few)
    assert rejected == {"bad"} and (got, rejected) == brute(good + bad + few)
    assert {d for d, *_, kept in got if kept} == {d for d, _, _ in good} | {3000, 3001}


def test_odd_rows(spark):
    r = random.Random(1)
    text = words(r, 40)
    table = [(1, None, "a"), (2, "", "a"), (3, text, None), (3, text, None), (None, text, "b"), (4, "\x00\x1f\x85 x", "b"), (5, "\n\n \n", "b"), (6, "x " * 8, "a"), (7, "x " * 9, "a"), (8, "#*$%&|<>" * 9, "a")]
    assert run(spark, table) == brute(table)
    assert run(spark, []) == ([], set())
    assert run(spark, table[:1]) == brute(table[:1])
    long = [(1, "word, " * 200_000, "a"), (2, words(r, 200_000, 10**9), "a"), (3, "x" * 2_000_000, "b"), (4, "a\n" * 200_000, "b"), (5, words(r, 60_000, 10**9) + " " + words(random.Random(7), 50) + words(r, 60_000, 10**9) + " " + words(random.Random(7), 50), "c")]
    assert run(spark, long) == brute(long)


def test_equal_hashes_of_other_words_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(H.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    text = " ".join(map(str, range(40))) + " " + " ".join(map(str, range(9)))
    assert H.statistics(spark.createDataFrame([(1, text)], "id long, text string")).collect()[0].n_repeat_words == 18


def test_hosts(spark):
    cases = {"https://user:x@www.Example.org:8080/a?b#c": "example.org", "src8": "src8", " WWW.a.b ": "a.b", "http://a.b?x": "a.b", "": None, None: None, "a.b/c": "a.b", "ftp://h": "h"}
    got = spark.createDataFrame(list(cases.items()), "a string, w string").select(H.host_of(F.col("a")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_extra_columns_and_shuffled_hosts(spark, monkeypatch):
    r = random.Random(8)
    table = [(i, words(r, 60) if i % 7 else "a b", "bad" if not i % 7 else f"g{i % 5}", 1, 2, 3) for i in range(210)] + [(500, words(r, 50), "bad", 1, 2, 3)]
    df = spark.createDataFrame(table, "id long, body string, site string, n_words int, text int, host int")
    here = H.host_rules(df, "body", "id", "site")
    monkeypatch.setattr(H, "BROADCAST_HOSTS", -1)
    there = H.host_rules(df, "body", "id", "site")
    assert rows(here) == rows(there) and here.filter("NOT kept AND NOT base_failed").count() == 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    got = H.host_rules(spark.read.parquet(f"{sf}/documents.parquet")).drop("host", "host_rejected")
    assert rows(got) == sql_rows(H.ORACLE, sf)
    assert not any("Python" in n or "Arrow" in n for n in [got._jdf.queryExecution().executedPlan().toString()])


def test_counts_helper():
    assert counted("a b c d e f g h a b c d e f g h")[5] == 16 and Counter()[1] == 0
