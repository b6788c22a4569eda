import random

import numpy as np
import pytest
import tiktoken

from graphloom.llm.token_counts import Vocabulary, attribute, token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def brute(text, cuts, rule, enc):
    """Counts by the definition, from the bytes of single tokens."""
    raw, at = text.encode(), 0
    counts, crossing = [0] * len(cuts), [0] * len(cuts)
    where = lambda b: max(k for k, c in enumerate(cuts) if c <= b)
    for t in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(t))
        of = [where(b) for b in range(at, at + n)]
        s = {"start": of[0], "end": of[-1], "most": max(sorted(set(of)), key=of.count)}[rule]
        counts[s] += 1
        crossing[s] += len(set(of)) > 1
        at += n
    assert at == len(raw)
    return counts, crossing


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_lines_and_fields(spark, vocabulary, rule):
    r = random.Random(3)
    enc = tiktoken.Encoding("x", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = ["", None, "\n", "a\n\n\nb", "é\nßß\n", "  \n\n  x\n\n\n\n y"] + ["".join(r.choice("ab é\n\n .日") for _ in range(r.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (None, "a b"), (3, texts[3])], "doc_id long, text string").selectExpr("'q' AS section", "text", "doc_id", "substr(text, 1, 3) AS x", "substr(text, 4) AS y")
    got = {}
    for x in token_counts(df, vocabulary, rule).collect():
        got.setdefault(x.doc_id, []).append(x)
    for d, t in enumerate(texts):
        t = t or ""
        raw = t.encode()
        cuts = [0] + [k + 1 for k, b in enumerate(raw) if b == 10]
        counts, crossing = brute(t, cuts, rule, enc)
        rows = sorted(got[d], key=lambda x: x.section)[:: 2 if d == 3 else 1]
        assert [x.n_tokens for x in rows] == counts and [x.n_crossing for x in rows] == crossing
        assert [t[x.first_char : x.end_char] for x in rows] == t.splitlines(keepends=True) + ([""] if not t or t[-1] == "\n" else []) if not set(t) & set("\r\x0b\x0c\x1c\x85 ") else True
    for x in token_counts(df.filter("doc_id > 5"), vocabulary, rule, ["x", "y", "x"]).filter("section = 1").collect():
        t = texts[x.doc_id]
        a = t[:3]
        assert x.n_tokens == brute(a + t[3:] + a, [0, len(a.encode()), len(t.encode())], rule, enc)[0][1] or len(t) <= 3
    assert token_counts(df.limit(0), vocabulary).count() == 0


def test_long_texts(vocabulary, spark):
    df = spark.createDataFrame([(1, "ab" * 150000), (2, "word \n" * 50000)], "doc_id long, text string")
    assert {r.doc_id: r["count"] for r in token_counts(df, vocabulary).groupBy("doc_id").count().collect()} == {1: 1, 2: 50001}


def test_unknown_rule(vocabulary):
    with pytest.raises(ValueError):
        attribute(np.array([1]), np.array([0]), "none")
