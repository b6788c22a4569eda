import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import fill_middle as M
from tests.llm.oracle import rows, sql_rows

SCHEMA = "doc_id long, text string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, table):
    out = M.fill_middle(spark.createDataFrame(table, SCHEMA))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    assert sorted(got, key=str) == sorted((brute(*t) for t in table), key=str)
    back = out.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((d, t or "") for d, t in table), key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    bits = ["a", "bc", "Zz", " ", "\n", "é", "漢", "😀", "<", "P", "S", ">", "<M", "ß", "\r", "\t", " ", "1"]
    check(spark, [(i, "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 5, 63, 64, 65, 128, 129, 300])))) for i in range(400)])


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "a <P> b"), (4, "<S>"), (5, "x<M>"), (None, "no id here"), (None, "no id here"), (None, "another"), (7, "same id"), (7, "same id"), (7, "other text")])
    long = "word, " * 300_000
    check(spark, [(i, t) for i, t in enumerate([long, "x" * 2_000_000, "\n" * 200_000, "é" * 70_000])])
    assert M.fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_and_other_names(spark):
    df = spark.createDataFrame([(5, "some text, and more of it", 1, 2, 3, 4)], "id long, body string, k int, n int, text int, units int")
    r = M.fill_middle(df, "body", "id").collect()[0]
    assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(5, "some text, and more of it")


def test_one_shuffle_carries_the_texts(spark):
    df = M.digests(M.fill_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\+- (?:\*\(\d+\) )?Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    assert rows(M.digests(M.fill_middle(spark.read.parquet(f"{sf}/documents.parquet")))) == sql_rows(M.ORACLE, sf)
