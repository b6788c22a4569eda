import random
from zlib import crc32

from pyspark.sql import functions as F

from graphloom.llm import toxicity as whole
from graphloom.llm.toxicity import fit, held_out, segments, toxicity, without_toxic


def brute_segments(s):
    """Maximal segments by their definition: the best proper-prefix, proper-suffix condition, recursively."""
    out = []

    def best(a, b):
        found = None
        for i in range(a, b):
            t = 0
            for j in range(i, b):
                t += s[j]
                if t > 1e-9 and (found is None or t > found[0] + 1e-9 or (abs(t - found[0]) <= 1e-9 and j - i < found[2] - found[1])):
                    found = (t, i, j)
        if found:
            t, i, j = found
            best(a, i)
            out.append((i, j + 1, round(t, 6)))
            best(j + 1, b)

    best(0, len(s))
    return out


def test_segments_equal_their_definition():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 16)
        s = [r.choice([0, 0, 0, 1.13, 2.71, 0.57]) for _ in range(n)]
        at = [i for i, x in enumerate(s) if x]
        import numpy as np

        got = [(a, b, round(x, 6)) for a, b, x in segments(np.array([s[i] for i in at]), np.array(at), 0.3)]
        assert got == brute_segments([x or -0.3 for x in s])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels)
    got = toxicity(docs, model).withColumn("held", held_out()).join(labels, "doc_id").filter("held").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 500
    hit = sum(r.predicted == r.toxic for r in got) / len(got)
    caught = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.predicted for r in got if not r.toxic) / sum(not r.toxic for r in got)
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    print(f"accuracy {hit:.4f} caught {caught:.4f} false alarms {false:.4f} auc {auc:.4f} lambda {model.lam} k {model.k} {model.bias} {model.slope} {(model.weights > 0).sum()}")
    assert hit > 0.95 and caught > 0.75 and false < 0.01
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "ok " * 50000), (3, "ok"), (3, "ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    model = fit(df, spark.createDataFrame([(3, 0), (3, None), (None, 1)], "doc_id long, toxic int"))
    out = toxicity(df, model).collect()
    assert len(out) == 6 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert toxicity(df.limit(0), model).count() == 0 and without_toxic(df, model).count() == 6


def test_fit_counts_whole_texts(spark):
    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    plain = [f"w{i}q" for i in range(200)]
    docs, labels = [], []
    for d in range(300):
        bad = d % 3 == 0
        w = [r.choice(plain) for _ in range(4000 if d % 10 == 1 else 60)]
        for i in range(len(w)):
            if r.random() < (0.4 if bad else 0.08 if len(w) > 60 else 0.002):  # long clean texts have over 200 hot tokens
                w[i] = r.choice(["idiotx", "stupidx"])
        docs.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    up, total, longest = [], 1, 0
    for d, text in docs:
        if not labels[d][1] and crc32(str(d).encode()) % 5:
            score = model.token_scores(next(whole._parsed(pa.array([text])))[2])
            up += score[score > 0].tolist()
            total += len(score)
            longest = max(longest, int((score > 0).sum()))
    assert longest > 200
    up.append(float(model.weights.max()))
    value, share = np.append(up, -whole.DRIFT), np.append(np.full(len(up), 1 / total), 1 - len(up) / total)
    assert (value * share).sum() < 0 and abs(model.lam - whole._solve(value, share)) < 1e-4, (model.lam, whole._solve(value, share))
