"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on labelled rows only (at most MOST_LABELLED of them, taken in hash order):

1. Each token (a run of letters and digits) has features: itself and its beginnings of several
   lengths. A feature's weight is the log-odds of toxic over other texts with a Dirichlet prior, whose
   mass follows the pooled counts; it counts only if it is many standard errors above zero.
2. A token scores its largest weight, else -DRIFT. All maximal scoring segments of a text come from one
   linear scan (Ruzzo and Tompa, 1999).
3. Karlin-Altschul calibration: lambda solves sum p(s) exp(lambda s) = 1 over the scores of tokens of
   texts not marked toxic; K follows from their largest segments. A segment of score S in n tokens has
   p = 1 - exp(-K n exp(-lambda S)).
4. A logistic curve maps the summed -ln p of a text's significant segments to a probability. It is fitted
   in a second pass over the labelled texts, on the sums that scoring uses.

Scores and segments are counted over whole texts.

Scores use the text alone. Features are hashed to BUCKETS counters, so what goes to the driver and back
has a fixed size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.durable import cut, map_arrow, spent

MOST_LABELLED = 50_000
BUCKETS = 1 << 20
HEADS = (4, 5, 6, 7, 8, 10)
DRIFT = 0.3
PRIOR = 0.05
LEAST_Z = 4.0
SIGNIFICANT = 0.01
_SLICE = 1 << 14
SEGMENT = "struct<first_word:int,end_word:int,score:double,p_value:double>"


def _fold(raw: np.ndarray) -> np.ndarray:
    """A copy in which two-byte capitals of Latin-1 (C3 80 to C3 9E) are small letters."""
    out = raw.copy()
    at = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
    out[at] += 0x20
    return out


def _features(w: textkit.Words) -> list[np.ndarray]:
    keep = np.uint64(BUCKETS - 1)
    return [(w.hashes & keep).astype(np.int64)] + [(w.heads(n) & keep).astype(np.int64) for n in HEADS]


def _parsed(column: pa.Array):
    for i, j, at, raw in textkit.chunks(column):
        yield i, j, textkit.words(at, _fold(raw), textkit.SIGNS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS), np.uint32)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, w in _parsed(batch.column(0)):
            found = np.stack(_features(w))
            for d in range(j - i):
                seen[int(toxic[i + d]), np.unique(found[:, w.first[d] : w.first[d + 1]])] += 1
    rows = [(c, k, seen[c, k * _SLICE : (k + 1) * _SLICE]) for c in (0, 1) for k in range(BUCKETS // _SLICE)]
    rows = [(c, k, x.tobytes()) for c, k, x in rows if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["toxic", "part", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table.column("counts")), np.zeros(_SLICE, np.int64))
    return pa.table({"toxic": table.column("toxic").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def segments(score: np.ndarray, at: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of tokens that score `score` at the positions
    `at` (ascending) and -drift elsewhere, by one scan with a stack of candidates."""
    kept: list[tuple[float, float, int, int]] = []  # running sum before and at the end, first, end
    total, done = 0.0, 0
    for s, p in zip(score.tolist(), at.tolist(), strict=True):
        total -= drift * (p - done)
        left, first = total, p
        total += s
        done = p + 1
        right = total
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][0] >= left:
                k -= 1
            if k < 0 or kept[k][1] >= right:
                kept.append((left, right, first, done))
                break
            left, first = kept[k][0], kept[k][2]
            del kept[k:]
    return [(a, b, r - x) for x, r, a, b in kept]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    lam: float = 1.0
    k: float = 1.0
    bias: float = -4.0
    slope: float = 0.0

    def token_scores(self, w: textkit.Words) -> np.ndarray:
        best = np.zeros(len(w.hashes), np.float32)
        for f in _features(w):
            np.maximum(best, self.weights[f], out=best)
        return best

    def p_value(self, score: float, n: int) -> float:
        return max(-np.expm1(-self.k * n * np.exp(-self.lam * score)), 1e-300)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(evidence))))


_SEEN = "doc_id long, toxic int, tokens long, top double, value float, n long"


def _scan(weights: np.ndarray):
    """For labelled texts: toxic, tokens and the score of the largest segment of each; and, in rows of their
    own without tokens, how many tokens of clean texts have each positive score."""
    model = Model(weights)
    levels = np.unique(weights[weights > 0])
    names = [x.split()[0] for x in _SEEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(levels), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            tokens, tops = [], []
            for i, j, w in _parsed(batch.column(0)):
                score = model.token_scores(w)
                for d in range(j - i):
                    own = score[w.first[d] : w.first[d + 1]]
                    at = np.flatnonzero(own)
                    tokens.append(len(own))
                    tops.append(max((s for _, _, s in segments(own[at], at, DRIFT)), default=0.0))
                    if not toxic[i + d]:
                        np.add.at(seen, np.searchsorted(levels, own[at]), 1)
            n = len(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(tokens, pa.int64()), pa.array(tops, pa.float64()), pa.nulls(n, pa.float32()), pa.nulls(n, pa.int64())], names)
        used = np.flatnonzero(seen)
        n = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(levels[used], pa.float32()), pa.array(seen[used], pa.int64())], names)

    return run


def _evidence(model: Model):
    """For labelled texts: toxic, and the evidence by which scoring judges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _apply(model)
        for batch in batches:
            found, _ = judged(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([sum(-np.log(s["p_value"]) for s in x) for x in found], pa.float64())], ["doc_id", "toxic", "evidence"])

    return run


def _solve(value: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum share exp(lambda value) = 1."""
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * value, 700))).sum()) - 1
    while f(high) < 0 and high < 512:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model from the labelled rows of docs whose crc32(doc_id as text) mod 5 is not 0.

    Labels other than 0 and 1 and null ids are left out. Rows that repeat an id all count for the weights
    and are one text, of their tokens together and their largest evidence, for the calibration. Without texts of both kinds nothing can be
    learned and every text gets the same low score.
    """
    ids = labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", "doc_id")
    seen = np.zeros((2, BUCKETS))
    sums = map_arrow(known, _counts, "toxic int, part int, counts binary").groupBy("toxic", "part").applyInArrow(_summed, "toxic int, part int, counts binary")
    for r in sums.collect():  # 128 rows at most
        seen[r.toxic, r.part * _SLICE : (r.part + 1) * _SLICE] = np.frombuffer(r.counts, np.int64)
    model = Model()
    if not seen[0].any() or not seen[1].any():
        return model
    pooled, per = seen.sum(0), seen.sum(1)
    prior = PRIOR * pooled
    mass = prior.sum()
    used = np.flatnonzero(seen[1])
    a, b = seen[1][used] + prior[used], seen[0][used] + prior[used]
    odds = np.log(a / (per[1] + mass - a)) - np.log(b / (per[0] + mass - b))
    good = odds / np.sqrt(1 / a + 1 / b) >= LEAST_Z
    if not good.any():
        good = odds / np.sqrt(1 / a + 1 / b) >= LEAST_Z / 2
    model.weights[used[good]] = odds[good]
    seen = cut(map_arrow(known, _scan(model.weights), _SEEN))
    each = seen.filter("tokens is not null").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.sum("tokens").alias("tokens"), F.max("top").alias("top"))
    rows = each.orderBy("doc_id").toArrow()  # at most `most` short rows
    toxic, tokens, tops = rows.column("toxic").to_numpy(), np.maximum(rows.column("tokens").to_numpy(), 1), rows.column("top").to_numpy()
    clean = toxic == 0
    ups = seen.filter("n is not null").groupBy("value").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each weight
    spent(seen)
    up, n = np.append(ups.column("value").to_numpy(), model.weights.max()), np.append(ups.column("n").to_numpy(), 1)
    total = tokens[clean].sum() + 1
    value, share = np.append(up.astype(float), -DRIFT), np.append(n / total, 1 - n.sum() / total)
    model.lam = _solve(value, share) if (value * share).sum() < 0 else 0.1
    model.k = float((clean.sum() + 1) / ((tokens[clean] * np.exp(-model.lam * tops[clean])).sum() + 1))
    each = map_arrow(known, _evidence(model), "doc_id long, toxic int, evidence double").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("evidence").alias("evidence"))
    rows = each.orderBy("doc_id").toArrow()  # at most `most` short rows
    toxic, x = rows.column("toxic").to_numpy(), np.log1p(rows.column("evidence").to_numpy())
    bias, slope = np.log((toxic.sum() + 1) / (clean.sum() + 1)), 0.0
    for _ in range(50):  # Newton steps with a little ridge
        q = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
        g = np.array([(toxic - q).sum(), ((toxic - q) * x).sum() - 0.1 * slope])
        v = q * (1 - q)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        bias, slope = bias + np.clip(step[0], -2, 2), slope + np.clip(step[1], -2, 2)
    model.bias, model.slope = float(bias), float(max(slope, 0.0))
    return model


def _apply(model: Model):
    def judged(column: pa.Array) -> tuple[list, np.ndarray]:
        found: list[list[dict]] = []
        for i, j, w in _parsed(column):
            score = model.token_scores(w)
            hot = np.flatnonzero(score)
            a, b = np.searchsorted(hot, w.first[:-1]), np.searchsorted(hot, w.first[1:])
            for d in range(j - i):
                own: list[dict] = []
                if a[d] < b[d]:
                    at = hot[a[d] : b[d]]
                    n = int(w.first[d + 1] - w.first[d])
                    for first, end, s in segments(score[at], at - w.first[d], DRIFT):
                        if (p := model.p_value(s, n)) <= SIGNIFICANT:
                            own.append({"first_word": first, "end_word": end, "score": s, "p_value": p})
                found.append(own)
        return found, model.probability(np.array([sum(-np.log(s["p_value"]) for s in x) for x in found]))

    return judged


_TYPE = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, segments) of every row of docs (doc_id, text).

    segments lists every significant passage by its words. Null and empty texts have no segments and
    the score of a text without evidence; a null doc_id stays null; repeated rows give repeated rows;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _apply(model)
        for batch in batches:
            found, score = judged(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, _TYPE)], ["doc_id", "score", "predicted", "segments"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, score double, predicted int, segments array<{SEGMENT}>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not predicted toxic. No shuffle."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _apply(model)
        for batch in batches:
            yield batch.filter(pa.array(judged(batch.column(place))[1] < 0.5))

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
