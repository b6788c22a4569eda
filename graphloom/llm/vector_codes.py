"""Product codes of vectors, found by partial-distance search in integers.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook
that starts as the parts of the smallest ids and moves to its parts' means for a few rounds. The nearest
entry of a part is searched in slices of the codebook, a dimension at a time in descending variance of the
entries: a mask drops an entry as soon as its sum strictly exceeds the best whole distance so far.

Each round is one pass over the table. A task adds up the parts of each entry, so what is shuffled and what
the driver reads follows the codebook (ENTRIES x dimensions) and not the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphloom.llm.durable import cut, map_arrow

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Most of a component after scaling: squared distances over 4,096 dimensions then fit a long.
LARGEST = 1 << 24
#: Vectors and codebook entries that are compared at a time.
ROWS, SLICE = 4096, 16


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector has only finite components; v are their scaled floors."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(finite).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def first_books(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """(part, entry, position) of the vectors of the smallest distinct ids; all of the length that the first
    of them has, a positive multiple of parts. Of rows that share an id the smallest vector counts."""
    able = kept.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall("v", lambda e: F.abs(e) <= LARGEST))
    found: dict = {}
    while len(found) < entries:
        rest = able.filter(F.col("vec_id") > F.lit(max(found))) if found else able
        if found:
            rest = rest.filter(F.size("v") == len(next(iter(found.values()))))
        rows = rest.select("vec_id", "v").orderBy("vec_id", "v").limit(entries).collect()
        if not rows:
            break
        dim = len(next(iter(found.values()), rows[0].v))
        for r in rows:
            if len(r.v) == dim and len(found) < entries:
                found.setdefault(r.vec_id, r.v)
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    return np.array(list(found.values()), np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2).copy()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (n, d) the entry of book (k, d) with the least squared distance, of equal ones the
    first, and that distance."""
    spread = len(book) * (book**2).sum(0) - book.sum(0) ** 2
    order = np.argsort(-spread, kind="stable")
    x, book = x[:, order], book[:, order]
    line = np.argsort(book[:, 0], kind="stable")
    guess = line[np.minimum(np.searchsorted(book[line, 0], x[:, 0]), len(book) - 1)]
    best = ((x - book[guess]) ** 2).sum(1)  # of some entry: what is farther than this cannot win
    index = np.full(len(x), len(book))
    for at in range(0, len(book), SLICE):
        some = book[at : at + SLICE]
        acc = (x[:, :1] - some[:, 0]) ** 2
        row, entry = np.nonzero(acc <= best[:, None])
        acc = acc[row, entry]
        for j in range(1, x.shape[1]):
            acc = acc + (x[row, j] - some[entry, j]) ** 2
            near = acc <= best[row]
            row, entry, acc = row[near], entry[near], acc[near]
        if not len(row):
            continue
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rows, least = row[begins], np.minimum.reduceat(acc, begins)
        hits = np.flatnonzero(acc == np.repeat(least, np.diff(np.r_[begins, len(row)])))
        hits = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
        won = (least < best[rows]) | (index[rows] == len(book))
        index[rows[won]], best[rows[won]] = at + entry[hits][won], least[won]
    return index, best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    column = column.drop_null()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1) if len(column) else np.zeros((0, parts, 0), np.int64)


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without a part stay."""
    parts, entries, width = books.shape

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            x = _matrix(b.column("v"), parts)
            for i in range(0, len(x), ROWS):
                for p in range(parts):
                    slot = nearest(x[i : i + ROWS, p], books[p])[0] + p * entries
                    np.add.at(total, slot, x[i : i + ROWS, p])
                    count += np.bincount(slot, minlength=len(count))
        slot, at = np.nonzero(np.repeat(count[:, None] > 0, width, 1))
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(at, pa.int64()), pa.array(total[slot, at]), pa.array(count[slot])], ["slot", "at", "total", "n"])

    sums = map_arrow(vectors.select("v"), over, "slot long, at long, total long, n long").groupBy("slot", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # a row for each component of each entry at most
        out[r.slot // entries, r.slot % entries, r.at] = r.total // r.n
    return out


def train(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds if books.size else 0):
        books = _moved(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, v); where v is null so are code and error."""
    parts = len(books)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), parts)
            codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for i in range(0, len(x), ROWS):
                for p in range(parts):
                    codes[i : i + ROWS, p], far = nearest(x[i : i + ROWS, p], books[p])
                    errors[i : i + ROWS] += far
            at = np.flatnonzero(b.column("v").is_valid().to_numpy(zero_copy_only=False))
            code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            code[at], error[at] = [c.tobytes().hex() for c in codes], errors
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = StructType([vectors.schema["vec_id"], vectors.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    return map_arrow(vectors.select("vec_id", "label", "v"), over, schema)


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that is not null and has
    only finite components.

    Repeated rows and ids keep a row each; rows with a null id are coded but never start a codebook. A
    vector that cannot be coded (its length is not that of the codebooks, or a scaled component is beyond
    LARGEST) has a null code and error and counts nowhere. With fewer ids than entries the codebooks are
    smaller; an empty table gives no rows. label_error adds up error over equal labels, null being one;
    other columns are not read. entries is 256 at most, two hex digits.
    """
    kept = whole_numbers(vectors, vec_id, vector, label)
    books = first_books(kept, entries, parts)
    able = (F.size("v") == books.shape[0] * books.shape[2]) & F.forall("v", lambda e: F.abs(e) <= LARGEST) & F.lit(books.size > 0)
    ready = kept.withColumn("v", F.when(able, F.col("v")))
    books = train(ready.filter("v IS NOT NULL"), books, rounds)
    coded = cut(encode(ready, books))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(n: int, source: str) -> str:
    """SQL of one assignment a<n> to codebooks <source>, and of the codebooks b<n> that it moves them to."""
    return f"""
far{n} AS (SELECT v.vec_id, v.p, c.e, sum((v.x - c.x) * (v.x - c.x)) AS far FROM cells v JOIN {source} c ON v.p = c.p AND v.j = c.j GROUP BY ALL),
a{n} AS (SELECT vec_id, p, e, far FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) AS r FROM far{n}) WHERE r = 1),
m{n} AS (SELECT v.p, a.e, v.j, sum(v.x) AS s, count(*) AS n FROM cells v JOIN a{n} a ON v.vec_id = a.vec_id AND v.p = a.p GROUP BY ALL),
b{n} AS (SELECT c.p, c.e, c.j, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM {source} c LEFT JOIN m{n} m ON m.p = c.p AND m.e = c.e AND m.j = c.j),"""


#: DuckDB SQL for vector_codes of embeddings with distinct ids and vectors of one length.
ORACLE = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
cells AS (SELECT vec_id, i // w AS p, i % w AS j, x FROM (SELECT vec_id, len(v) // {PARTS} AS w, unnest(v) AS x, unnest(range(len(v))) AS i FROM kept)),
b0 AS (SELECT cells.p, s.e, cells.j, cells.x FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) s ON s.vec_id = cells.vec_id),
{"".join(_round(n, f"b{n - 1}") for n in range(1, ROUNDS + 2))}
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS + 1} GROUP BY vec_id)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept k JOIN coded ON coded.vec_id = k.vec_id
"""
