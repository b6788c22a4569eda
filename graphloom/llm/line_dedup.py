"""Line dedup over overlapping windows of three lines. SQL functions only.

A text's lines are what newlines separate, trimmed of blanks, tabs and carriage returns; lines that
are then empty are left out of windows and never removed. Every three lines in a row are a window. Of
equal windows in the whole table the first, by (doc_id, position), stays; every other one covers its
three lines, and all lines covered are removed. In the document that holds the first occurrence, an
overlapping repeat covers only lines after it, so the first occurrence survives whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.durable import cut

BLANKS = " \t\r"
WINDOW = 3

#: DuckDB SQL for (doc_id, text, removed_lines) of documents with distinct ids.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
nb AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p
       FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT doc_id, p, t, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3 FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
occ AS (SELECT doc_id, p, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp FROM w WHERE t3 IS NOT NULL
        WINDOW o AS (PARTITION BY t, t2, t3 ORDER BY doc_id, p)),
cov AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(p, fp + 3) ELSE p END, p + 3)) AS q
        FROM occ WHERE doc_id <> fd OR p <> fp)),
gone AS (SELECT nb.doc_id, nb.i FROM nb JOIN cov ON nb.doc_id = cov.doc_id AND nb.p = cov.q)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END AS text,
       CAST(count(g.i) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id, d.text
"""


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `text` less its repeated lines, and a column removed_lines (long).

    Null and empty texts, texts of fewer than three lines and rows with a null id stay as they are.
    Rows that repeat both id and text count as one row and stay equal; rows that share only the id are
    told apart by their text. Other columns pass through; removed_lines is replaced if there is one, and names
    that begin with gl_ are reserved.
    """
    key = F.xxhash64(F.col(text))
    base = docs.filter(F.col(doc_id).isNotNull() & F.contains(F.col(text), F.lit("\n"))).select(F.col(doc_id).alias("id"), key.alias("tk"), F.col(text).alias("tx"))
    solid = F.filter(F.transform(F.split(F.col("tx"), "\n"), _trimmed), lambda x: x != "")
    hashed = base.select("id", "tk", F.transform(solid, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), F.reverse(x)).alias("b"))).alias("h")).filter(F.size("h") >= WINDOW)
    window = lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.col("h")[i + k]["a"] for k in range(WINDOW)]).alias("x"), F.xxhash64(*[F.col("h")[i + k]["b"] for k in range(WINDOW)]).alias("y"))
    windows = cut(hashed.select("id", "tk", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window))))
    first = windows.groupBy("x", "y").agg(F.min(F.struct("id", "tk", "p")).alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["x", "y"]).filter(F.struct("id", "tk", "p") != F.col("f"))
    start = F.when((F.col("id") == F.col("f.id")) & (F.col("tk") == F.col("f.tk")), F.greatest(F.col("p"), F.col("f.p") + WINDOW)).otherwise(F.col("p"))
    spans = later.select("id", "tk", start.alias("s"), (F.col("p") + WINDOW - 1).alias("e")).filter("s <= e")
    covered = spans.groupBy("id", "tk").agg(F.collect_set(F.struct("s", "e")).alias("gl_spans")).select(F.col("id").alias("gl_id"), F.col("tk").alias("gl_key"), "gl_spans")
    out = docs.drop("removed_lines").join(covered, (F.col(doc_id) == F.col("gl_id")) & (key == F.col("gl_key")), "left")
    # each exploded from an array of one: else the optimizer would make it anew for each line that uses it
    once = lambda x: F.explode(F.array(x))
    out = out.withColumn("gl_lines", once(F.when(F.col("gl_spans").isNotNull(), F.split(F.col(text), "\n"))))
    numbered = F.transform("gl_lines", lambda line, i: F.when(F.btrim(line, F.lit(BLANKS)) != "", i))
    out = out.withColumn("gl_solid", once(F.filter(numbered, lambda i: i.isNotNull())))
    gone = F.array_distinct(F.flatten(F.transform("gl_spans", lambda s: F.slice("gl_solid", s["s"] + 1, s["e"] - s["s"] + 1))))
    out = out.withColumn("gl_gone", once(gone))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("gl_lines") - 1), "gl_gone"), lambda i: F.get("gl_lines", i))
    new = F.when(F.col("gl_spans").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = out.withColumns({text: new, "removed_lines": F.coalesce(F.size("gl_gone"), F.lit(0)).cast("long")})
    return out.drop("gl_id", "gl_key", "gl_spans", "gl_lines", "gl_solid", "gl_gone")
