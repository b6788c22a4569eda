"""Fill-in-the-middle rewriting over relational units. SQL functions only.

A text is read as units: a run of letters A-Z, or one other code point. Cut points are unit ordinals. They
become character offsets relationally: matches are posexploded, a running sum over their lengths places
them, cut requests join them by ordinal, and the offsets of a document are aggregated and used by substring.

This happens on two levels. Matches of BLOCK units at a time (a regular expression cannot end one within a
unit) are placed first; only the blocks that a request falls into are exploded into single units. A text
has so far fewer rows to sort than units. Documents are dealt once, by key, and all that follows keeps that
partitioning: the one shuffle carries each text once, and no key has more rows than its text has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
BLOCK = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of texts that are rewritten, and of those the percent with the suffix first.
RATE, SPM = 90, 20

#: DuckDB SQL for fill_middle of documents.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '{UNIT}') AS u, [CAST('0x' || h[1 + 8 * i:8 + 8 * i] AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {RATE} THEN 'plain'
           WHEN h[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || x || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def n_units(text: Column) -> Column:
    """How many units a text has: each is one code point once runs of letters are."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a"))


def draw(doc_id: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits of the id's hash, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 8 * i + 1, 8), 16, 10).cast("long")


def plans(texts: DataFrame) -> DataFrame:
    """Rows (k, doc_id, text, n) with form, first and second: which form the text of n units gets, and the
    unit ordinals after which prefix and middle end, 0 where it is plain."""
    drawn = texts.select("k", "text", "n", *[draw(F.col("doc_id"), i).alias(f"h{i}") for i in range(4)])
    cuts = [F.col(f"h{i}") % (F.col("n") + 1) for i in range(2)]
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (F.col("h2") % 100 >= RATE)
    form = F.when(plain, "plain").when(F.col("h3") % 100 < SPM, "spm").otherwise("psm")
    planned = drawn.select("k", "text", "n", form.alias("form"), F.array(F.least(*cuts), F.greatest(*cuts)).alias("cuts"))
    return planned.select("k", "text", "form", *[F.when(F.col("form") != "plain", F.get("cuts", i)).otherwise(0).alias(c) for i, c in enumerate(("first", "second"))])


def _running(by: Column, *keys: str) -> Column:
    """The sum of chars over what comes before a row."""
    return F.coalesce(F.sum("chars").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def offsets(texts: DataFrame) -> DataFrame:
    """(k, form, first_at, second_at) of rows (k, doc_id, text, n), one row a k: the form, and the characters
    before the two cuts, null where the form is plain. Rows that share k must be equal."""
    requests = plans(texts).select("k", "form", F.explode(F.array("first", "second")).alias("ordinal"), (F.col("form") != "plain").alias("cut"))
    # not filtered here: a filter would move below the exchange and have the texts dealt once more. Ordinal 0 falls into no block
    asked = requests.select("k", "ordinal").distinct().select(F.col("k").alias("key"), "ordinal", F.floor((F.col("ordinal") - 1) / BLOCK).alias("of"))
    once = texts.groupBy("k").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "n")])
    blocks = plans(once).filter("form <> 'plain'").select("k", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?:{UNIT}){{1,{BLOCK}}}"), F.lit(0))).alias("block", "units"))
    placed = blocks.withColumn("chars", F.length("units")).select("k", "block", "units", _running(F.col("block"), "k").alias("before"))
    # equal keys alone are the join's keys, so that it keeps the partitioning; a document has two requests at most
    hit = placed.join(asked, (F.col("k") == F.col("key")) & (F.col("block") - F.col("of") == 0))
    units = hit.select("k", "ordinal", "of", "before", F.posexplode(F.regexp_extract_all("units", F.lit(UNIT), F.lit(0))).alias("unit", "x")).withColumn("chars", F.length("x"))
    summed = units.withColumn("at", F.col("before") + _running(F.col("unit"), "k", "ordinal") + F.col("chars"))
    found = summed.filter(F.col("of") * BLOCK + F.col("unit") + 1 - F.col("ordinal") == 0).select(F.col("k").alias("key"), F.col("ordinal").alias("asked"), "at")
    joined = requests.join(found, (F.col("k") == F.col("key")) & (F.col("ordinal") - F.col("asked") == 0), "left")
    at = F.when(F.col("cut"), F.coalesce("at", F.lit(0)))
    return joined.groupBy("k").agg(F.first("form").alias("form"), F.min(at).alias("first_at"), F.max(at).alias("second_at"))


def rewritten(text: Column, form: Column, first: Column, second: Column) -> Column:
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no marker, nor can one begin in a part and end in
    a marker, so the first of each kind is the one that was put there."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(a) + len(second) + 1, F.length(body))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(SUFFIX)
    late, early, last = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, last, late)).otherwise(output)


def fill_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of docs.

    Null texts count as empty; empty texts and those that hold a marker stay as they are (form plain, null
    lengths), as do a tenth of the others by the id's hash. A null id counts as the empty string. Rows that
    repeat an id are told apart by their text, rows that repeat both have equal results. Other columns are
    not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64(body)))
    # every branch of the plan needs all four columns, so that this exchange is made once and read again
    dealt = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), key.alias("k"), n_units(body).cast("long").alias("n")).repartition("k")
    out = dealt.join(offsets(dealt), "k")
    return out.select("doc_id", "n", "form", F.col("first_at").cast("long").alias("prefix_chars"), (F.col("second_at") - F.col("first_at")).cast("long").alias("middle_chars"), rewritten(F.col("text"), F.col("form"), F.col("first_at"), F.col("second_at")).alias("output"))


def digests(filled: DataFrame) -> DataFrame:
    """filled with hashes of output and of the text rebuilt from it in place of output."""
    return filled.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")
