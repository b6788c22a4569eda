"""Quality rules by document and by host. SQL functions only.

A document is judged by its own text first. What it fails is then added up by host: each host's rate of
failure of a rule is shrunk towards all hosts' rate by a beta prior whose strength is estimated from how
much hosts differ, and a host whose rate surely passes a limit takes its documents with it.

A text is worked through within its row: no word leaves it, so nothing is shuffled but sums by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.durable import cut, one

BLANKS = " \t\n\x0b\x0c\r"
SIGNS = "#*$%&|<>"
#: Words of a window that is looked for twice.
WINDOW = 8
#: A host goes if its shrunk rate of a rule, less SURE standard deviations, is above LIMIT.
LIMIT, SURE = 0.5, 1.645
#: Hosts that go may be sent to all tasks up to so many rows.
BROADCAST_HOSTS = 100_000

#: Rules on the columns of `statistics`; a document fails one where it holds. The first two fail the base.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repeats")


def host_of(value: Column) -> Column:
    """The host of a URL, or a name as it is; lower case, without user, port and `www.`. Null if it is empty."""
    bare = F.regexp_replace(F.lower(F.btrim(value)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"(?::\d+)?(?:[/?#].*)?$", ""), r"^www\.", ""), F.lit(""))


def _once(c: Column) -> Column:
    """c as a generator: the optimizer would else work it out anew for each use."""
    return F.explode(F.array(c))


def _covered(starts: Column) -> Column:
    """How many words windows with these ascending starts cover together."""
    return F.aggregate(F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)


def _met_twice(pairs: Column, of: str) -> Column:
    """The `at` of sorted structs whose field `of` is that of a neighbour."""
    same = lambda x, k: F.coalesce(x[of] == F.get(pairs, k)[of], F.lit(False))
    twice = F.transform(pairs, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["at"]))
    return F.filter(twice, lambda at: at.isNotNull())


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs less `text`, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Null texts count as empty: all are 0. n_lines are lines that hold a word. docs must have none of these
    columns, nor one that begins with `hr_`.
    """
    body, others = F.coalesce(F.col(text), F.lit("")), [c for c in docs.columns if c != text]
    length = lambda c: F.length(c).cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    seen = docs.select(
        *others, length(F.translate(body, BLANKS, "")).alias("word_chars"), (F.length(body) - F.length(F.translate(body, SIGNS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("hr_words"), _once(lines).alias("hr_lines"),
    )
    others += ["word_chars", "n_symbols"]
    size = lambda c: F.size(c).cast("long")
    seen = seen.select(*others, size("hr_lines").alias("n_lines"), (F.size("hr_lines") - F.size(F.array_distinct("hr_lines"))).cast("long").alias("n_dup_lines"), _once(F.col("hr_words")).alias("hr_words"))
    others += ["n_lines", "n_dup_lines"]
    # hashes of one, two, four and eight words from each place on
    step = seen.select(*others, "hr_words", size("hr_words").alias("n_words"), _once(F.transform("hr_words", lambda w: F.xxhash64(w))).alias("hr_1"))
    others += ["n_words"]
    for k in (1, 2, 4):
        h, n = F.col(f"hr_{k}"), F.size(f"hr_{k}") - k
        wide = F.when(n > 0, F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(h, k + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.expr("array()").cast("array<bigint>"))
        step = step.select(*others, "hr_words", _once(wide).alias(f"hr_{2 * k}"))
    # texts without an equal pair of hashes end here; for others places with equal hashes, then equal words
    hashed = F.transform(f"hr_{WINDOW}", lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    step = step.select(*others, "hr_words", _once(F.when(F.size(F.array_distinct(f"hr_{WINDOW}")) < F.size(f"hr_{WINDOW}"), F.sort_array(hashed))).alias("hr_pairs"))
    step = step.select(*others, "hr_words", _once(_met_twice(F.col("hr_pairs"), "h")).alias("hr_at"))
    worded = F.transform("hr_at", lambda at: F.struct(F.slice("hr_words", at + 1, WINDOW).alias("w"), at.alias("at")))
    step = step.select(*others, _once(F.sort_array(worded)).alias("hr_pairs"))
    step = step.select(*others, _once(F.sort_array(_met_twice(F.col("hr_pairs"), "w"))).alias("hr_at"))
    return step.select(*others, F.coalesce(_covered(F.col("hr_at")), F.lit(0)).cast("long").alias("n_repeat_words"))


def failures(judged: DataFrame) -> DataFrame:
    """judged, rows of `statistics`, with a boolean fails_<rule> for each rule, and base_failed."""
    failed = judged.withColumns({f"fails_{r}": F.expr(x) for r, x in RULES.items()})
    return failed.withColumn("base_failed", F.expr(" OR ".join(f"fails_{r}" for r in BASE)))


def host_counts(failed: DataFrame) -> DataFrame:
    """(host, n, f_<rule>...): documents of each host and how many fail each rule. Rows without a host are
    left out."""
    counts = [F.count_if(f"fails_{r}").cast("long").alias(f"f_{r}") for r in RULES]
    return failed.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *counts)


def prior(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """(a, b) of the beta prior of each rule whose rates differ between hosts by more than chance.

    By moments: the intra-class correlation rho of failures within hosts, weighted by their documents, gives
    a + b = 1 / rho - 1, and the rate over all gives a / (a + b). Rules with a rate of 0 or 1, a single
    host, or no more spread than chance have none. One row reaches the driver.
    """
    parts = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn")]
    parts += [x for r in RULES for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}").cast("double") ** 2 / F.col("n")).alias(f"ff_{r}"))]
    t, found = one(counts.agg(*parts)), {}
    for r in RULES:
        if t["hosts"] < 2 or not 0 < t[f"f_{r}"] < t["n"]:
            continue
        rate = t[f"f_{r}"] / t["n"]
        spread, chance = t[f"ff_{r}"] - t["n"] * rate**2, rate * (1 - rate)
        room = chance * (t["n"] - t["nn"] / t["n"] - (t["hosts"] - 1))
        rho = (spread - chance * (t["hosts"] - 1)) / room if room > 0 else 0
        if rho > 0:
            strength = 1 / min(rho, 0.999) - 1
            found[r] = (rate * strength, (1 - rate) * strength)
    return found


def host_verdicts(counts: DataFrame, priors: dict[str, tuple[float, float]]) -> DataFrame:
    """counts with rate_<rule> (double, the shrunk rate; null without a prior) and rejected (boolean)."""
    rates, bad = {}, F.lit(False)
    for r in RULES:
        if r not in priors:
            rates[f"rate_{r}"] = F.lit(None).cast("double")
            continue
        a, b = priors[r]
        all_ = F.col("n") + a + b
        rate = (F.col(f"f_{r}") + a) / all_
        rates[f"rate_{r}"] = rate
        bad = bad | (rate - SURE * F.sqrt(rate * (1 - rate) / (all_ + 1)) > LIMIT)
    return counts.select("*", *[c.alias(name) for name, c in rates.items()], bad.alias("rejected"))


def host_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host, host_rejected,
    kept), a row for each row of docs.

    Null and empty texts have no words and fail the base. Rows without a host (null, or nothing left of it)
    get no host's verdict. Repeated rows count and are judged each; other columns are not read. An empty
    table gives no rows. The statistics are computed once, written, and read for the sums and for the join;
    the join carries no text and only hosts that are rejected.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), host_of(F.col(host).cast("string")).alias("host"), F.col(text).alias("hr_text"))
    failed = cut(failures(statistics(rows, "hr_text")))
    counts = host_counts(failed)
    bad = host_verdicts(counts, prior(counts)).filter("rejected").select(F.col("host").alias("gone"))
    if one(bad.agg(F.count("*")))[0] <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = failed.join(bad, F.col("host") == F.col("gone"), "left").withColumn("host_rejected", F.col("gone").isNotNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def _oracle() -> str:
    sums = ", ".join(f"sum(f_{r}) / sum(n) AS p_{r}, sum(f_{r} * f_{r} / n) AS ff_{r}" for r in RULES)
    spread = lambda r: f"p_{r} * (1 - p_{r})"
    rho = ", ".join(f"CASE WHEN hosts > 1 AND {spread(r)} > 0 THEN (ff_{r} - n * p_{r} * p_{r} - {spread(r)} * (hosts - 1)) / nullif({spread(r)} * (n - nn / n - (hosts - 1)), 0) END AS rho_{r}" for r in RULES)
    strength = ", ".join(f"CASE WHEN rho_{r} > 0 THEN 1 / least(rho_{r}, 0.999) - 1 END AS s_{r}" for r in RULES)
    rate = ", ".join(f"(f_{r} + p_{r} * s_{r}) / (h.n + s_{r}) AS q_{r}, h.n + s_{r} + 1 AS m_{r}" for r in RULES)
    bad = " OR ".join(f"coalesce(q_{r} - {SURE} * sqrt(q_{r} * (1 - q_{r}) / m_{r}) > {LIMIT}, false)" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, lower(source) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w[i:i + {WINDOW - 1}] AS x FROM w WHERE len(w) > {WINDOW})),
rep AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY r),
s AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SIGNS}', '')) AS BIGINT) AS n_symbols,
      len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.r = w.r),
f AS (SELECT *, {", ".join(f"({x}) AS fails_{r}" for r, x in RULES.items())} FROM s),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (WHERE fails_{r}) AS DOUBLE) AS f_{r}" for r in RULES)} FROM f WHERE host IS NOT NULL GROUP BY host),
t AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, {sums} FROM h),
u AS (SELECT *, {strength} FROM (SELECT *, {rho} FROM t)),
q AS (SELECT host, {rate} FROM h, u),
bad AS (SELECT host FROM q WHERE {bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(f"fails_{r}" for r in BASE)} AS base_failed,
       NOT ({" OR ".join(f"fails_{r}" for r in BASE)}) AND bad.host IS NULL AS kept
FROM f LEFT JOIN bad ON bad.host = f.host
"""


#: DuckDB SQL for op12 of documents whose sources are plain names.
ORACLE = _oracle()
