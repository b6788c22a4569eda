"""Chat formatting: a hidden Markov model recovers roles from raw transcripts, and turns get one form.

States are (role, first line of a turn or later line). A line emits three features: its speaker marker
("User:", "### Assistant", "Q:" and the like, or none), its shape (blank, question, starts small, other) and
its length. Transitions and emissions are smoothed counts of labelled transcripts. Viterbi's best path gives
each line's state; runs of lines become turns, markers go, and turns are rendered in one form.

A transcript may be of any length. It is cut into blocks of lines: max-plus products give each block's best
score from any state before it to any state at its end, the path over blocks fixes the states at their ends,
and each block is then solved on its own. The result equals one search over the whole transcript.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.durable import cut, map_arrow

ROLES = ("system", "user", "assistant")
# Names that speaker markers use, by role.
MARKERS = {"system": ("system", "sys", "instruction", "instructions"), "user": ("user", "human", "q", "question", "customer", "me"), "assistant": ("assistant", "ai", "bot", "a", "answer", "model")}
SHAPES, LENGTHS = 4, 4
STATES = len(ROLES) * 2
#: Turns in a block; a block and a turn must each fit a task.
BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"


def _marker_pattern(names: tuple[str, ...]) -> str:
    return r"(?i)^\s*[#>*\[(-]*\s*(?:" + "|".join(names) + r")[ \t]*[\])*]*[ \t]*(?:[:>]\**|(?=\n)|$)"


def marker(line: Column) -> Column:
    """0: none, else 1 + the role's place."""
    out = F.lit(0)
    for k, r in reversed([*enumerate(ROLES)]):
        out = F.when(line.rlike(_marker_pattern(MARKERS[r])), F.lit(k + 1)).otherwise(out)
    return out


def features(line: Column) -> Column:
    """The line's symbol: marker, shape and length in one number."""
    shape = F.when(F.trim(line) == "", 0).when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"^\s*[a-zß-öø-ÿ]"), 2).otherwise(3)
    n = F.length(line)
    length = F.when(n <= 24, 0).when(n <= 120, 1).when(n <= 400, 2).otherwise(3)
    return ((marker(line) * SHAPES + shape) * LENGTHS + length).cast("int")


@dataclass
class Model:
    start: np.ndarray  # STATES
    step: np.ndarray  # STATES x STATES
    emit: np.ndarray  # STATES x symbols


def _logs(counts: np.ndarray, smooth: float) -> np.ndarray:
    counts = counts + smooth
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def fit(lines: DataFrame, turns: DataFrame) -> Model:
    """From labelled lines (role, first, symbol) and turns (conv_id, turn, role): sums over all rows, of which
    only tables of fixed size reach the driver. Other roles and nulls are left out; without any rows all
    is uniform. Each feature counts on its own (naive Bayes), so unseen combinations keep sense."""
    symbols = (len(ROLES) + 1) * SHAPES * LENGTHS
    place = {r: k for k, r in enumerate(ROLES)}
    seen, after, begin = np.zeros((STATES, symbols)), np.zeros((len(ROLES), len(ROLES))), np.zeros(len(ROLES))
    for r in lines.filter(F.col("role").isin(*ROLES)).groupBy("role", "first", "symbol").count().collect():
        seen[place[r["role"]] * 2 + (0 if r["first"] else 1), r["symbol"]] += r["count"]
    known = turns.filter(F.col("role").isin(*ROLES) & F.col("turn").isNotNull())
    follow = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for r in known.join(follow, ["conv_id", "turn"]).groupBy("role", "next").count().collect():
        after[place[r["role"]], place[r["next"]]] += r["count"]
    for r in known.filter("turn = 0").groupBy("role").count().collect():
        begin[place[r["role"]]] += r["count"]
    grid = seen.reshape(STATES, len(ROLES) + 1, SHAPES, LENGTHS)
    parts = [_logs(grid.sum((2, 3)), 0.5)[:, :, None, None], _logs(grid.sum((1, 3)), 0.5)[:, None, :, None], _logs(grid.sum((1, 2)), 0.5)[:, None, None, :]]
    emit = (parts[0] + parts[1] + parts[2]).reshape(STATES, symbols)
    first, more = seen[0::2].sum(1) + 1, seen[1::2].sum(1) + 1
    stay = more / (first + more)
    step = np.full((STATES, STATES), -np.inf)
    turn = _logs(after, 0.5)
    for k in range(len(ROLES)):
        for s in (2 * k, 2 * k + 1):
            step[s, 2 * k + 1] = np.log(stay[k])
            step[s, 0::2] = np.log(1 - stay[k]) + turn[k]
    start = np.full(STATES, -np.inf)
    start[0::2] = _logs(begin, 0.5)
    return Model(start, step, emit)


def transfer(model: Model, symbols: np.ndarray, first: bool) -> np.ndarray:
    """Best score from each state before these lines to each state at their end; for the first lines of a
    transcript all rows are alike."""
    m = None
    for k in symbols.tolist():
        if m is None:
            m = np.tile(model.start, (STATES, 1)) if first else model.step.copy()
        else:
            m = (m[:, :, None] + model.step[None]).max(axis=1)
        m = m + model.emit[:, k]
    return m


def best_path(model: Model, symbols: np.ndarray, before: int | None, end: int | None) -> np.ndarray:
    """The best states of these lines after state `before` (None: the transcript begins) up to state `end`."""
    n = len(symbols)
    back = np.zeros((n, STATES), np.int64)
    score = (model.start if before is None else model.step[before]) + model.emit[:, symbols[0]]
    for t in range(1, n):
        every = score[:, None] + model.step
        back[t] = every.argmax(axis=0)
        score = every.max(axis=0) + model.emit[:, symbols[t]]
    out = np.zeros(n, np.int64)
    out[-1] = int(score.argmax()) if end is None else end
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of adjacent rows with equal keys, over batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        codes = np.zeros(batch.num_rows, bool)
        codes[0] = True
        for k in keys:
            c = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            codes[1:] |= c[1:] != c[:-1]
        at = [*np.flatnonzero(codes).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = tuple(table.column(k)[a].as_py() for k in keys)
            if own != last and held:
                yield pa.concat_tables(held)
                held = []
            last = own
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _grouped(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for group in _runs(batches, keys):
            kept.append(run(group))
            if len(kept) == 500:
                yield from pa.concat_tables(kept).combine_chunks().to_batches()
                kept = []
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, *order), over, schema)


def parse(lines: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text, rendered), a row for each turn found in lines (conv_id, ord, line_no, line):
    the lines of raw transcripts in the order of (ord, line_no). Blocks hold `block` values of ord.

    turn counts from 0. A turn's text is its lines without speaker markers, less blank lines at its ends.
    Null lines count as empty; rows with a null conv_id, ord or line_no are left out, and of rows that repeat
    all three the one with the smallest line counts. Other columns are not read.
    """
    base = lines.filter("conv_id is not null and ord is not null and line_no is not null").groupBy("conv_id", "ord", "line_no").agg(F.min(F.coalesce("line", F.lit(""))).alias("line"))
    base = base.select("conv_id", F.floor(F.col("ord") / block).cast("long").alias("block"), "ord", "line_no", "line", features(F.col("line")).alias("symbol"))
    base = cut(base)
    firsts = base.groupBy("conv_id").agg(F.min("block").alias("first_block"))
    base = base.join(firsts, "conv_id")

    def products(g: pa.Table) -> pa.Table:
        first = g.column("block")[0] == g.column("first_block")[0]
        m = transfer(model, g.column("symbol").to_numpy(), first)
        return pa.table({"conv_id": g.column("conv_id").slice(0, 1), "block": g.column("block").slice(0, 1), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    def over_blocks(g: pa.Table) -> pa.Table:
        ms = np.array(g.column("m").to_pylist()).reshape(-1, STATES, STATES)
        score, back = ms[0][0], []
        for m in ms[1:]:
            every = score[:, None] + m
            back.append(every.argmax(axis=0))
            score = every.max(axis=0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pa.table({"conv_id": g.column("conv_id"), "block": g.column("block"), "before": pa.array([None, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32())})

    matrices = _grouped(base.select("conv_id", "block", "first_block", "ord", "line_no", "symbol"), ["conv_id", "block"], ["ord", "line_no"], products, "conv_id long, block long, m array<double>")
    fixed = _grouped(matrices, ["conv_id"], ["block"], over_blocks, "conv_id long, block long, before int, end int")

    def states(g: pa.Table) -> pa.Table:
        path = best_path(model, g.column("symbol").to_numpy(), g.column("before")[0].as_py(), g.column("end")[0].as_py())
        turn = np.cumsum(path % 2 == 0)
        text, at = g.column("line").to_pylist(), np.concatenate(([0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]))
        rows = [(int(turn[a]), ROLES[path[a] // 2], "\n".join(text[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = len(rows)
        return pa.table({"conv_id": pa.array([g.column("conv_id")[0].as_py()] * n, pa.int64()), "block": pa.array([g.column("block")[0].as_py()] * n, pa.int64()), "n": pa.array([r[0] for r in rows], pa.int64()), "role": pa.array([r[1] for r in rows]), "text": pa.array([r[2] for r in rows])})

    solved = base.join(fixed, ["conv_id", "block"]).select("conv_id", "block", "ord", "line_no", "line", "symbol", "before", "end")
    pieces = cut(_grouped(solved, ["conv_id", "block"], ["ord", "line_no"], states, "conv_id long, block long, n long, role string, text string"))

    def offsets(g: pa.Table) -> pa.Table:
        before = np.concatenate(([0], np.cumsum(g.column("turns").to_numpy())[:-1]))
        return pa.table({"conv_id": g.column("conv_id"), "block": g.column("block"), "offset": pa.array(before, pa.int64())})

    counts = _grouped(pieces.groupBy("conv_id", "block").agg(F.max("n").alias("turns")), ["conv_id"], ["block"], offsets, "conv_id long, block long, offset long")
    whole = pieces.join(counts, ["conv_id", "block"]).select("conv_id", (F.col("n") + F.col("offset") - 1).alias("turn"), "block", "role", "text")
    whole = whole.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("raw"))
    every = tuple(n for names in MARKERS.values() for n in names)
    text = F.regexp_replace("raw", _marker_pattern(every) + r"[ \t]*\n?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*\n)+", ""), r"\s+$", "")
    return whole.select("conv_id", "turn", "role", text.alias("text"), F.concat(F.lit(START), "role", F.lit("\n"), text, F.lit(f"{END}\n")).alias("rendered"))


def raw_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, ord, line_no, line, role, first) of conversations (conv_id, turn, role, text) as raw
    transcripts: one of four ways of marking speakers for each conversation, and no marker but a blank line
    at every fifth turn or so."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = lambda s, u, a: F.when(F.col("role") == "system", s).when(F.col("role") == "user", u).otherwise(a)
    head = F.when(style == 0, F.concat(name("System", "User", "Assistant"), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name("System", "Human", "AI"), F.lit(":\n"))).when(style == 2, F.concat(name("Instructions", "Q", "A"), F.lit(": "))).otherwise(F.concat(F.lit("["), name("system", "customer", "bot"), F.lit("]\n")))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0) & (F.col("turn") > 0)
    raw = F.concat(F.when(bare, F.lit("")).otherwise(head), F.coalesce("text", F.lit("")), F.when(F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(2)) == 0, F.lit("\n")).otherwise(F.lit("")))
    out = conversations.select("conv_id", F.col("turn").alias("ord"), "role", F.posexplode(F.split(raw, "\n")).alias("line_no", "line"))
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("ord").cast("long").alias("ord"), "line_no", "line", "role", (F.col("line_no") == 0).alias("first"))
