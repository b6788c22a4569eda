"""Progress of a discovery run: JSON lines as typed events, and the state of each agent with its deadline.

events() and agents() are plans over tables or streams of lines; agents_stream() keeps the same state in a
stream, where a timer at an agent's deadline closes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The events, with the fields that each must have and their types.
FIELDS = {
    "started": {"model": "string", "containers": "long", "journeys": "long", "scout": "boolean"},
    "stage": {"stage": "string"},
    "agent_started": {"role": "string", "name": "string"},
    "agent_activity": {"role": "string", "kind": "string"},
    "agent_done": {"role": "string", "ok": "boolean", "cost_usd": "double", "secs": "double"},
    "survey_done": {"system": "variant", "people": "array<variant>", "externals": "array<variant>", "containers": "array<variant>"},
    "proposed": {"flows": "array<variant>"},
    "container_done": {"container": "variant"},
    "journey_done": {"journey": "variant"},
    "verified": {"atlas": "variant"},
}
OPTIONAL = {"target": "string", "path": "string", "query": "string", "error": "string"}
ACTIVITY = {"reading": "path", "searching": "query"}
TIMEOUT = 600  # seconds that an agent may take
REMEMBERED = 86_400  # seconds for which a stream knows an agent after its deadline
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what agents_stream needs as spark.sql.streaming.stateStore.providerClass
AGENT = ["run", "role", "target"]


def events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of JSON as events: the columns of lines but `line`, then event, a column for each plain field, body
    and problem.

    body is the parsed line as a VARIANT, which has what a survey, a container, a journey or a model brings
    along. A line that is null or no JSON object, names no or an unknown event, or lacks a field that its event
    must have (or has one that does not fit its type) stays: event and fields are null, problem says why and
    raw has the line; raw is null in good rows. Columns of lines that are named as one of these are replaced.
    """
    # a generated column: a filter on an event would otherwise be pushed below the parse, and parse for each field
    body = F.explode(F.array(F.try_parse_json(F.col(line))))
    at = lambda name, kind: F.try_variant_get(F.col("body"), f"$.{name}", kind)
    lacks = F.lit(None).cast("string")
    for event, fields in FIELDS.items():
        for name, kind in fields.items():
            lacks = F.when((F.col("event") == event) & at(name, kind).isNull(), F.lit(f"{event} without {name}")).otherwise(lacks)
    for kind, name in ACTIVITY.items():
        lacks = F.when((F.col("event") == "agent_activity") & (at("kind", "string") == kind) & at(name, "string").isNull(), F.lit(f"{kind} without {name}")).otherwise(lacks)
    problem = F.when(F.col("body").isNull(), "not JSON").when(F.col("event").isNull(), "no event").when(~F.col("event").isin(*FIELDS), F.concat(F.lit("unknown event "), F.col("event")))
    problem = problem.when((F.col("event") == "agent_activity") & ~at("kind", "string").isin(*ACTIVITY), "unknown activity").otherwise(lacks)
    plain = {n: k for f in FIELDS.values() for n, k in f.items() if "variant" not in k} | OPTIONAL
    good = F.col("problem").isNull()
    read = lines.withColumn("raw", F.col(line)).withColumn("body", body).withColumn("event", at("event", "string")).withColumn("problem", problem)
    # a survey's containers are a list, those of a start a number: a plain column has the fields of its own events
    owners = {n: [e for e, f in FIELDS.items() if f.get(n) == k] for n, k in plain.items()}
    fields = {n: F.when(good & F.col("event").isin(*owners[n]) if owners[n] else good, at(n, k)) for n, k in plain.items()}
    read = read.withColumns(fields).withColumn("raw", F.when(~good, F.col("raw"))).withColumn("event", F.when(good, F.col("event")))
    return read if line in {"raw", "body", "event", "problem", *plain} else read.drop(line)


def _moves(progress: DataFrame) -> DataFrame:
    """What agents do: run, role, target ('' if none), second, at (microseconds), seq and the fields of events
    (run, ts, seq and those of events())."""
    on = progress.filter(F.col("event").isin("agent_started", "agent_activity", "agent_done") & F.col("ts").isNotNull())
    current = F.when(F.col("kind") == "reading", F.col("path")).when(F.col("kind") == "searching", F.trim(F.concat(F.lit("searching "), F.coalesce("query", F.lit("")))))
    return on.select("run", "role", F.coalesce("target", F.lit("")).alias("target"), F.unix_seconds("ts").alias("second"), F.unix_micros("ts").alias("at"), "seq", "event", "kind", current.alias("current"), "name", "ok", "cost_usd", "secs", "error", "ts")


def stopped(timeout: int) -> str:
    return f"agent took longer than {timeout}s and was stopped"


def agents(progress: DataFrame, as_of: Column, timeout: int = TIMEOUT) -> DataFrame:
    """(run, role, target, name, status, reads, current, cost_usd, secs, error) of each agent, from what
    happened before as_of (a timestamp).

    An agent begins with the first of its events and has `timeout` seconds (in whole seconds of the clock);
    what comes at its deadline or later does not count. It is `done` or `failed` by its first end that counts,
    else `timed out` if as_of has reached the deadline, else `running`. current is its latest activity while it
    runs. Ties go by seq. Events are aggregated where they are and joined to beginnings by agent, so no group
    is held whole.
    """
    moves = _moves(progress.filter(F.col("ts") < as_of))
    begun = moves.groupBy(*AGENT).agg((F.min("second") + timeout).alias("deadline"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in AGENT]
    counted = moves.alias("m").join(begun.alias("b"), same).filter("second < deadline").select("m.*", "deadline")
    order = F.struct("at", "seq")
    end = F.min_by(F.struct("ok", "cost_usd", "secs", "error"), F.when(F.col("event") == "agent_done", order)).alias("end")
    of = counted.groupBy(*AGENT, "deadline").agg(
        F.min_by("name", F.when(F.col("event") == "agent_started", order)).alias("name"), F.count_if(F.col("kind") == "reading").alias("reads"),
        F.max_by("current", F.when(F.col("event") == "agent_activity", order)).alias("current"), F.bool_or(F.col("event") == "agent_done").alias("ended"), end,
    )
    late = F.unix_seconds(as_of) >= F.col("deadline")
    status = F.when(F.col("ended"), F.when(F.col("end.ok"), "done").otherwise("failed")).when(late, "timed out").otherwise("running")
    zero = lambda c: F.when(F.col("ended"), F.col(c)).otherwise(0.0)
    error = F.when(F.col("ended"), F.col("end.error")).when(late, F.lit(stopped(timeout)))
    return of.select(*AGENT, "name", status.alias("status"), "reads", F.when(status == "running", F.col("current")).alias("current"), zero("end.cost_usd").alias("cost_usd"), zero("end.secs").alias("secs"), error.alias("error"))


class _Agent(StatefulProcessor):
    """One agent's state: its beginning, its first end, and its activity by second, at most `timeout` entries
    and those of the late. A timer at the deadline gives the last row and clears all but a mark, which a second
    timer clears."""

    def __init__(self, timeout: int, remembered: int):
        self.timeout, self.remembered = timeout, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "second long, closed boolean")
        self.name = handle.getValueState("name", "at long, seq long, name string")
        self.end = handle.getValueState("end", "at long, seq long, ok boolean, cost_usd double, secs double, error string")
        self.seconds = handle.getMapState("seconds", "second long", "reads long, at long, seq long, current string")

    def _first(self, state, rows: pd.DataFrame, columns: list[str]) -> None:
        if len(rows):
            r = rows.sort_values(["at", "seq"]).iloc[0]
            if not state.exists() or (int(r["at"]), int(r["seq"])) < tuple(state.get()[:2]):
                state.update((int(r["at"]), int(r["seq"]), *[None if pd.isna(r[c]) else r[c].item() if hasattr(r[c], "item") else r[c] for c in columns]))

    def _row(self, key: tuple, status_at: int, final: bool) -> pd.DataFrame:
        deadline = self.begun.get()[0] + self.timeout
        reads, last = 0, None
        for (second,), (n, *latest) in self.seconds.iterator():
            if second < deadline:
                reads += n
                last = latest if last is None or latest[:2] > last[:2] else last
        end = self.end.get() if self.end.exists() else None
        if end and end[0] // 1_000_000 >= deadline:
            end = None
        name = self.name.get() if self.name.exists() else None
        late = status_at >= deadline
        status = ("done" if end[2] else "failed") if end else "timed out" if late else "running"
        error = end[5] if end else stopped(self.timeout) if late else None
        named = name[2] if name and name[0] // 1_000_000 < deadline else None
        return pd.DataFrame([(*key, named, status, reads, last[2] if last and status == "running" else None, end[3] if end else 0.0, end[4] if end else 0.0, error, final)], columns=[*AGENT, "name", "status", "reads", "current", "cost_usd", "secs", "error", "final"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.begun.exists() and self.begun.get()[1]:
            return
        for part in rows:
            first = int(part["second"].min())
            if not self.begun.exists() or first < self.begun.get()[0]:
                if self.begun.exists():
                    self.handle.deleteTimer((self.begun.get()[0] + self.timeout) * 1000)
                self.begun.update((first, False))
                self.handle.registerTimer((first + self.timeout) * 1000)
            self._first(self.name, part[part["event"] == "agent_started"], ["name"])
            self._first(self.end, part[part["event"] == "agent_done"], ["ok", "cost_usd", "secs", "error"])
            active = part[(part["event"] == "agent_activity") & (part["second"] < self.begun.get()[0] + self.timeout)]
            for second, some in active.sort_values(["at", "seq"]).groupby("second"):
                newest = some.iloc[-1]
                n, at, seq, current = int((some["kind"] == "reading").sum()), int(newest["at"]), int(newest["seq"]), newest["current"]
                if self.seconds.containsKey((int(second),)):
                    old = self.seconds.getValue((int(second),))
                    n += old[0]
                    if tuple(old[1:3]) > (at, seq):
                        at, seq, current = old[1:]
                self.seconds.updateValue((int(second),), (n, at, seq, current))
        yield self._row(key, timerValues.getCurrentWatermarkInMs() // 1000, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begun = self.begun.get()
        if begun is None:
            return
        if begun[1]:
            self.begun.clear()
            return
        yield self._row(key, expiredTimerInfo.getExpiryTimeInMs() // 1000, True)
        for state in (self.name, self.end, self.seconds):
            state.clear()
        self.begun.update((begun[0], True))
        self.handle.registerTimer((begun[0] + self.timeout + self.remembered) * 1000)

    def close(self) -> None:
        pass


def agents_stream(progress: DataFrame, delay: str, timeout: int = TIMEOUT, remembered: int = REMEMBERED) -> DataFrame:
    """agents() of a stream of events (run, ts, seq and those of events()), in update mode: a row of each agent
    that moved, and a last one, `final`, once the watermark (ts less delay) has reached its deadline.

    The final rows equal those of agents(), in whatever order events come, as long as none is later than delay.
    Spark drops later ones. An agent is known for `remembered` seconds after its deadline; after that its events
    would begin another of the same name. The session needs STATE_STORE.
    """
    moves = _moves(progress.withWatermark("ts", delay)).withColumns({c: F.coalesce(c, F.lit("")) for c in AGENT}).withColumn("seq", F.coalesce("seq", F.lit(0)))
    schema = "run string, role string, target string, name string, status string, reads long, current string, cost_usd double, secs double, error string, final boolean"
    return moves.groupBy(*AGENT).transformWithStateInPandas(_Agent(timeout, remembered), schema, "Update", "EventTime")
