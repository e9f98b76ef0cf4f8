"""Streams with a timer for each key: saves after a pause, and edits that settle, are refused or run out of time.

Both take a key's rows in the order of their times, whatever batches they came in. Rows wait in state until the watermark
has passed them, so that the result doesn't depend on how the stream was cut; then they are folded one by one, together
with the deadlines that lie between them. A key has one timer at a time: for its first waiting row or its deadline,
whichever comes first. When nothing waits and no deadline is open, nothing is kept of a key.

Late rows: what is older than the watermark when it arrives is dropped by Spark, which counts it in the progress of the
query; what comes out is therefore final, and append mode is the only one. What a key holds is bounded by what comes in
for it within a batch and the lateness that is allowed; batches are bounded at the source.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.streaming.debounce import MOVES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The state from which nothing leads on; the edit's key may begin anew.
SETTLED = {s for moves in MOVES.values() for s in moves} - set(MOVES)


class InOrder(StatefulProcessor):
    """Folds the rows of a key in the order of their times. Rows are (at, *payload), `at` in microseconds.

    What is held of a key is a tuple, of which the first field is its deadline in microseconds.
    """

    def __init__(self, columns: list[str], row: str, held: str, out: list[str]):
        self.columns, self.row, self.kept, self.out = columns, row, held, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.held = handle.getValueState("held", self.kept)

    @abstractmethod
    def step(self, held: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """What is held after a row, and what comes out."""

    @abstractmethod
    def due(self, held: tuple) -> list[tuple]:
        """What comes out when the deadline passes; nothing is held afterwards."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(new)
        self.wake(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple((x is not None, x) for x in r)) if self.waiting.exists() else []
        held, out = tuple(self.held.get()) if self.held.exists() else None, []
        ready = [r for r in rows if r[0] <= passed]
        for row in ready:
            if held is not None and row[0] > held[0]:
                out += self.due(held)
                held = None
            held, more = self.step(held, row)
            out += more
        if held is not None and held[0] <= passed:
            out += self.due(held)
            held = None
        self.keep(held, rows[len(ready) :])
        return iter([Row(*self.out)(*key, *x) for x in out])

    def keep(self, held: tuple | None, rest: list[tuple]) -> None:
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        ends = [r[0] for r in rest[:1]] + ([held[0]] if held is not None else [])
        if ends:
            self.wake(min(ends))

    def wake(self, at: int) -> None:
        """A timer for that time, unless there is an earlier one."""
        ms, timers = -(-at // 1000), list(self.handle.listTimers())
        if not timers or ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)


class Saves(InOrder):
    """deadline, edits so far, and the last one's content."""

    def __init__(self, columns: list[str], row: str, held: str, out: list[str], pause: int):
        super().__init__(columns, row, held, out)
        self.pause = pause

    def step(self, held, row):
        return (row[0] + self.pause, held[1] + 1 if held else 1, *row[1:]), []

    def due(self, held):
        return [held]


class Outcomes(InOrder):
    """deadline and state; rows are (at, order, status)."""

    def __init__(self, columns: list[str], row: str, held: str, out: list[str], limit: int):
        super().__init__(columns, row, held, out)
        self.limit = limit

    def step(self, held, row):
        at, _, status = row
        before = held[1] if held else None
        if status not in (MOVES.get(before, []) if before else ["pending"]):
            return held, [(at, before, status, "refused")]
        if status in SETTLED:
            return None, [(at, before, status, "settled")]
        return (at + self.limit, status), []

    def due(self, held):
        return [(held[0], held[1], None, "expired")]


class Live(StatefulProcessor):
    """The same moves by the clock: outcomes come out at once, a timer ends edits that stay unsettled, and state that outlives its time is dropped by the store."""

    def __init__(self, columns: list[str], out: list[str], limit_ms: int, ttl_ms: int):
        self.columns, self.out, self.limit, self.ttl = columns, out, limit_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string", ttlDurationMs=self.ttl)

    def reset(self, status: str | None, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status is None:
            self.held.clear()
        else:
            self.held.update((status,))
            self.handle.registerTimer(now + self.limit)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, out = self.held.get()[0] if self.held.exists() else None, []
        for _, status in sorted((tuple(r[c] for c in self.columns) for r in rows), key=lambda r: (r[0], r[1] or "")):
            if status not in (MOVES.get(before, []) if before else ["pending"]):
                out.append((before, status, "refused"))
            elif status in SETTLED:
                out.append((before, status, "settled"))
                before = None
            else:
                before = status
        self.reset(before, timerValues.getCurrentProcessingTimeInMs())
        return iter([Row(*self.out)(*key, *x) for x in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.held.get()[0] if self.held.exists() else None
        self.held.clear()
        return iter([Row(*self.out)(*key, before, None, "expired")] if before else [])


def micros(interval: str) -> int:
    """An interval of days or less, such as "2 seconds", in microseconds."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def timed(edits: DataFrame, key: str, ts: str, *columns: str) -> DataFrame:
    """key, at (microseconds) and columns, grouped by the key. `ts` is a timestamp with a watermark; rows without a time are left out."""
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return edits.where(F.col(ts).isNotNull()).select(key, F.unix_micros(ts).alias("at"), *columns, ts)


def saves(edits: DataFrame, editor: str, ts: str, *content: str, pause: str = "2 seconds") -> DataFrame:
    """A row for each save, once it is certain: editor, saved_at, n_edits and the last edit's content, in append mode.

    The timer is the editor's and each edit starts it anew; the last edit's content is saved when it runs out. An edit at
    the very end of the pause still belongs to it. Of edits at one time the one with the greatest content counts.
    """
    rows = timed(edits, editor, ts, *content)
    payload = fields(edits, *content)
    out = [editor, "saved", "n_edits", *content]
    processor = Saves(["at", *content], f"at long, {payload}", f"deadline long, n long, {payload}", out, micros(pause))
    kind = f"{fields(edits, editor)}, saved long, n_edits long, {payload}"
    made = rows.groupBy(editor).transformWithState(processor, kind, "append", "eventTime")
    return made.select(editor, F.timestamp_micros("saved").alias("saved_at"), "n_edits", *content)


def outcomes(events: DataFrame, edit: str, ts: str, order: str, status: str, limit: str = "1 hours") -> DataFrame:
    """A row for each way in which an edit goes on to its end, in append mode: edit, at, before, status, outcome.

    settled: it reached a state that nothing leads on from, and its key is free for the next edit; refused: a move that
    isn't allowed in the state before it, which changes nothing; expired: no move came for `limit` after the last allowed
    one, and the edit is dropped. A move at the very end of that time still counts. Moves at one time are taken by
    `order`, which is a long.
    """
    rows = timed(events, edit, ts, order, status)
    processor = Outcomes(["at", order, status], "at long, step long, status string", "deadline long, state string", [edit, "t", "before", "status", "outcome"], micros(limit))
    made = rows.groupBy(edit).transformWithState(processor, f"{fields(events, edit)}, t long, before string, status string, outcome string", "append", "eventTime")
    return made.select(edit, F.timestamp_micros("t").alias("at"), "before", "status", "outcome")


def live_outcomes(events: DataFrame, edit: str, order: str, status: str, limit_ms: int, ttl_ms: int) -> DataFrame:
    """Outcomes as they happen, by the clock of the cluster: edit, before, status, outcome. Edits unsettled for `limit_ms`
    expire with the next batch; state older than `ttl_ms` is gone even if no batch comes for its key. As time never ends,
    this is for triggers that go on, not for those that stop when all is used up."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = f"{fields(events, edit)}, before string, status string, outcome string"
    return events.select(edit, order, status).groupBy(edit).transformWithState(Live([order, status], [edit, "before", "status", "outcome"], limit_ms, ttl_ms), kind, "append", "processingTime")
