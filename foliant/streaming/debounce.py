"""Saves after a pause, and the states of edits, over tables or streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: the pause after which an edit is saved.
PAUSE = "2 seconds"


def debounced(edits: DataFrame, editor: str, ts: str, *content: str, pause: str = PAUSE) -> DataFrame:
    """One save for each run of an editor's edits without a longer pause: saved_at, n_edits, and the last edit's content.

    The timer is the editor's, not the file's: an edit of another file puts off the save, too. A pause of just that
    length doesn't end a run. Of edits at one time the one with the greatest content counts. For a stream, `ts` is a
    timestamp with a watermark; closed runs come out once the watermark has passed.
    """
    last = F.max_by(F.struct(*content), F.struct(ts, *content))
    runs = edits.groupBy(editor, F.session_window(ts, pause).alias("__run")).agg(last.alias("__last"), F.count("*").alias("n_edits"))
    return runs.select(editor, F.col("__run.end").alias("saved_at"), "n_edits", *[F.col(f"__last.{c}").alias(c) for c in content])


def stream_of(edits: DataFrame, ts: str, late: str) -> DataFrame:
    """Times without zone are taken as UTC, as a watermark needs an instant."""
    return edits.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


# The states that an edit can go to from each state.
MOVES = {"pending": ["done", "error"], "done": ["applied", "rejected"]}


def allowed(before: Column, status: Column) -> Column:
    """Whether an edit may go from one state to another; from none, only to pending."""
    moves = F.create_map(*[x for a, b in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    return F.coalesce(F.when(before.isNull(), status == "pending").otherwise(F.array_contains(F.try_element_at(moves, before), status)), F.lit(False))


def final_states(events: DataFrame, edit: str, order: str, status: str) -> DataFrame:
    """Each edit's last state and whether all its moves are allowed ones, beginning with pending. A null state is none."""
    known = F.coalesce(F.col(status), F.lit(""))
    steps = events.select(edit, order, known.alias("__s")).withColumn("__before", F.lag("__s").over(Window.partitionBy(edit).orderBy(order, "__s")))
    held = steps.groupBy(edit).agg(F.max_by("__s", F.struct(order, "__s")).alias("__last"), F.every(allowed(F.col("__before"), F.col("__s"))).alias("valid"))
    return held.select(edit, F.nullif("__last", F.lit("")).alias("status"), "valid")


def state_stream(events: DataFrame, edit: str, order: str, status: str) -> DataFrame:
    """The same over a stream: after each batch the state of the edits that it touched, for update mode.

    What is kept of an edit is its last state and whether its moves were allowed; a batch's events are taken in order.
    """
    kind = events.schema[edit].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, valid = state.get if state.exists else ("", True)
        for s in pd.concat(list(batches)).fillna({status: ""}).sort_values([order, status])[status]:
            valid, last = valid and s in (MOVES.get(last, []) if last or state.exists else ["pending"]), s
            state.update((last, valid))
        yield pd.DataFrame({edit: [key[0]], "status": [last or None], "valid": [valid]})

    return events.select(edit, order, status).groupBy(edit).applyInPandasWithState(run, f"`{edit}` {kind}, status string, valid boolean", "last string, valid boolean", "update", GroupStateTimeout.NoTimeout)
