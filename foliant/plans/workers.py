"""Workers that edit chunks: each task succeeds, fails or runs out of time by itself, in its own row.

Tasks are dealt to as many tasks of Spark as there are cores at least, however few bytes or files they come from. Each
works on a bounded number of rows at once, in threads of their own, as a worker mostly waits for a service; the next row's
call begins as soon as one ends or is given up, so that a late one holds up nobody but itself. What a worker raises, what
isn't a text and what takes too long becomes the error of that row; a thread that is given up is left behind and ends
with the Python process at the latest. A task of Spark that runs again calls the workers again, so a worker's effects
have to bear repetition.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calls that a Python process waits for at the same time.
AT_ONCE = 8
#: Rows that leave a task together, and the characters of replies from which fewer do.
TOGETHER, MOST_CHARS = 1000, 4_000_000


def shares(spark: SparkSession) -> int:
    """Into how many tasks work is dealt that the bytes of its rows say nothing about."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def answers(worker: Callable[[str, str], str], prompts: Iterable[tuple[str, str]], seconds: float, at_once: int) -> Iterator[tuple[int, str | None, str | None]]:
    """number, reply and error of each (prompt, model), as the calls end, of which so many are made at the same time. A prompt is asked for when its call begins."""
    ended: queue.SimpleQueue = queue.SimpleQueue()
    until: dict[int, float] = {}  # of the calls on their way, the earliest limit first

    def call(k: int, prompt: tuple[str, str], limit: float) -> None:
        try:
            reply = worker(*prompt)
            found = (reply, None) if isinstance(reply, str) else (None, f"no text but {type(reply).__name__}")
        except Exception as e:  # one task's failure is its own
            found = (None, str(e) or type(e).__name__)
        if time.monotonic() <= limit:
            ended.put((k, *found))

    def one() -> tuple[int, str | None, str | None]:
        first, limit = next(iter(until.items()))
        try:
            found = ended.get(timeout=max(0.0, limit - time.monotonic()))
        except queue.Empty:
            found = (first, None, f"timed out after {seconds:g} seconds")
        return found

    for k, prompt in enumerate(prompts):
        until[k] = time.monotonic() + seconds
        threading.Thread(target=call, args=(k, prompt, until[k]), daemon=True).start()
        while len(until) >= at_once:
            found = one()
            if until.pop(found[0], None):  # one that was given up just before its end has its result already
                yield found
    while until:
        found = one()
        if until.pop(found[0], None):
            yield found


def called(worker: Callable[[str, str], str], prompts: list[tuple[str, str]], seconds: float) -> list[tuple[str | None, str | None]]:
    """reply and error of each (prompt, model), all called at the same time."""
    return [x[1:] for x in sorted(answers(worker, prompts, seconds, len(prompts) + 1), key=lambda x: x[0])]


def worked(tasks: DataFrame, key: str, prompt: str, worker: Callable[[str, str], str], seconds: float, at_once: int = AT_ONCE) -> DataFrame:
    """key, chunk_id, reply and error of each task, from its prompt and model. A null prompt or model is a failure like any other."""
    names, kinds = [key, "chunk_id", "reply", "error"], [tasks.schema[key].dataType.simpleString(), "int", "string", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, pa.RecordBatch] = {}  # key and chunk_id of the calls on their way

        def prompts() -> Iterator[tuple[str, str]]:
            k = 0
            for batch in batches:
                for at, prompt in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    asked[k] = batch.select([0, 1]).slice(at, 1)
                    yield tuple(x.as_py() for x in prompt)
                    k += 1

        made, size = [], 0
        for k, reply, error in answers(worker, prompts(), seconds, at_once):
            made.append((asked.pop(k), reply, error))
            size += len(reply or "") + len(error or "")
            if len(made) >= TOGETHER or size >= MOST_CHARS:
                yield table(made)
                made, size = [], 0
        if made:
            yield table(made)

    def table(made: list[tuple[pa.RecordBatch, str | None, str | None]]) -> pa.RecordBatch:
        rows, *found = zip(*made, strict=True)
        held = pa.Table.from_batches(rows).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.chunk(0) for c in held.columns], *[pa.array(c, pa.string()) for c in found]], names=names)

    rows = tasks.select(key, F.col("chunk_id").cast("int").alias("chunk_id"), prompt, "model").repartition(shares(tasks.sparkSession), key, "chunk_id")
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
