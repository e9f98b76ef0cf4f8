"""Compilations by an external program, under supervision.

Manifests are dealt by key and sorted, and their files stream into a scratch folder one after the other as rows arrive;
only the file at hand is in memory, whatever a manifest holds. When a key is complete the program runs in that folder, in
a process group of its own: it is killed, with all it started, when its time is up or when it says more than is allowed,
which is noticed while its output is read. The product is read back from its file, as far as there is one, even after a
failure. The scratch folder belongs to the task that made it and goes with the manifest.

One program works at a time in a task, as its time is that of the clock. While one merely waits, the next manifests'
programs run beside it, up to `AT_ONCE`, so that a program that sleeps until it is killed holds up nobody. Whether it
waits is seen from the CPU time of its session; where the system doesn't tell, each program is waited for. Keys are dealt
to as many tasks as there are cores at least, as the work lies in the programs, not in the bytes.

A null key is a manifest like any other. Files whose name leaves the folder, or is null, fail their manifest before the
program is started; of equal names the last row stands, so names should be made unique first (`compiling.manifest`).
"""

from __future__ import annotations

import os
import selectors
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.compiling import MOST_OUTPUT, TIME_LIMIT, outcome

#: Programs of a task that run at the same time, if all but one of them wait.
AT_ONCE = 8
#: Seconds before a look at a program, and the share of them that it may work and still counts as waiting.
LOOK, IDLE = 0.1, 0.1
#: Results that leave a task together, and the bytes of what they hold from which fewer do.
TOGETHER, MOST_BYTES = 200, 4_000_000


def supervised(command: list[str], folder: str, limit: float, most: int, started: Callable[[int], None] | None = None) -> tuple[str, str, str | None]:
    """What the program says on its two outputs, and what went wrong. `started` is told the program's number, which is also that of its session."""
    process = subprocess.Popen(command, cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    if started:
        started(process.pid)
    said, message, until = {process.stdout: bytearray(), process.stderr: bytearray()}, None, time.monotonic() + limit
    try:
        with selectors.DefaultSelector() as waiting:
            for pipe in said:
                waiting.register(pipe, selectors.EVENT_READ)
            while waiting.get_map() and not message:
                if (left := until - time.monotonic()) <= 0:
                    message = f"timed out after {limit:g} seconds"
                    break
                for ready, _ in waiting.select(left):
                    got = os.read(ready.fd, 1 << 16)
                    if not got:
                        waiting.unregister(ready.fileobj)
                    said[ready.fileobj] += got[: most - len(said[ready.fileobj])]
                    if len(said[ready.fileobj]) == most and got:
                        message = f"more than {most} bytes of output"
        if not message:
            try:
                process.wait(max(0.0, until - time.monotonic()))
            except subprocess.TimeoutExpired:
                message = f"timed out after {limit:g} seconds"
    finally:
        try:
            os.killpg(process.pid, signal.SIGKILL)  # with what it left running
        except ProcessLookupError:
            pass
        process.wait()
        for pipe in said:
            pipe.close()
    if not message and process.returncode:
        message = f"Command failed: {' '.join(command)}"
    return *(bytes(x).decode("utf-8", "replace") for x in said.values()), message


def worked(session: int) -> float | None:
    """CPU seconds of a session's processes, with those of their children that have ended; None where the system doesn't tell."""
    ticks, found = 0, False
    try:
        for name in os.listdir("/proc"):
            if name.isdigit():
                try:
                    with open(f"/proc/{name}/stat", "rb") as file:
                        fields = file.read().rpartition(b")")[2].split()  # from the state on
                except OSError:  # it has just ended
                    continue
                if int(fields[3]) == session:
                    found, ticks = True, ticks + sum(map(int, fields[11:15]))
    except OSError:
        return None
    return ticks / os.sysconf("SC_CLK_TCK") if found else None


class Manifest:
    """One key's files on their way to the program."""

    def __init__(self, key):
        self.key, self.refused, self.scratch = key, None, tempfile.TemporaryDirectory(prefix="manifest-")
        self.base = os.path.realpath(self.scratch.name)
        self.session, self.looked, self.seconds, self.pause, self.waits = None, time.monotonic(), 0.0, LOOK, False

    def add(self, name: str | None, content: bytes | None) -> None:
        plain = name and "/" not in name and name not in (".", "..")
        path = f"{self.base}/{name}" if plain else os.path.normpath(os.path.join(self.base, name or ""))
        if not plain and not path.startswith(self.base + os.sep):
            self.refused = self.refused or f"Invalid filename (path traversal): {name}"
        elif not self.refused:
            try:
                if not plain:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as file:
                    file.write(content or b"")
            except OSError as e:  # such as a file where a folder is needed
                self.refused = f"{e.strerror}: {name}"

    def run_by(self, session: int) -> None:
        self.session, self.looked = session, time.monotonic()

    def waiting(self) -> bool:
        """Whether the program merely waited before the last look at it. While it waits it is looked at ever more seldom."""
        now = time.monotonic()
        if self.session is not None and now - self.looked >= self.pause:
            seconds = worked(self.session)
            self.waits = seconds is not None and seconds - self.seconds < IDLE * (now - self.looked)
            self.looked, self.seconds, self.pause = now, seconds or 0.0, 2 * self.pause if self.waits else LOOK
        return self.waits

    def result(self, command: list[str], product: str, limit: float, most: int) -> tuple:
        with self.scratch as folder:
            if self.refused:
                return self.key, None, "", "", self.refused
            try:
                stdout, stderr, message = supervised(command, folder, limit, most, self.run_by)
            except OSError as e:  # the program can't be started
                return self.key, None, "", "", str(e)
            path, made = os.path.join(folder, product), None
            if os.path.isfile(path):
                with open(path, "rb") as file:
                    made = file.read()
            elif not message:
                stdout, stderr, message = "", "", f"no such file: {product}"
            return self.key, made, stdout, stderr, message


def manifests_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Manifest]:
    """The manifests of sorted rows (key, name, content), each when its files are in its folder."""
    held = None
    for batch in batches:
        for k, name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held is None or k != held.key:
                if held is not None:
                    yield held
                held = Manifest(k)
            held.add(name, content.as_py())
    if held is not None:
        yield held


def results(manifests: Iterator[Manifest], command: list[str], product: str, limit: float, most: int) -> Iterator[tuple]:
    """What becomes of each manifest, in the order in which the programs end."""

    def ended(seconds: float | None) -> Iterator[tuple]:
        for future in wait(running, seconds, FIRST_COMPLETED).done:
            del running[future]
            yield future.result()

    running: dict[Future, Manifest] = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for held in manifests:
            while running and (len(running) >= AT_ONCE or not all(x.waiting() for x in running.values())):
                yield from ended(LOOK)
            running[pool.submit(held.result, command, product, limit, most)] = held
        while running:
            yield from ended(None)


def compiled(manifests: DataFrame, key: str, name: str, data: str, command: list[str], product: str, limit: float = TIME_LIMIT, most_output: int = MOST_OUTPUT) -> DataFrame:
    """key, pdf (the product), logs and success of each manifest; `data` are the bytes of a file."""
    names, kinds = [key, "pdf", "stdout", "stderr", "message"], [manifests.schema[key].dataType.simpleString(), "binary", "string", "string", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.column(0).type, pa.binary(), pa.string(), pa.string(), pa.string()]
        made, size = [], 0
        for found in chain(results(manifests_of(chain([first], batches)), command, product, limit, most_output), [None]):
            if found:
                made.append(found)
                size += sum(len(x or "") for x in found[1:4])
            if made and (not found or len(made) >= TOGETHER or size >= MOST_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
                made, size = [], 0

    # a number of its own, as the tables' bytes say nothing about the work
    spark = manifests.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = manifests.select(key, name, F.col(data).cast("binary").alias(data)).repartition(tasks, key).sortWithinPartitions(key, name)
    made = rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    return made.select(key, outcome(F.col("pdf"), F.col("stdout"), F.col("stderr"), F.col("message")).alias("__o")).select(key, "__o.*")
