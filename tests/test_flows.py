"""Workers that fail alone, and programs under supervision."""

import os
import threading
import time

from pyspark.sql import functions as F

from foliant.plans import edits, processes, workers


def test_workers(spark):
    """Each task's end is its own; calls of one batch wait for each other's limit, not for each other."""

    def odd_worker(prompt, model):
        if prompt == "fail":
            raise ValueError("no")
        if prompt == "silent":
            raise RuntimeError
        if prompt == "late":
            time.sleep(30)
        return {"text": f"{model}: {prompt}", "none": None, "number": 5}.get(prompt, "else")

    prompts = ["text", "fail", "late", "none", "number", "silent", None, "text"]
    rows = spark.createDataFrame([(1 if k else None, k, p, "m") for k, p in enumerate(prompts)], "doc long, chunk_id int, p string, model string").coalesce(1)
    began = time.monotonic()
    got = {r.chunk_id: (r.doc, r.reply, r.error) for r in workers.worked(rows, "doc", "p", odd_worker, seconds=2, at_once=8).collect()}
    assert time.monotonic() - began < 25
    assert got == {
        0: (None, "m: text", None), 1: (1, None, "no"), 2: (1, None, "timed out after 2 seconds"), 3: (1, None, "no text but NoneType"), 4: (1, None, "no text but int"), 5: (1, None, "RuntimeError"), 6: (1, "else", None), 7: (1, "m: text", None),
    }
    assert workers.worked(rows.where("doc > 5"), "doc", "p", odd_worker, seconds=2).count() == 0


def test_calls_at_once():
    """All calls of a batch are on their way before one ends."""
    gate = threading.Barrier(5, timeout=5)

    def worker(prompt, model):
        gate.wait()
        return prompt

    assert workers.called(worker, [(str(k), "m") for k in range(5)], 5) == [(str(k), None) for k in range(5)]


def test_late_calls_hold_up_nobody(spark):
    """A late call takes its place among those at once until it is given up, and the others go on beside it; few files are no fewer tasks."""

    def worker(prompt, model):
        if prompt == "late":
            time.sleep(30)
        return prompt + model

    rows = spark.range(400).selectExpr("id AS doc", "cast(id AS int) AS chunk_id", "if(id % 8 = 3, 'late', concat('p', id)) AS p", "'m' AS model").coalesce(1)
    began = time.monotonic()
    got = {r.chunk_id: (r.doc, r.reply, r.error) for r in workers.worked(rows, "doc", "p", worker, seconds=1).collect()}
    assert time.monotonic() - began < 25  # 50 seconds if eight are waited for together
    assert got == {k: (k, None, "timed out after 1 seconds") if k % 8 == 3 else (k, f"p{k}m", None) for k in range(400)}
    calls = workers.answers(worker, [("late" if k == 0 else str(k), "m") for k in range(30)], 1, 2)
    assert [k for k, _, _ in calls] == [*range(1, 30), 0]


def test_replies_in_any_order(spark):
    tasks = spark.createDataFrame([(d, k, 3, f"chunk {k}") for d in (1, 2) for k in (1, 2, 3)] + [(None, 1, 1, "no key")], "doc long, chunk_id int, total int, chunk string")
    block = "UPDATED_LATEX:\n```latex\n{}\n```\nCHANGES_SUMMARY: {}"
    replies = [(1, 3, block.format("third", "c"), None, 5), (1, 1, block.format("again", "x"), None, 9), (1, 1, block.format("first", "a"), None, 2), (2, 2, None, "busy", 1), (2, 3, None, None, 1), (7, 1, "nobody asked", None, 1), (None, 1, block.format("found", ""), None, 1)]
    table = spark.createDataFrame(replies, "doc long, chunk_id int, reply string, error string, at int")
    held = {r.doc: r for r in edits.gather(edits.with_replies(tasks, table, "doc", "at"), "doc").collect()}
    assert held[1].chunks == ["first", "chunk 2", "third"] and held[1].statuses == ["completed", "error: no reply", "completed"]
    assert held[2].chunks == ["chunk 1", "chunk 2", "chunk 3"] and held[2].statuses == ["error: no reply", "error: busy", "error: failed"]
    assert held[None].chunks == ["found"] and held[1].summaries == ["**Agent 1:** a", "**Agent 3:** c"]


def test_supervised(tmp_path):
    """Killed at the limit, with what was started; killed at the first byte too many; both outputs are kept apart."""
    out = processes.supervised(["sh", "-c", "echo a; echo b >&2; exit 3"], str(tmp_path), 5, 1000)
    assert out == ("a\n", "b\n", "Command failed: sh -c echo a; echo b >&2; exit 3")
    assert processes.supervised(["sh", "-c", "printf 12345"], str(tmp_path), 5, 5) == ("12345", "", "more than 5 bytes of output")
    assert processes.supervised(["sh", "-c", "printf 1234"], str(tmp_path), 5, 5) == ("1234", "", None)
    began = time.monotonic()
    stdout, _, message = processes.supervised(["sh", "-c", "yes"], str(tmp_path), 30, 1_000_000)
    assert len(stdout) == 1_000_000 and message == "more than 1000000 bytes of output"
    script = f"(sleep 60; touch {tmp_path}/survived) & echo $! > {tmp_path}/child; sleep 60"
    assert processes.supervised(["sh", "-c", script], str(tmp_path), 0.5, 1000)[2] == "timed out after 0.5 seconds"
    # a child that closes its outputs and goes on is no way around the limit
    assert processes.supervised(["sh", "-c", "exec >&- 2>&-; sleep 60"], str(tmp_path), 0.5, 1000)[2] == "timed out after 0.5 seconds"
    assert time.monotonic() - began < 20
    child = int((tmp_path / "child").read_text())
    for _ in range(50):
        if not os.path.exists(f"/proc/{child}") or open(f"/proc/{child}/stat").read().split()[2] == "Z":
            break
        time.sleep(0.1)
    else:
        raise AssertionError("the child lives")


def test_manifests(spark):
    files = [
        (1, "main.tex", b"cat a/*.txt > main.pdf; ls | wc -l"), (1, "a/2.txt", b"two"), (1, "a/1.txt", b"one"), (2, "main.tex", b"echo nothing"), (3, "../x", b""), (3, "main.tex", b"touch main.pdf"), (4, None, b""), (5, "main.tex", b"printf partial > main.pdf; exit 1"),
        (6, "a", b""), (6, "a/b", b""), (7, "x", None), (None, "main.tex", b"printf nobody > main.pdf"), (8, "/etc/x", b""), (9, "../" + "manifest-x/y", b""),
    ]
    rows = spark.createDataFrame(files, "k int, name string, data binary")
    got = {r.k: r for r in processes.compiled(rows, "k", "name", "data", ["sh", "main.tex"], "main.pdf", limit=10).collect()}
    assert len(got) == 10
    assert (bytes(got[1].pdf), got[1].logs.strip(), got[1].success) == (b"onetwo", "3", True)
    assert (got[2].pdf, got[2].logs, got[2].success) == (None, "no such file: main.pdf", False)
    for k, name in ((3, "../x"), (4, "None"), (8, "/etc/x"), (9, "../manifest-x/y")):
        assert (got[k].pdf, got[k].logs, got[k].success) == (None, f"Invalid filename (path traversal): {name}", False)
    assert (bytes(got[5].pdf), got[5].success) == (b"partial", True) and got[5].logs.startswith("Command failed")
    assert not got[6].success and not got[7].success and bytes(got[None].pdf) == b"nobody"
    assert not any(r.success for r in processes.compiled(rows, "k", "name", "data", ["no-such-program"], "main.pdf").collect())
    assert processes.compiled(rows.where("k > 50"), "k", "name", "data", ["sh", "main.tex"], "main.pdf").count() == 0
    assert rows.agg(F.count("*")).first()[0] == len(files)


def test_programs_that_wait(spark, tmp_path):
    """Programs that sleep until they are killed hold up nobody, and those that work have their time to themselves."""
    rows = spark.createDataFrame([(k, "main.tex", b"sleep 600" if k % 2 else b"printf made > main.pdf") for k in range(48)], "k long, name string, data binary")
    began = time.monotonic()
    got = {r.k: (r.pdf and bytes(r.pdf), r.logs, r.success) for r in processes.compiled(rows, "k", "name", "data", ["sh", "main.tex"], "main.pdf", limit=3).collect()}
    assert time.monotonic() - began < 16  # one after the other, four tasks would take 18 seconds at least
    assert got == {k: (None, "timed out after 3 seconds", False) if k % 2 else (b"made", "", True) for k in range(48)}

    def manifests():
        for k in range(3):
            held = processes.Manifest(k)
            held.add("main.tex", f"echo starts >> {tmp_path}/log; while [ ! -e {tmp_path}/end{k} ]; do :; done; echo ends >> {tmp_path}/log".encode())
            yield held

    timers = [threading.Timer(1.2 * (k + 1), (tmp_path / f"end{k}").touch) for k in range(3)]
    for timer in timers:
        timer.start()
    assert sorted(x[0] for x in processes.results(manifests(), ["sh", "main.tex"], "log", 20, 1000)) == [0, 1, 2]
    assert (tmp_path / "log").read_text().split() == ["starts", "ends"] * 3
