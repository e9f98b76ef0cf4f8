import math
import random
import re

from pyspark.sql import functions as F

from foliant.operators import reads, writes
from foliant.plans import compiling, splitter
from foliant.streaming import debounce


def by_hand(text, target):
    """A plain version, line by line, with a stack of open environments."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if "\\begin{document}" in x), -1)
    preamble, body = "\n".join(lines[: at + 1]), lines[at + 1 :]
    n = len(body)
    if n < 2 * target:
        return preamble, ["\n".join(body)]
    stack, safe = [], []
    for i, line in enumerate(body):
        if m := re.search(r"\\begin\{([^}]+)\}", line):
            stack.append(m[1])
        if (m := re.search(r"\\end\{([^}]+)\}", line)) and m[1] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(m[1])]
        if not set(stack) & set(splitter.UNBREAKABLE):
            safe.append(i)
    out, last, per = [], 0, math.ceil(n / target)
    for _ in range(target - 1):
        ideal = last + per
        ahead = [s for s in safe if s > last]
        best = max(min(ahead, key=lambda s: (abs(s - ideal), s)) if ahead else ideal, last + 1)
        out.append("\n".join(body[last : best + 1]))
        last = best + 1
    out.append("\n".join(body[last:]))
    return preamble, [c for c in out if c.strip()]


def test_splitter(spark):
    rng = random.Random(5)
    pieces = ["", "  ", "text", "\\begin{figure}", "\\end{figure}", "\\begin{itemize} x \\end{itemize}", "\\end{table*}", "\\begin{center}", "\\end{center}", "\\begin{table*}"]
    docs = ["\n".join(rng.choice(pieces[: rng.randint(3, len(pieces))]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    docs += ["pre\n\\begin{document}\n" + d for d in docs[:40]] + ["", "\n" * 30]
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, x string")
    for target in (4, 6):
        got = {r.k: (r.preamble, r.chunks) for r in splitter.split(rows, "k", "x", target).collect()}
        for k, d in enumerate(docs):
            assert got[k] == by_hand(d, target), (target, d)


def test_chunk_counts(spark):
    expected = {4: {7: 1, 8: 3, 12: 3, 16: 4, 17: 3, 20: 4}, 6: {11: 1, 12: 4, 16: 4, 17: 5, 19: 4}}
    for target, cases in expected.items():
        rows = spark.createDataFrame([(n, "\n".join(["x"] * n)) for n in cases], "k int, x string")
        assert {r.k: len(r.chunks) for r in splitter.split(rows, "k", "x", target).collect()} == cases


def test_manifest(spark):
    schema = "k int, name string, data string"
    main = spark.createDataFrame([(1, "main.tex", "A")], schema)
    files = spark.createDataFrame([(1, "main.tex", "B"), (1, "x.bib", "C")], schema)
    got = compiling.manifest(main, spark.createDataFrame([], schema), files, "k", "name", "data").collect()
    assert {(r.name, r.data) for r in got} == {("main.tex", "B"), ("x.bib", "C")}


def test_debounce(spark):
    edits = spark.createDataFrame([(1, 0.0, "a", "v1"), (1, 1.0, "b", "v2"), (1, 2.5, "a", "v3"), (1, 6.0, "a", "v4")], "editor int, s double, file string, content string")
    rows = edits.withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    got = debounce.debounced(rows, "editor", "ts", "file", "content").select("file", "content", F.unix_millis("saved_at")).collect()
    assert sorted(tuple(r) for r in got) == [("a", "v3", 4500), ("a", "v4", 8000)]


def test_debounce_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    edits = spark.createDataFrame([(1, s, f"v{s}") for s in (0, 1, 5, 60)], "editor int, s int, content string")
    edits.selectExpr("editor", "content", "timestamp_seconds(s) AS ts").write.parquet(folder)
    stream = debounce.stream_of(spark.readStream.schema("editor int, content string, ts timestamp").parquet(folder), "ts", "1 second")
    run = debounce.debounced(stream, "editor", "ts", "content").writeStream.format("memory").queryName("saves").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.content for r in spark.table("saves").collect()) == ["v1", "v5", "v60"]


def test_writes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    once = writes.update(table, F.col("k") == 1, x=F.lit("c"))
    assert sorted(map(tuple, writes.update(once, F.col("k") == 1, x=F.lit("c")).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert sorted(r.k for r in writes.delete(table, F.col("x") == "b").collect()) == [1, 3]
    parents, kids = writes.cascade(table, "k", table.where("k = 1"), (spark.createDataFrame([(1,), (2,)], "p int"), "p"))
    assert sorted(r.k for r in parents.collect()) == [2, 3] and [r.p for r in kids.collect()] == [2]
    changes = spark.createDataFrame([(2, "")], "k int, x string")
    assert {r.k: r.x for r in writes.patch(table, changes, "k", "x").collect()} == {1: "a", 2: "", 3: None}


def test_filters_reach_both_scans(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, x string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, 2)], "fk int, y int").write.parquet(str(tmp_path / "c"))
    parents, kids = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "c"))
    plan = reads.nested(parents.where("k = 1"), "k", kids=(kids, "fk"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(k,1)") == 1 and plan.count("EqualTo(fk,1)") == 1


def test_states_over_a_stream(spark, tmp_path):
    """Two batches; an edit's state is carried over, and a move that isn't allowed stays on record."""
    from foliant.streaming import debounce

    schema = "edit long, seq long, status string"
    parts = [[(1, 1, "pending"), (2, 1, "done"), (3, 1, "pending")], [(1, 3, "applied"), (1, 2, "done"), (3, 2, "applied")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = debounce.state_stream(events, "edit", "seq", "status").writeStream.format("memory").queryName("edit_states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.edit, r.status, r.valid) for r in spark.table("edit_states").collect()}
    whole = spark.createDataFrame(sum(parts, []), schema)
    final = {(r.edit, r.status, r.valid) for r in debounce.final_states(whole, "edit", "seq", "status").collect()}
    assert final == {(1, "applied", True), (2, "done", False), (3, "applied", False)}
    assert final <= got


def test_splitting_stays_in_the_row(spark):
    """No line is shuffled, and long documents with many environments are split as by hand."""
    rng = random.Random(8)
    docs = ["\n".join(rng.choice(["text", "\\begin{figure}", "\\end{figure}", "\\begin{align*}\\end{align}", "", "\\end{figure}\\begin{table}", "\\end{table}"]) for _ in range(n)) for n in (3000, 6000, 12)]
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, x string")
    held = splitter.split(rows, "k", "x", 6)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (r.preamble, r.chunks) for r in held.collect()} == {k: by_hand(d, 6) for k, d in enumerate(docs)}
    assert "Exchange" not in splitter.safe_lines(splitter.parts(rows, "k", "x"), "k")._jdf.queryExecution().executedPlan().toString()
