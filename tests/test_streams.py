"""Streams with timers against plain folds, whatever batches the rows come in."""

import datetime
import random
import time

from pyspark.sql import functions as F

from foliant.streaming import debounce, feeds, timers

START = datetime.datetime(2024, 1, 1)
CASES = [(1, 0.0, "a", "v1"), (1, 1.0, "b", "v2"), (1, 2.5, "a", "v3"), (1, 6.0, "a", "v4")]


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain_saves(edits, pause):
    out = []
    for editor in {e[0] for e in edits}:
        run = []
        for e in sorted((e for e in edits if e[0] == editor), key=lambda e: (e[1], str(e[2:]))):
            if run and e[1] - run[-1][1] > pause:
                out.append((editor, at(run[-1][1] + pause), len(run), *run[-1][2:]))
                run = []
            run.append(e)
        out.append((editor, at(run[-1][1] + pause), len(run), *run[-1][2:]))
    return out


def plain_outcomes(moves, limit):
    out = []
    for edit in {m[0] for m in moves}:
        state, until = None, 0
        for _, t, _, status in sorted((m for m in moves if m[0] == edit), key=lambda m: m[1:]):
            if state and t > until:
                out.append((edit, at(until), state, None, "expired"))
                state = None
            if status not in (debounce.MOVES.get(state, []) if state else ["pending"]):
                out.append((edit, at(t), state, status, "refused"))
            elif status in debounce.MOVES:
                state, until = status, t + limit
            else:
                out.append((edit, at(t), state, status, "settled"))
                state = None
        if state:
            out.append((edit, at(until), state, None, "expired"))
    return sorted(out, key=repr)


def fed(spark, rows, schema, cuts, build, lateness):
    """Rows (key, seconds, ...) in batches cut at these seconds, and a closing row far ahead; a batch's own order doesn't matter."""
    names = [c.split()[0] for c in schema.split(", ")]
    edges, batches = [-1e9, *cuts, 1e9], []
    for low, high in zip(edges[:-1], edges[1:]):
        part = [(r[0], at(r[1]), *r[2:], False) for r in rows if low < r[1] <= high]
        random.Random(1).shuffle(part)
        batches.append(spark.createDataFrame(part, f"{schema.replace('s double', 'ts timestamp')}, closing boolean"))
    batches[-1] = batches[-1].union(spark.createDataFrame([(rows[0][0], at(1e6), *rows[0][2:], True)], batches[0].schema))
    assert names[1] == "s"
    return feeds.incrementally(batches, lambda stream: build(feeds.open_rows(stream.withWatermark("ts", lateness), "ts")))


def test_saves(spark):
    """The known case, ties in time, pauses of just the limit, nulls in the content, several editors."""
    rng = random.Random(2)
    rows = CASES + [(rng.randint(2, 5), rng.randint(0, 600) / 4, rng.choice("ab"), f"v{k}") for k in range(150)] + [(9, 0.0, None, None)]
    got = fed(spark, rows, "editor long, s double, file string, content string", [1.0], lambda s: timers.saves(s, "editor", "ts", "file", "content"), "5 seconds").collect()
    got = sorted((tuple(r) for r in got), key=repr)
    assert got == sorted(plain_saves(rows, 2), key=repr)
    assert [r for r in got if r[0] == 1] == [(1, at(4.5), 3, "a", "v3"), (1, at(8), 1, "a", "v4")] and (9, at(2), 1, None, None) in got


def test_late_edits_are_dropped(spark):
    """An edit behind the watermark changes nothing that has been saved."""
    schema = "editor long, ts timestamp, content string, closing boolean"
    batches = [[(1, at(0), "first", False), (1, at(100), "second", False)], [(1, at(50), "late", False), (1, at(99.5), "in time", False), (1, at(1e6), "", True)]]
    got = feeds.incrementally((spark.createDataFrame(b, schema) for b in batches), lambda s: timers.saves(feeds.open_rows(s.withWatermark("ts", "2 seconds"), "ts"), "editor", "ts", "content"))
    assert sorted((r.saved_at, r.n_edits, r.content) for r in got.collect()) == [(at(2), 1, "first"), (at(102), 2, "second")]


def test_outcomes(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 5), rng.randint(0, 800) / 4, k, rng.choice(["pending", "pending", "done", "done", "error", "applied", "rejected", "odd", None])) for k in range(200)]
    schema = "edit long, s double, seq long, status string"
    got = fed(spark, rows, schema, [90.0], lambda s: timers.outcomes(s, "edit", "ts", "seq", "status", limit="10 seconds"), "3 seconds").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_outcomes(rows, 10)


def test_states_by_the_clock(spark, tmp_path):
    """Edits that nobody settles expire; with a shorter time to live their state is gone before."""
    schema = "edit long, seq long, status string"
    first = [(1, 1, "pending"), (1, 2, "done"), (1, 3, "applied"), (2, 1, "pending"), (3, 1, "done")]
    for ttl, second, expected in ((60_000, (4, 1, "pending"), (2, "pending", None, "expired")), (1, (2, 2, "done"), (2, None, "done", "refused"))):
        folder = str(tmp_path / str(ttl))
        for rows in (first, [second]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            out = timers.live_outcomes(spark.readStream.schema(schema).parquet(f"{folder}/in"), "edit", "seq", "status", limit_ms=500, ttl_ms=ttl)
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(once=True).start().awaitTermination()
            time.sleep(0.6)
        got = [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]
        assert {(1, "done", "applied", "settled"), (3, None, "done", "refused"), expected} == set(got)


def test_landings(spark):
    """All rows once, in order of arrival, and the closing row last; no rows, no feed but an empty one."""
    rows = spark.range(1000).select("id", F.expr("timestamp_seconds(id * 60)").alias("ts"))
    parts = feeds.landings(rows, "ts", "ts + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 600)", 4, "1 days")
    assert sum(p.count() for p in parts) == 1001 and len(parts) == 4
    assert [tuple(r) for r in parts[-1].where("closing").select("id", "closing").collect()] == [(999, True)]
    assert [p.count() for p in feeds.landings(rows.where("id < 0"), "ts", "ts", 4, "1 days")] == [0]
