"""Recorded answers as a source, and calls to their end against a plain loop."""

import json
import math
import random
import re

from pyspark.sql import functions as F

from foliant.plans import retries
from foliant.sources import answers


def made(n, seed=1):
    rng = random.Random(seed)
    return [(k, 1, rng.choice([200, 429]), json.dumps({"text": rng.choice(["", "é\n", "x" * rng.randint(0, 200)])}), None) for k in range(n)]


def test_ranges(spark, tmp_path):
    """Whatever the length of the ranges, each line comes once; what is no answer is kept as it is."""
    folder = str(tmp_path / "in")
    rows = made(60)
    frame = spark.createDataFrame(rows, answers.SCHEMA)
    answers.record(frame.where("request < 40").repartition(3), folder, 1)
    answers.record(frame.where("request >= 40"), folder, 2)
    (tmp_path / "in" / "00000003").mkdir()
    odd = ['{"request": "x"}', "[1]", "no answer", '{"request": 99, "status": 200}']
    (tmp_path / "in" / "00000003" / "part.txt").write_bytes("\r\n".join(["", *odd, ""]).encode() + b"\xff\n")
    (tmp_path / "in" / "00000003" / "_hidden").write_text("not read\n")
    want = sorted(rows + [(None, None, None, None, x) for x in [*odd[:3], "�"]] + [(99, None, 200, None, None)], key=repr)
    for size in (7, 100, answers.SPLIT_BYTES):
        spark.dataSource.register(answers.RecordedAnswers)
        got = spark.read.format(answers.FORMAT).option("path", folder).option("splitBytes", size).load()
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert got.rdd.getNumPartitions() == len(answers.listed(folder))
    assert answers.recorded(spark, str(tmp_path / "none")).count() == 0


def test_stream(spark, tmp_path):
    """A landing is read once, by the run that finds it."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for landing in (1, 2):
        answers.record(spark.createDataFrame(made(10 * landing, landing), answers.SCHEMA), folder, landing)
        for _ in range(2):
            answers.recorded_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("request", "body").collect()) == sorted((r[0], r[3]) for r in made(10, 1) + made(20, 2))


def by_hand(found, model):
    """A loop over the answers; None where they run out."""
    attempt, calls, waited, size = 1, 0, 0, 32768
    while True:
        calls += 1
        if calls not in found:
            return "waiting", calls - 1, waited, size, None, None, None, None
        status, body = found[calls]
        try:
            x = json.loads(body)
        except ValueError:
            x = {}
        if 200 <= status < 300:
            choices = x.get("choices") or [{}]
            return "done", calls, waited, size, choices[0].get("message", {}).get("content") or "", x.get("model") or model, None, None
        message = x.get("error", {}).get("message") or f"Groq API error ({status})"
        if size == 8192:
            return "error", calls, waited, size, None, None, "BAD_REQUEST", "Fallback failed: " + body
        if status == 429 and attempt <= 3:
            m = re.search(r"try again in (\d+\.?\d*)s", message, re.I)
            waited += max(math.ceil(float(m[1])) if m else 0, 5)
            attempt += 1
        elif "max_tokens" in message and "less than or equal to" in message and attempt == 1:
            size = 8192
        else:
            return "error", calls, waited, size, None, None, "TOO_MANY_REQUESTS" if status == 429 else "BAD_REQUEST", message


def test_calls_to_their_end(spark):
    rng = random.Random(5)
    bodies = [
        {"choices": [{"message": {"content": "fine"}}], "model": "other"}, {"choices": [{"message": {"content": ""}}]}, {"choices": []}, {"error": {"message": "Please try again in 7.2s."}}, {"error": {"message": "TRY AGAIN IN 1s"}}, {"error": {"message": ""}},
        {"error": {"message": "max_tokens must be less than or equal to 8192"}}, {},
    ]
    record, want = [], {}
    for key in range(400):
        found = {k: (rng.choice([200, 201, 429, 429, 429, 400, 500, 302]), rng.choice([*map(json.dumps, bodies), "no json", ""])) for k in range(1, rng.randint(0, 7) + 1) if rng.random() < 0.97}
        record += [(key, k, *a) for k, a in found.items()]
        want[key] = by_hand(found, "asked")
    rng.shuffle(record)
    table = spark.createDataFrame(record + record[:50], "key long, call int, status int, body string")
    asked = spark.range(400).select(F.col("id").alias("key"), F.lit("asked").alias("model"))
    got = {r.key: tuple(r)[1:] for r in retries.ended(asked, "key", "model", table, "call", "status", "body").collect()}
    assert got == want
    assert {w[0] for w in want.values()} == {"done", "error", "waiting"} and {w[1] for w in want.values()} == {0, 1, 2, 3, 4}
    assert retries.ended(asked, "key", "model", table.where("key < 0"), "call", "status", "body").where("state <> 'waiting' OR calls > 0").count() == 0
