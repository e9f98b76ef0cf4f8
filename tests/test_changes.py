"""Tables that changes land in, batches of requests and logs of edits, against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import checks
from foliant.operators import replay, requests
from foliant.sources import tables


def files_of(folder):
    return {d: sorted(f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in os.listdir(folder) if d.startswith("shard=")}


def test_only_touched_folders_change(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = {k: (f"v{k}", k % 3) for k in range(200)}
    landed = tables.created(spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, x string, y int"), "k", folder, 8)

    def seen():
        return {r.k: (r.x, r.y) for r in landed.rows().collect()}

    def shard(keys):
        return {f"shard={r[0]}" for r in spark.createDataFrame([(k,) for k in keys], "k long").select(landed.shard()).distinct().collect()}

    assert seen() == rows and landed.rows().count() == 200 and landed.rows().columns == ["k", "x", "y"]
    before = files_of(folder)
    touched = tables.updated(landed, spark.createDataFrame([(3, "new", None), (999, "nobody", 1)], "k long, x string, y int"), "x", "y")
    rows[3] = ("new", 0)
    after = files_of(folder)
    assert seen() == rows and {f"shard={t}" for t in touched} == shard([3, 999])
    assert {d for d in before if before[d] != after[d]} == shard([3, 999]) and set(before) == set(after)
    # a folder that is left without rows goes, one that wasn't there comes
    of = {r.k: r.s for r in spark.range(200).select(F.col("id").alias("k"), landed.shard("id").alias("s")).collect()}
    gone = [k for k in rows if of[k] == of[5]]
    tables.deleted(landed, spark.createDataFrame([(k,) for k in [*gone, 5, 12345]], "k long"))
    rows = {k: v for k, v in rows.items() if k not in gone}
    assert seen() == rows and shard([5]).isdisjoint(files_of(folder))
    tables.inserted(landed, spark.createDataFrame([(5, None, 7)], "k long, x string, y int"))
    assert seen() == rows | {5: (None, 7)} and shard([5]) <= set(files_of(folder))
    assert tables.deleted(landed, landed.rows().where("k < 0")) == [] and seen() == rows | {5: (None, 7)}
    with pytest.raises(ValueError):
        landed.changed(spark.createDataFrame([(3,)], "k long"), lambda held: held.withColumn("k", F.col("k") + 1000))
    assert seen() == rows | {5: (None, 7)}


def by_hand(batch, files, projects):
    """One request after the other."""
    alive, held, used, out = {p[0]: list(p) for p in projects}, {f[0]: list(f) for f in files}, {f[0] for f in files}, {}
    for request, op, asker, file, project, name, content, description in sorted(batch, key=lambda r: r[0]):
        on_file, on_project = op in requests.OPS, op in requests.PROJECT_OPS
        most = 100 if on_project else 255
        named = name is not None and 1 <= len(name) <= most
        wrong = (on_file and file is None) or (op in ("create", *requests.PROJECT_OPS) and project is None) or (op in ("create", "rename") and not named) or (op == "update" and content is None)
        if not (on_file or on_project) or wrong or (op == "update_project" and ((name is not None and not named) or len(description or "") > 500)):
            out[request] = "invalid"
            continue
        at = project if on_project or op == "create" else held.get(file, [None, None])[1]
        if asker is None or at not in alive or alive[at][1] != asker or (on_file and op != "create" and file not in held):
            out[request] = "unauthorized"
        elif op == "create" and file in used:
            out[request] = "taken"
        else:
            out[request] = "ok"
            if op == "create":
                held[file], used = [file, project, name, content or ""], used | {file}
            elif op == "delete":
                del held[file]
            elif op in ("rename", "update"):
                held[file][2 if op == "rename" else 3] = name if op == "rename" else content
            elif op == "delete_project":
                del alive[project]
                held = {f: v for f, v in held.items() if v[1] != project}
            else:
                alive[project][2:] = [alive[project][2] if name is None else name, alive[project][3] if description is None else description]
    return out, sorted(map(tuple, held.values())), sorted(map(tuple, alive.values()))


def test_requests_in_their_order(spark):
    for seed, deletions in ((6, 0), (7, 8), (8, 60)):
        rng = random.Random(seed)
        projects = [(p, o, f"p{p}", None) for p, o in ((1, 1), (2, 2), (3, 1), (4, None), (5, 1), (6, 2))]
        files = [(f, rng.choice([1, 2, 3, 4, 5, 9]), f"n{f}", rng.choice([None, "", "text"])) for f in range(12)]
        batch = []
        for r in range(600):
            op = rng.choice(["create", "update", "update", "rename", "delete", "odd", None, "update_project"]) if rng.randrange(1000) >= deletions else "delete_project"
            fields = [rng.choice([1, 1, 2, None]), rng.choice([None, *range(25)]), rng.choice([1, 2, 3, 4, 5, 6, 9, None]), rng.choice(["", None, "x" * 101, "x" * 256, f"name{r}", f"name{r}"]), rng.choice([None, "", f"c{r}", f"c{r}"]), rng.choice([None, "", "d" * 501, f"d{r}"])]
            batch.append((r, op, *fields))
        rng.shuffle(batch)
        schema = "request long, op string, asker long, file long, project long, name string, content string, description string"
        made = spark.createDataFrame(batch, schema).withColumn("owner", F.lit("clash"))
        table = spark.createDataFrame(files, "file long, project long, name string, content string")
        owned = spark.createDataFrame(projects, "project long, owner long, name string, description string")
        outcomes = requests.judged(made, table, owned).cache()
        want, left, kept = by_hand(batch, files, projects)
        assert {r.request: r.outcome for r in outcomes.collect()} == want and outcomes.count() == len(batch)
        assert {"ok", "invalid", "unauthorized", "taken"} >= set(want.values()) >= {"ok", "invalid", "unauthorized"}
        assert sorted(tuple(r) for r in requests.applied(table, outcomes).collect()) == left
        assert sorted(tuple(r) for r in requests.applied_projects(owned, outcomes).collect()) == kept and (len(kept) < 6) == (deletions > 0)
    none = requests.judged(made.where("request < 0").drop("description"), table, owned.where("project < 0"))
    assert none.count() == 0 and requests.applied(table, none).count() == len(files)


def test_checks_of_ids(spark):
    """The form of identifiers is checked as the caller says; the nil and the greatest one are identifiers, too."""
    ids = ["00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff", "FFFFFFFF-ffff-ffff-ffff-ffffffffffff", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-02d3-a456-426614174000", "ffffffff-ffff-ffff-ffff-fffffffffff0", "x", None]
    rows = spark.createDataFrame([(k, "delete", 1, i, None, None, None) for k, i in enumerate(ids)], "request long, op string, asker long, file string, project string, name string, content string")
    files = spark.createDataFrame([(i, "p", "n", "c") for i in ids], "file string, project string, name string, content string")
    out = requests.judged(rows, files, spark.createDataFrame([("p", 1)], "project string, owner long"), id_ok=checks.is_uuid(F.col("file")))
    assert [r.outcome for r in out.orderBy("request").collect()] == ["ok", "ok", "ok", "ok", "invalid", "invalid", "invalid", "invalid"]


def test_replay(spark):
    rng = random.Random(7)
    log = [(rng.randint(1, 4), rng.choice(["a", "b", "c", "d", "e"]), k, rng.choice(["append", "append", "replace", "remove", "odd", None]), rng.choice([None, f"v{k}"])) for k in range(300)] + [(None, "a", 900, "append", "x"), (1, None, 901, "append", "x")]
    lists = {}
    for owner, element, _, op, content in log:
        held = lists.setdefault(owner, [])
        at = [i for i, x in enumerate(held) if x[0] == element]
        if owner is None or element is None:
            continue
        if op == "remove":
            held[:] = [x for x in held if x[0] != element]
        elif op in ("append", "replace") and at:
            held[at[0]] = (element, content)
        elif op == "append":
            held.append((element, content))
    rng.shuffle(log)
    got = replay.replayed(spark.createDataFrame(log, "o long, e string, at long, op string, c string"), "o", "e", "at", "op", "c")
    assert sorted(tuple(r) for r in got.collect()) == sorted(((o, k, *x) for o, held in lists.items() for k, x in enumerate(held, 1)), key=lambda r: r[:2])
    assert replay.replayed(got.select("o", "e", F.lit(1).alias("at"), F.lit("remove").alias("op"), "c"), "o", "e", "at", "op", "c").count() == 0
