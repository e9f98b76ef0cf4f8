"""Batches of requests that change projects and files, each checked against the tables and against the requests before it.

A request is invalid where its fields are; unauthorized where its project or file isn't there, isn't there yet, isn't
there any more, or isn't the asker's; taken where it creates a file whose id was ever used; else ok. Owners don't change,
so when a project ends is an aggregation of its own requests. What has happened to a file before a request is told by
running windows over the file's requests in their order, which hold a few values at a time however many requests a file
has. The tables that result are made of the last request that set each field; a project takes its files with it.

Requests have the columns request (their order, unique), op, asker, file, project (for create and for projects), name,
content (create, update) and, as far as there are any, description. Ops on files are create, update, rename and delete,
those on projects update_project, which sets what is supplied, and delete_project. Ids of files are never used again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import checks
from foliant.functions.text import utf16_length

OPS = ("create", "update", "rename", "delete")
PROJECT_OPS = ("update_project", "delete_project")


def valid(id_ok: Column, project_ok: Column, description: Column) -> Column:
    """Whether a request's own fields are as they have to be; a creation may leave its content out, an update of a project what it doesn't change."""
    op, name = F.col("op"), F.col("name")
    names = F.when(op.isin("create", "rename"), checks.file_name_ok(name)).when(op == "update_project", name.isNull() | utf16_length(name).between(1, 100)).otherwise(True)
    rest = F.when(op == "update", F.col("content").isNotNull()).when(op == "update_project", description.isNull() | (utf16_length(description) <= 500)).otherwise(True)
    ids = F.when(op.isin(*OPS), checks.sure(id_ok)).otherwise(True) & F.when(op.isin("create", *PROJECT_OPS), checks.sure(project_ok)).otherwise(True)
    return checks.sure(op.isin(*OPS, *PROJECT_OPS)) & ids & names & rest


def same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def judged(requests: DataFrame, files: DataFrame, projects: DataFrame, id_ok: Column | None = None, project_ok: Column | None = None) -> DataFrame:
    """Each request with `outcome`: ok, invalid, unauthorized or taken.

    `files` has the columns file and project, `projects` project and owner. `id_ok` and `project_ok` are checks of the
    form of ids, by default that there is one.
    """
    description = F.col("description") if "description" in requests.columns else F.lit(None).cast("string")
    fine = valid(F.col("file").isNotNull() if id_ok is None else id_ok, F.col("project").isNotNull() if project_ok is None else project_ok, description)
    # what is invalid changes nothing and stays out of the windows, where all of it might be of one file or of none
    bad = requests.where(~fine).withColumn("outcome", F.lit("invalid"))
    owners = projects.select(F.col("project").alias("__project"), F.col("owner").alias("__owner"))
    of_projects = requests.where(fine & F.col("op").isin(*PROJECT_OPS)).join(owners, F.col("project") == F.col("__project"), "left")
    ends = of_projects.where((F.col("op") == "delete_project") & same(F.col("__owner"), F.col("asker"))).groupBy(F.col("project").alias("__p")).agg(F.min("request").alias("__end"))
    owners = owners.join(ends, F.col("__project") == F.col("__p"), "left").drop("__p")
    held = owners.select(F.col("__project").alias("__p"), "__end")
    right = same(F.col("__owner"), F.col("asker")) & (F.col("__end").isNull() | (F.col("request") <= F.col("__end")))
    of_projects = of_projects.join(held, F.col("project") == F.col("__p"), "left").withColumn("outcome", F.when(right, "ok").otherwise("unauthorized"))
    of_files = judged_files(requests.where(fine & F.col("op").isin(*OPS)), files, owners)
    return of_files.unionByName(of_projects.select(of_files.columns)).unionByName(bad)


def judged_files(requests: DataFrame, files: DataFrame, owners: DataFrame) -> DataFrame:
    """Valid requests on files, with `outcome`; `owners` has each project's owner and the request that ends it, if any."""
    # the project that a creation names, and the file that is there from the start
    asked = owners.withColumnsRenamed({"__project": "__asked", "__owner": "__asked_of", "__end": "__asked_end"})
    known = files.join(owners, files["project"] == owners["__project"], "left").select(F.col("file").alias("__file"), F.col("__owner").alias("__held_by"), F.col("__end").alias("__held_end"), F.lit(True).alias("__there"))
    rows = requests.join(asked, (requests["project"] == asked["__asked"]) & (requests["op"] == "create"), "left")
    rows = rows.join(known, rows["file"] == known["__file"], "left")
    before = Window.partitionBy("file").orderBy("request").rowsBetween(Window.unboundedPreceding, -1)

    def until(end: Column) -> Column:
        return end.isNull() | (F.col("request") < end)

    there = F.coalesce(F.col("__there"), F.lit(False))
    may = same(F.col("__asked_of"), F.col("asker")) & until(F.col("__asked_end"))
    creates = (F.col("op") == "create") & may & ~there
    rows = rows.withColumn("__made", F.first(F.when(creates, F.struct(F.col("asker").alias("by"), F.col("__asked_end").alias("end"))), ignorenulls=True).over(before))
    owner = F.when(there, F.col("__held_by")).otherwise(F.col("__made.by"))
    end = F.when(there, F.col("__held_end")).otherwise(F.col("__made.end"))
    rows = rows.withColumn("__mine", same(owner, F.col("asker")) & until(end))
    gone = F.coalesce(F.max((F.col("op") == "delete") & F.col("__mine")).over(before), F.lit(False))
    create = F.when(~may, "unauthorized").when(there | F.col("__made").isNotNull(), "taken").otherwise("ok")
    outcome = F.when(F.col("op") == "create", create).when(F.col("__mine") & ~gone, "ok").otherwise("unauthorized")
    return rows.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def applied(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The files (file, project, name, content) after all requests that are ok."""
    good = outcomes.where("outcome = 'ok'")
    at = F.col("request")
    each = good.where(F.col("op").isin(*OPS)).groupBy(F.col("file").alias("__file")).agg(
        F.max(F.col("op") == "delete").alias("__gone"),
        F.max(F.when(F.col("op") == "create", F.col("project"))).alias("__project"),
        F.max_by(F.struct("name"), F.when(F.col("op").isin("create", "rename"), at)).alias("__name"),
        F.max_by(F.struct(F.coalesce("content", F.lit("")).alias("content")), F.when(F.col("op").isin("create", "update"), at)).alias("__content"),
    )
    rows = files.join(each, files["file"] == each["__file"], "full").where(~F.coalesce(F.col("__gone"), F.lit(False)))
    rows = rows.select(
        F.coalesce("file", "__file").alias("file"), F.coalesce("project", "__project").alias("project"), F.when(F.col("__name").isNotNull(), F.col("__name.name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("__content").isNotNull(), F.col("__content.content")).otherwise(F.col("content")).alias("content"),
    )
    return rows.join(good.where("op = 'delete_project'").select("project").distinct(), "project", "left_anti").select("file", "project", "name", "content")


def applied_projects(projects: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The projects (with all their columns) after all requests that are ok."""
    good = outcomes.where(F.col("outcome").eqNullSafe("ok") & F.col("op").isin(*PROJECT_OPS))
    each = good.groupBy(F.col("project").alias("__project")).agg(
        F.max(F.col("op") == "delete_project").alias("__gone"),
        *[F.max_by(c, F.when((F.col("op") == "update_project") & F.col(c).isNotNull(), F.col("request"))).alias(f"__{c}") for c in ("name", "description")],
    )
    rows = projects.join(each, projects["project"] == each["__project"], "left").where(~F.coalesce(F.col("__gone"), F.lit(False)))
    return rows.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ("name", "description") else F.col(c) for c in projects.columns])
