"""Writes as pure transforms: a table and a change in, the new table out. `returning` gives the rows that an update sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the text of the file that a new project starts with.
FIRST_FILE = "\\documentclass{article}\n\\begin{document}\nHello World\n\\end{document}"


def insert(table: DataFrame, rows: DataFrame, **defaults: Column) -> DataFrame:
    """Appends rows; a column that is missing or null gets its default."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return table.unionByName(rows.select(table.columns))


def first_files(projects: DataFrame, key: str, content: str = FIRST_FILE) -> DataFrame:
    """The main file of each new project."""
    return projects.select(F.col(key).alias("project_id"), F.lit("main.tex").alias("file_name"), F.lit("tex").alias("file_type"), F.lit(content).alias("content"))


def update(table: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """Sets columns where `hit`; a null condition leaves a row alone."""
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def patch(table: DataFrame, changes: DataFrame, key: str, *names: str, touched: str | None = None, now: Column | None = None) -> DataFrame:
    """Sets the columns that a change supplies, null meaning not supplied; an empty text is supplied. One change a key.

    Rows that a change names get `now` in the column `touched`.
    """
    new = changes.select(F.col(key).alias("__key"), *[F.col(n).alias(f"__{n}") for n in names])
    joined = table.join(new, table[key] == new["__key"], "left")
    out = [F.coalesce(f"__{c}", c).alias(c) if c in names else F.when(F.col("__key").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == touched else F.col(c) for c in table.columns]
    return joined.select(*out)


def delete(table: DataFrame, hit: Column) -> DataFrame:
    return table.where(~F.coalesce(hit, F.lit(False)))


def cascade(parents: DataFrame, key: str, gone: DataFrame, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Parents without those in `gone`, and each child table without the children of these."""
    keys = gone.select(F.col(key).alias("__key"))
    return [t.join(keys, t[c] == keys["__key"], "left_anti") for t, c in ((parents, key), *children)]


def returning(table: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """The rows that `update` sets, as they are afterwards; a filter and a projection, so that it reaches the scan."""
    rows = table.where(hit)
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in table.columns])
