"""Operations on small ordered collections, over arrays or over rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(items: Column, *tests) -> Column:
    """The first element that passes the first test that any passes; then the first element; else null."""
    found = [F.get(F.filter(items, t), F.lit(0)) for t in tests]
    return F.coalesce(*found, F.get(items, F.lit(0)))


def replaced(items: Column, hit, change) -> Column:
    return F.transform(items, lambda x: F.when(hit(x), change(x)).otherwise(x))


def removed(items: Column, hit) -> Column:
    return F.filter(items, lambda x: ~hit(x))


def appended(items: Column, *more: Column) -> Column:
    return F.concat(items, F.array(*more))


def last_n(rows: DataFrame, group: str, order: str, n: int, keep: Column | None = None) -> DataFrame:
    """The last n rows of each group among those to keep; the filter comes before the cut."""
    kept = rows if keep is None else rows.where(keep)
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return kept.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def by_reply_order(items: Column, reply: str, task: str) -> Column:
    """An array of structs ordered by the id that the reply names, else the task's; the task's id settles ties."""
    keyed = F.transform(items, lambda x: F.struct(F.coalesce(x[reply], x[task]).alias("a"), x[task].alias("b"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def truthy(items: Column) -> Column:
    """Without null and empty texts."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def numbered(n: Column) -> Column:
    """1 to n; nothing below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def in_turn(index: Column, values: list[str]) -> Column:
    """The values dealt round."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def joined_lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def any_of(items: Column, values: list[str]) -> Column:
    return F.arrays_overlap(items, F.array(*map(F.lit, values)))
