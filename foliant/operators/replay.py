"""Lists that a log of edits comes to, without the log of a list ever being in one place.

An edit appends an element, replaces it where it is, or removes it, by its id. An element that is there after all edits
stands where it was first appended after its last removal, with what it was last given since. Both follow from the edits
of that element alone: its rows after the last removal are found by a running window from the end, and one aggregation
gives their first append and their last content. Only the places are counted within a list.

Edits of an element that isn't there change nothing, and an append of one that is there replaces it. Edits without a list
or an element are left out; a null content is a content. Edits at the same place of the log are taken by their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

APPEND, REPLACE, REMOVE = "append", "replace", "remove"


def survivors(log: DataFrame, owner: str, element: str, at: str, op: str, content: str) -> DataFrame:
    """owner, element, `since` (where in the log it was appended) and its last content, for each element that is there in the end."""
    back = Window.partitionBy(owner, element).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.where(F.col(owner).isNotNull() & F.col(element).isNotNull() & F.col(op).isin(APPEND, REPLACE, REMOVE))
    rows = rows.withColumn("__removed", F.max(F.col(op) == REMOVE).over(back)).where("NOT __removed")
    held = rows.groupBy(owner, element).agg(F.min(F.when(F.col(op) == APPEND, F.col(at))).alias("since"), F.max_by(F.struct(F.col(content).alias("c")), at).alias("__last"))
    return held.where(F.col("since").isNotNull()).select(owner, element, "since", F.col("__last.c").alias(content))


def replayed(log: DataFrame, owner: str, element: str, at: str, op: str, content: str) -> DataFrame:
    """owner, place (from 1), element and content of each list in the end, a row for each element. `at` orders the log and is unique within a list."""
    rows = survivors(log, owner, element, at, op, content)
    return rows.select(owner, F.row_number().over(Window.partitionBy(owner).orderBy("since", element)).alias("place"), element, content)
