"""Reads: owner-scoped lists, lookups, nested children, gates. Filters on keys reach the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(table: DataFrame, owner: str, value, updated: str, key: str) -> DataFrame:
    """An owner's rows, the latest update first; the key settles ties."""
    return table.where(F.col(owner) == value).orderBy(F.col(updated).desc(), F.col(key))


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The row with that key, if there is one."""
    return table.where(F.col(key) == value).limit(1)


def children(table: DataFrame, parent: str, value) -> DataFrame:
    return table.where(F.col(parent) == value)


def children_except(table: DataFrame, parent: str, value, key: str, active) -> DataFrame:
    """Siblings of the active child."""
    return table.where((F.col(parent) == value) & (F.col(key) != active))


def nested(parents: DataFrame, key: str, **collections: tuple[DataFrame, str]) -> DataFrame:
    """Each parent with an array of structs for every named (children, foreign key); empty where it has none.

    Children are gathered before the join, so that two collections don't multiply each other. What a parent holds in
    one row is what the caller asked for; lists without bound are better read with `children`.
    """
    out = parents
    for name, (table, foreign) in collections.items():
        held = table.groupBy(F.col(foreign).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name))
        out = out.join(held, out[key] == held["__key"], "left").drop("__key")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    return out


def with_parent(table: DataFrame, foreign: str, parents: DataFrame, key: str, name: str = "parent") -> DataFrame:
    """Each child with its parent as a struct, null where there is none."""
    held = parents.select(F.col(key).alias("__key"), F.struct(*parents.columns).alias(name))
    return table.join(held, table[foreign] == held["__key"], "left").drop("__key")


def owned(table: DataFrame, foreign: str, parents: DataFrame, key: str, owner: str, value) -> DataFrame:
    """Children whose parent belongs to that owner."""
    mine = parents.where(F.col(owner) == value).select(F.col(key).alias("__key"))
    return table.join(mine, table[foreign] == mine["__key"], "left_semi")


def outcome(requests: DataFrame, wanted: str, asker: str, table: DataFrame, key: str, owner: str) -> DataFrame:
    """Each request with `status`: not_found, forbidden or ok."""
    held = table.select(F.col(key).alias("__key"), F.col(owner).alias("__owner"))
    joined = requests.join(held, requests[wanted] == held["__key"], "left")
    status: Column = F.when(F.col("__key").isNull(), "not_found").when(F.col("__owner").eqNullSafe(F.col(asker)), "ok").otherwise("forbidden")
    return joined.withColumn("status", status).drop("__key", "__owner")


def with_session(requests: DataFrame, user: str, at: str, sessions: DataFrame, session_user: str, expires: str) -> DataFrame:
    """Requests whose user has a session that hasn't expired by then."""
    return requests.join(sessions, (requests[user] == sessions[session_user]) & (sessions[expires] > requests[at]), "left_semi")
