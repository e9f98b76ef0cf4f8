"""Resharding by minimum-cost flow: fewest bytes moved from old shards to shards of new capacities.

The flow runs from old shards, which supply their bytes, to new shards, which take up to their capacity; a byte that
stays where it is costs nothing, one that moves costs one. What it says is carried out by blocks: a hash deals each old
shard's rows into blocks whose number grows with the table up to `MOST_BLOCKS`, the blocks are laid end to end, and each
stretch of bytes goes where the flow sends it. So shards differ from their capacity by about a block for each old shard
that they take from, which beyond 33 million rows is a fixed share of a shard, about a ten thousandth. The driver sees
one row for each old shard; blocks are dealt out by window sums over a table of that many rows for each.

Nulls: a null text has no bytes and the checksum of none; a null doc_id or old shard is a value like any other.
Repeated rows are placed each by itself, and slots among equal rows are as good as any. An empty table gives no rows.
Each row travels with its placement, so `rewrite` writes every row of affected shards once, whatever its doc_id. The
query's columns are fixed and come from the files it wrote; `rewrite` keeps all columns of its table and adds none.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh, shared_dir, written

#: Rows in a block, and the most blocks there are.
ROWS, MOST_BLOCKS = 500, 65_536


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows from sources to sinks by successive shortest augmenting paths in the residual graph."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    edges: list[list[int]] = []  # to, room, cost

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append(len(edges))
        edges.append([b, room, price])
        graph[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    arcs = {}
    for i in range(n):
        for j in range(m):
            arcs[i, j] = len(edges)
            edge(i, n + j, supply[i], cost[i][j])
    while True:
        dist, by = [None] * len(graph), [-1] * len(graph)
        dist[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                b, room, price = edges[e]
                if room > 0 and (dist[b] is None or dist[a] + price < dist[b]):
                    dist[b], by[b] = dist[a] + price, e
                    queue.append(b)
        if dist[sink] is None:
            break
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = edges[by[at] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return [[edges[arcs[i, j] ^ 1][1] for j in range(m)] for i in range(n)]


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


#: SQL over `text`.
SIZE, CHECKSUM = "cast(coalesce(octet_length(text), 0) + 1 AS bigint) AS size", "crc32(cast(coalesce(text, '') AS binary)) AS text_crc32"


def sized(docs: DataFrame, old_shard: F.Column) -> DataFrame:
    """What placement needs of each row, and the row itself as __row."""
    return docs.select("doc_id", F.expr(SIZE), F.expr(CHECKSUM), F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def resharded(rows: DataFrame, shards: int) -> DataFrame:
    """Adds `shard` and `slot`, gapless from 0 in each shard, to the rows of `sized`."""
    sizes = written(rows.drop("__row"), "sizes")
    blocks = F.lit(min(MOST_BLOCKS, max(1024, sizes.count() // ROWS)))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), blocks)
    rows = rows.withColumn("block", block)
    sums = written(sizes.withColumn("block", block).groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "blocks")
    old = {r["old_shard"]: r["bytes"] for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).orderBy("old_shard").collect()}
    names, supply = list(old), list(old.values())
    flow = min_cost_flow(supply, capacities(sum(supply), shards), [[0 if name == j else 1 for j in range(shards)] for name in names])
    # the stretches of each old shard's bytes, those that stay first
    stretches = []
    for i, name in enumerate(names):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != name, j)):
            if flow[i][j]:
                stretches.append((name, j, at, at + flow[i][j]))
                at += flow[i][j]
    table = rows.sparkSession.createDataFrame(stretches, "old_shard int, shard int, begins long, ends long")
    along = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a block goes where its middle lies
    middle = sums.withColumn("middle", F.coalesce(F.sum("bytes").over(along), F.lit(0)) + F.floor(F.col("bytes") / 2))
    # there are at most shards * (old shards) stretches
    placed = middle.join(F.broadcast(table), "old_shard").where("middle >= begins AND middle < ends")
    first = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("old_shard", "block", "shard", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first_slot"))
    within = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    # rows are dealt by old shard and block once, for the join and for the slots; texts go through this exchange alone
    return rows.join(placed.hint("merge"), ["old_shard", "block"]).withColumn("slot", F.col("first_slot") + F.row_number().over(within) - 1).drop("first_slot", "block")


def affected(placed: DataFrame) -> DataFrame:
    """The shards that rows leave or enter, whose files have to be rewritten, with the bytes that do."""
    moved = placed.where("old_shard <> shard")
    ends = moved.select(F.explode(F.array(F.col("old_shard"), F.col("shard"))).alias("shard"), "size")
    return ends.groupBy("shard").agg(F.sum("size").alias("bytes"))


def put(rows: DataFrame, shards: list[int], folder: str, name: str = "shard") -> None:
    """Writes `rows`, whose shard is __shard, as the files folder/shard=K, or with another name, of all `shards`; other files there stay."""
    names = [c for c in rows.columns if c != "__shard"]
    if name in [c.lower() for c in names]:  # the folder's name would hide a column of the rows
        for shard in shards:
            rows.where(F.col("__shard") == shard).drop("__shard").write.mode("overwrite").parquet(f"{folder}/{name}={shard}")
        return
    # what a shard had goes, even if nothing comes
    for shard in set(shards) - {r["__shard"] for r in rows.select("__shard").distinct().collect()}:
        rows.where("false").drop("__shard").write.mode("overwrite").parquet(f"{folder}/{name}={shard}")
    rows.withColumnRenamed("__shard", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(folder)


def rewrite(table: DataFrame, placed: DataFrame, folder: str) -> list[int]:
    """Writes the rows of affected shards as folder/shard=K; other shards' files stay as they are.

    `placed` has the rows of `table`, as `sized` took them along. Returns the shards written.
    """
    shards = sorted(r["shard"] for r in affected(placed).select("shard").collect())
    if shards:
        rows = placed.where(F.col("shard").isin(shards))
        put(rows.select(*[F.col("__row")[c].alias(c) for c in table.columns], F.col("shard").alias("__shard")), shards, folder)
    return shards


def moved(placed: DataFrame) -> DataFrame:
    """Rewrites affected shards in a folder of its own: doc_id, size, text_crc32, old_shard, shard and slot of all rows, for rewritten shards as their files have them.

    Files have all columns of the rows under their own names; what is added has names that none of these has.
    """
    spark = placed.sparkSession
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    shards = sorted(r["shard"] for r in affected(placed).select("shard").collect())
    stay = placed.where(~F.col("shard").isin(shards)).select(names)
    if not shards:
        return stay
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    old, slot, shard = fresh(placed.schema["__row"].dataType.names, "old_shard", "slot", "shard")
    rows = placed.where(F.col("shard").isin(shards)).select("__row.*", F.col("old_shard").alias(old), F.col("slot").alias(slot), F.col("shard").alias("__shard"))
    put(rows, shards, folder, shard)
    schema = rows.drop("__shard").schema.add(shard, "integer")
    files = spark.read.schema(schema).parquet(folder)
    return files.selectExpr("doc_id", SIZE, CHECKSUM, f"`{old}` AS old_shard", f"`{shard}` AS shard", f"`{slot}` AS slot").unionByName(stay)
