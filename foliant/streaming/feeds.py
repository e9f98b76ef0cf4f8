"""Tables brought to a stream as they would arrive: in landings, out of order within a stated lateness, and closed at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import new_folder

#: Marks the row that closes a feed.
CLOSING = "closing"


def landings(rows: DataFrame, ts: str, arrival: str, n: int, ahead: str) -> list[DataFrame]:
    """The rows in n parts by the time of their arrival, an expression of theirs; the last part also has a row that closes the feed.

    The closing row is the latest one with its time put forward by `ahead`, so that all deadlines pass once the watermark
    follows it; `open_rows` takes it out again. Parts are filters on the table; only their bounds are collected.
    """
    rows = rows.withColumn(CLOSING, F.lit(False)).withColumn("__arrival", F.unix_micros(F.expr(arrival).cast("timestamp")))
    bounds = rows.approxQuantile("__arrival", [k / n for k in range(1, n)], 0.01)
    edges = [None, *sorted(set(bounds)), None]
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        within = rows if low is None else rows.where(F.col("__arrival") > low)
        parts.append((within if high is None else within.where(F.col("__arrival") <= high)).drop("__arrival"))
    last = rows.drop("__arrival").orderBy(F.desc(ts)).limit(1)
    closing = last.withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {ahead}")).withColumn(CLOSING, F.lit(True))
    return [*parts[:-1], parts[-1].unionByName(closing)]


def open_rows(stream: DataFrame, ts: str) -> DataFrame:
    """Without the closing row. The condition names the time, so that it isn't moved below the watermark, which the row is to push on."""
    return stream.where(~F.col(CLOSING) | F.col(ts).isNull()).drop(CLOSING)


def incrementally(batches: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lands each batch as files in the shared folder, then starts the stream anew over what has come, until that is used up.

    Each start goes on from the checkpoint of the one before, state included, as it would after a failure. Rows come out
    in append mode into a table, which is returned; the file sink lists each batch's files once, so that a batch that runs
    again doesn't add to it. State has as many partitions as the cluster has cores.
    """
    folder, out = None, None
    for batch in batches:
        spark = batch.sparkSession
        folder = folder or new_folder(spark, "stream")
        batch.write.mode("append").parquet(f"{folder}/in")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
        try:
            out = build(spark.readStream.schema(batch.schema).parquet(f"{folder}/in"))
            options = {"path": f"{folder}/out", "checkpointLocation": f"{folder}/state"}
            out.writeStream.format("parquet").options(**options).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
