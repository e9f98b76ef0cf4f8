"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task works on at a time.
SLICE_CHARS = 2_000_000

#: As many numbers are broadcast at most, which is 16 MB.
BROADCAST_ROWS = 2_000_000

#: The byte set that the contracts call white space.
SPACES = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the queries run over: all rows, the two columns they need."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@functools.cache
def own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made up only in local mode, as in tests, and where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or own_dir(spark.sparkContext.applicationId)).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: `df` as a table in the shared folder, read back. It outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile sends so many rows at a time to Python; of long texts the usual ten thousand take memory in the JVM and in the worker, twice while they grow."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if re.fullmatch(r"[a-z_]+-[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def barrier(df: DataFrame, *columns: str) -> DataFrame:
    """A projection that later ones aren't merged with, so that its expressions are evaluated once."""
    return df.selectExpr(f"inline(array(struct({', '.join(columns)})))")


def small(table: DataFrame, numbers: int = 1) -> DataFrame:
    """Broadcasts a table of so many numbers or words a row as far as it is bounded."""
    return F.broadcast(table) if table.count() * numbers <= BROADCAST_ROWS else table


def fresh(columns: list[str], *stems: str) -> list[str]:
    """Names made of the stems that none of `columns` has."""
    held = {c.lower() for c in columns}
    out = []
    for stem in stems:
        while stem in held:
            stem = f"_{stem}"
        held.add(stem)
        out.append(stem)
    return out


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many characters; a longer text has a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def by_slices(work: Callable[[list, list[str]], pa.RecordBatch], rows: int = 1000, chars: int = SLICE_CHARS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, text): calls `work(ids, texts)` for bounded runs of rows; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
                for a, b in slices(texts, chars):
                    yield work(ids[a:b], texts[a:b])

    return run


class Cache(dict):
    """A dict for what distinct words come to; it is emptied when it would hold more than `most` entries or 32 characters for each, so that memory stays bounded."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.chars = most, 0

    def resolve(self, lists: list[list], make: Callable[[list], list]) -> list[list]:
        """The values of all words of `lists`; `make` gives those of the distinct words not held yet."""
        found = [list(map(self.get, words)) for words in lists]
        holes = [[i for i, v in enumerate(values) if v is None] if None in values else [] for values in found]
        new = list({words[i] for words, at in zip(lists, holes, strict=True) for i in at})
        fresh = dict(zip(new, make(new), strict=True))
        for words, values, at in zip(lists, found, holes, strict=True):
            for i in at:
                values[i] = fresh[words[i]]
        size = sum(map(len, new))
        if len(self) + len(fresh) > self.most or self.chars + size > 32 * self.most:
            self.clear()
            self.chars = 0
        if len(fresh) <= self.most and size <= 32 * self.most:
            self.update(fresh)
            self.chars += size
        return found
