"""Session settings that the package's results rest on."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
}


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@functools.cache
def own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share; in local mode, where none is named, in one made up."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{(found or own_dir(spark.sparkContext.applicationId)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
