"""Around a compiler and a chat service that are outside: what goes in, and what their answers mean."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators.collections import truthy

# Retries after a rate limit, and the answer sizes asked for.
RETRIES, ANSWER_TOKENS, FALLBACK_TOKENS = 3, 32768, 8192


def manifest(main: DataFrame, images: DataFrame, files: DataFrame, key: str, name: str, data: str) -> DataFrame:
    """key, name, data of what is compiled: the main text, then images, then files; of equal names the last one stands.

    Within one list, where names may repeat as well, the greatest data stand.
    """
    tables = [df.select(key, name, data, F.lit(k).alias("__rank")) for k, df in enumerate((main, images, files))]
    w = Window.partitionBy(key, name).orderBy(F.col("__rank").desc(), F.col(data).desc())
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).withColumn("__n", F.row_number().over(w))
    return rows.where("__n = 1").drop("__n", "__rank")


# What a compilation may take, in seconds, and how much it may say, in bytes.
TIME_LIMIT, MOST_OUTPUT = 60, 10 * 1024 * 1024


def compiled(manifests: DataFrame, key: str, name: str, data: str, compiler: Callable[[dict[str, str], int], tuple[bytes | None, str, str, str | None]]) -> DataFrame:
    """key, pdf, logs and success of each manifest, gathered by its key.

    The compiler is a parameter, as there is none here: it gets files by name and the time limit, and returns the
    product, its two outputs and an error message. What it raises, and outputs that are too long, are errors as well.
    """
    kind = manifests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for files in batch["__files"]:
                try:
                    pdf, stdout, stderr, message = compiler({f["name"]: f["data"] for f in files}, TIME_LIMIT)
                    if max(len(stdout), len(stderr)) > MOST_OUTPUT:
                        stdout, stderr, message = stdout[:MOST_OUTPUT], stderr[:MOST_OUTPUT], message or "the output is too long"
                except Exception as e:  # a failed compilation is a row of the result
                    pdf, stdout, stderr, message = None, "", "", str(e)
                out.append((pdf, stdout, stderr, message))
            rows = pd.DataFrame(out, columns=["pdf", "stdout", "stderr", "message"])
            rows.insert(0, key, batch[key].to_numpy())
            yield rows

    held = manifests.groupBy(key).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(data).alias("data"))).alias("__files"))
    rows = held.mapInPandas(run, f"`{key}` {kind}, pdf binary, stdout string, stderr string, message string")
    return rows.select(key, outcome(F.col("pdf"), F.col("stdout"), F.col("stderr"), F.col("message")).alias("__o")).select(key, "__o.*")


def outcome(pdf: Column, stdout: Column, stderr: Column, message: Column) -> Column:
    """pdf, logs and success. Without a message nothing went wrong; with one, what was still produced counts as success."""
    fine = F.array_join(truthy(F.array(stdout, stderr)), "\n")
    bad = t.or_else(F.array_join(truthy(F.array(stdout, stderr, message)), "\n"), F.lit("Unknown compilation error"))
    logs = F.when(message.isNull(), fine).otherwise(bad)
    return F.struct(pdf.alias("pdf"), logs.alias("logs"), (message.isNull() | pdf.isNotNull()).alias("success"))


def failed(success: Column, pdf: Column) -> Column:
    return ~success & pdf.isNull()


def next_step(status: Column, attempt: Column, body: Column) -> Column:
    """What follows an answer of a chat service: action (done, retry, fallback or error), wait in seconds, answer size."""
    message = t.json_or(body, "$.error.message", F.lit("Unknown error"))
    retry = (status == 429) & (attempt <= RETRIES)
    fallback = t.is_token_limit(message) & (attempt == 1)
    action = F.when(status < 400, "done").when(retry, "retry").when(fallback, "fallback").otherwise("error")
    wait = F.when(action == "retry", F.greatest(t.retry_after(message), F.lit(t.LEAST_RETRY_SECONDS)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.struct(action.alias("action"), wait.alias("wait"), F.when(action == "fallback", FALLBACK_TOKENS).otherwise(ANSWER_TOKENS).alias("max_tokens"))


def answer(body: Column, model: Column) -> Column:
    return F.struct(t.json_or(body, "$.choices[0].message.content", F.lit("")).alias("content"), t.json_or(body, "$.model", model).alias("model"))
