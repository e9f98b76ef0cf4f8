"""The corpus pipeline: documents in, packed sequences out.

Each stage gets all that its predecessor kept, as a table reread from Parquet, and all but the last return the columns
of `documents`. Texts that are toxic go; repeated lines go, and with them texts that had nothing else; of each group of
near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document with the least doc_id stays;
personal data are replaced; what is left is packed into sequences. Null and empty texts are kept throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import jaccard, lines, packing, pii, toxicity
from foliant.llm.common import written

TOXIC, CAPACITY = 0.7, 4096


def measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.rejecting(docs, model, TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(lines.deduplicated(docs, drop_emptied=True))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs, percent=80, words=5)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(pii.sanitised(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY), CAPACITY)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold the run against a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
