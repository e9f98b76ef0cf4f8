"""URL filters: rules for hosts with their subdomains and for beginnings of paths, by joins on short hashes.

A URL is expanded into expressions, each a suffix of its host (whole labels) followed by a beginning of its path that
ends at a slash, or by nothing. A rule is filed under its host and the beginning of its path up to the last slash. Both
sides are joined on the first 32 bits of SHA-256 digests; what meets is confirmed by the whole digest and by the rest of
the rule's path, and of the rules that fit the longest one stands. All of it is made of DataFrame functions.

Suffixes with more labels than any rule's host, and beginnings with more slashes than any rule's path, can't meet a
rule and aren't made, so that expressions are bounded by the rules and not by the length of a URL. Rules are broadcast
as far as their sizes add up to a bound; beyond it the join is a shuffled one, with rules repeated for each salt, as one
expression (a top-level domain) may be that of most rows.

Defined results. A null URL, an empty one and one without "://" have an empty host and path, and go on like any other.
Very long URLs are hashed whole. Repeated rows and repeated or null keys stay, row by row. An empty table gives an empty
table; without rules every URL gets the default. Rules whose host or verdict is null are ignored, a null path of a rule
is empty. Of rules of equal length the one with the longer host stands, then blocking. Other columns of the table are
not read and can't clash, as only those listed come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that rows are joined on.
SHORT = 8

#: Rules are broadcast up to so many bytes.
BROADCAST_BYTES = 16_000_000

#: A shuffled join deals the rows of an expression over so many tasks.
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, in lower case, and the path; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filed(rules: DataFrame) -> DataFrame:
    """Rules by the digest of their host and the beginning of their path up to the last slash."""
    rows = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    last = F.instr(F.reverse("rule_path"), "/")
    start = F.when(last > 0, F.substring("rule_path", F.lit(1), F.length("rule_path") - last + 1)).otherwise("")
    digest = F.sha2(F.concat(F.col("rule_host"), start).cast("binary"), 256)
    return rows.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("rule_digest"), "rule_host", "rule_path", "rule_verdict")


def expressions(labels: int, slashes: int) -> str:
    """SQL: the digests of the expressions of the columns host and path."""
    suffixes = f"array_distinct(transform(sequence(1, {labels}), k -> substring_index(host, '.', -k)))"
    starts = f"transform(sequence(0, least({slashes}, length(path) - length(replace(path, '/', '')))), j -> CASE WHEN j = 0 THEN '' ELSE concat(substring_index(path, '/', j), '/') END)"
    return f"flatten(transform({suffixes}, h -> transform({starts}, p -> sha2(cast(concat(h, p) AS binary), 256))))"


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each row's key, url, host, path, rule (host and path in one), verdict, and how many rules fit.

    `rules` has the columns host, path and verdict. Rows are shuffled once by all that tells them apart, before they are
    expanded; what follows, up to the choice of a rule, stays where it is if the rules are broadcast.
    """
    ready = filed(rules)
    sizes = [F.octet_length(c) for c in ready.columns]
    shape = ready.agg(
        F.max(F.size(F.split("rule_host", "\\.", -1))).alias("labels"), F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))).alias("slashes"), F.sum(sum(sizes[1:], sizes[0])).alias("bytes")
    ).first()
    host, path = host_and_path(F.col("url"))
    # repeated rows of one input partition are counted, so that none is lost and a hot row is dealt by partition
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.spark_partition_id().alias("of")).groupBy("key", "url", "of").agg(F.count("*").alias("n"))
    # as an array of one row, so that host and path are made once for all their expressions
    rows = rows.select("key", "url", "of", "n", F.inline(F.array(F.struct(host.alias("host"), path.alias("path")))))
    asked = rows.select("*", F.explode(F.expr(expressions(max(shape.labels or 1, 1), shape.slashes or 0))).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    if (shape.bytes or 0) <= broadcast_bytes:
        met = asked.join(F.broadcast(ready), "short", "left")
    else:
        salted = ready.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("key", "url", "of"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("rule_verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = met.groupBy("key", "url", "of", "n", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"), F.count_if(F.coalesce(fits, F.lit(False))).alias("n_rules"))
    out = best.select("key", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "n_rules", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return out.drop("copy").withColumnsRenamed({"key": key, "url": url})
