"""Splitting documents into chunks that leave environments whole.

Whether a line lies inside an environment that must not be cut is a matter of one counter for each such name: it goes up
at a begin, down at an end, and never below zero. A fold over the lines that begin or end such an environment keeps the
counters and gives the ranges of lines that are inside; the cuts are a fold over the few chunks, which looks at these
ranges. A document never leaves its row: nothing is exploded, shuffled or joined, and no user function is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import trim_space

# Environments that are not cut.
UNBREAKABLE = ["figure", "figure*", "table", "table*", "equation", "equation*", "align", "align*", "itemize", "enumerate", "description", "tikzpicture"]
OPENING = "\\begin{document}"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def preamble_lines(text: Column) -> Column:
    """How many lines the preamble has: through the first that opens the document, 0 without one."""
    at = F.array_position(F.transform(lines(text), lambda x: x.contains(OPENING)), True)
    return at.cast("int")


def parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, preamble (a text) and body (an array of lines)."""
    rows = docs.select(key, lines(F.col(text)).alias("__lines"), preamble_lines(F.col(text)).alias("__n"))
    return rows.select(key, F.array_join(F.slice("__lines", F.lit(1), F.col("__n")), "\n").alias("preamble"), F.slice("__lines", F.col("__n") + 1, F.greatest(F.size("__lines") - F.col("__n"), F.lit(0))).alias("body"))


def let(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marks(body: Column) -> Column:
    """The lines that begin or end an unbreakable environment: i, and the numbers of the names (0 for others). The first begin and the first end of a line count."""
    names = F.array(*map(F.lit, UNBREAKABLE))

    def named(line: Column, word: str) -> Column:
        return F.when(line.contains(f"\\{word}{{"), F.array_position(names, F.regexp_extract(line, rf"\\{word}\{{([^}}]+)\}}", 1))).otherwise(F.lit(0)).cast("int")

    found = F.transform(body, lambda line, i: F.struct(i.alias("i"), named(line, "begin").alias("b"), named(line, "end").alias("e")))
    return F.filter(found, lambda m: (m["b"] > 0) | (m["e"] > 0))


def unsafe(body: Column) -> Column:
    """The ranges (a to b) of lines that lie inside; a line is judged after what it begins and ends itself. Between two ranges there is a safe line."""
    start = F.struct(F.array_repeat(F.lit(0), len(UNBREAKABLE)).alias("counts"), F.lit(None).cast("int").alias("since"), F.array().cast("array<struct<a:int,b:int>>").alias("ranges"))

    def step(acc: Column, m: Column) -> Column:
        counts = F.transform(acc["counts"], lambda c, k: F.greatest(c + (k + 1 == m["b"]).cast("int") - (k + 1 == m["e"]).cast("int"), F.lit(0)))

        def after(x: Column) -> Column:
            since = F.when(x["inside"], F.coalesce(acc["since"], m["i"]))
            closed = F.concat(acc["ranges"], F.array(F.struct(acc["since"].alias("a"), (m["i"] - 1).alias("b"))))
            return F.struct(x["counts"].alias("counts"), since.alias("since"), F.when(~x["inside"] & acc["since"].isNotNull(), closed).otherwise(acc["ranges"]).alias("ranges"))

        return let(counts, lambda c: after_of(c, after))

    def after_of(c: Column, after) -> Column:
        return let(F.struct(c.alias("counts"), F.exists(c, lambda x: x > 0).alias("inside")), after)

    def finish(acc: Column) -> Column:
        last = F.struct(acc["since"].alias("a"), (F.size(body) - 1).alias("b"))
        return F.when(acc["since"].isNotNull(), F.concat(acc["ranges"], F.array(last))).otherwise(acc["ranges"])

    return F.aggregate(marks(body), start, step, finish)


def safe_lines(bodies: DataFrame, key: str) -> DataFrame:
    """key, i and safe, for each line of `body`."""
    rows = bodies.select(key, F.size("body").alias("__n"), unsafe(F.col("body")).alias("__u"))
    inside = F.transform("__u", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.lit(False).alias("safe")))
    # what lies before each range, and after the last
    before = F.transform("__u", lambda r, k: F.struct(F.when(k == 0, 0).otherwise(F.get("__u", k - 1)["b"] + 1).alias("a"), (r["a"] - 1).alias("b"), F.lit(True).alias("safe")))
    rest = F.struct(F.coalesce(F.try_element_at("__u", F.lit(-1))["b"] + 1, F.lit(0)).alias("a"), (F.col("__n") - 1).alias("b"), F.lit(True).alias("safe"))
    ranges = F.filter(F.concat(inside, before, F.array(rest)), lambda r: r["a"] <= r["b"])
    return rows.select(key, F.inline(ranges)).select(key, F.explode(F.sequence("a", "b")).alias("i"), "safe")


def cuts(ranges: str, n: str, target: int) -> str:
    """SQL: the last line of each chunk but the final one, from the ranges of unsafe lines and the number of lines.

    A cut is made at the safe line after the last cut that is nearest to the ideal one, the lower of two; without any at
    the ideal line. Inside a range these are the lines just before and just after it.
    """
    ideal = f"acc.last + cast(ceil({n} / {target}.0) AS int)"
    hit = f"get(filter({ranges}, r -> r.a <= least({ideal}, {n} - 1) AND r.b >= least({ideal}, {n} - 1)), 0)"
    lower, upper = "r.a - 1 > acc.last", f"r.b + 1 < {n}"
    nearest = f"CASE WHEN acc.last >= {n} - 1 THEN {ideal} WHEN r IS NULL THEN least({ideal}, {n} - 1) WHEN {lower} AND ({ideal} - r.a + 1 <= r.b + 1 - ({ideal}) OR NOT {upper}) THEN r.a - 1 WHEN {upper} THEN r.b + 1 ELSE {ideal} END"
    best = f"transform(array({hit}), r -> greatest({nearest}, acc.last + 1))[0]"
    # once the lines are used up, chunks are empty
    step = f"CASE WHEN acc.last >= {n} THEN acc ELSE transform(array({best}), b -> named_struct('last', b + 1, 'ends', array_append(acc.ends, b)))[0] END"
    return f"aggregate(sequence(1, {target} - 1), named_struct('last', 0, 'ends', cast(array() AS array<int>)), (acc, k) -> {step}, acc -> acc.ends)"


def split(docs: DataFrame, key: str, text: str, target: int = 4) -> DataFrame:
    """key, preamble, and chunks in order. Fewer lines than twice the target are one chunk, even an empty one; else blank chunks are dropped."""
    rows = parts(docs, key, text).withColumn("__n", F.size("body"))
    rows = rows.withColumn("__u", F.when(F.col("__n") >= 2 * target, unsafe(F.col("body"))))
    rows = rows.withColumn("__ends", F.expr(f"CASE WHEN __n >= {2 * target} THEN {cuts('__u', '__n', target)} ELSE array() END"))
    bounds = "concat(array(-1), __ends, array(__n - 1))"
    pieces = f"transform(sequence(1, size({bounds}) - 1), k -> array_join(slice(body, ({bounds})[k - 1] + 2, greatest(({bounds})[k] - ({bounds})[k - 1], 0)), '\n'))"
    rows = rows.withColumn("__all", F.expr(pieces))
    kept = F.filter("__all", lambda c: trim_space(c) != "")
    chunks = F.when(F.col("__n") < 2 * target, F.array(F.array_join("body", "\n"))).otherwise(kept)
    # what reads the chunks more than once stays above this, instead of having the cuts made as often
    return rows.select(F.inline(F.array(F.struct(F.col(key), F.col("preamble"), chunks.alias("chunks")))))
