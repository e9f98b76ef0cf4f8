"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every metric is a Spark SQL expression over a document's words and lines; a rule bounds one metric. `verdict` compiles
any such table into a single boolean expression, so that the rules add no operator to the plan.

Nulls: a null text counts as empty, so it has no words and fails. Repeated rows get equal results, an empty table gives
no rows, and columns other than the two named ones are neither read nor returned. Words of three-word windows are told
apart by 64-bit hashes within a text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]+"
WORD = r"[^\\x20\\x09-\\x0D]"

# Frequent words of four languages.
STOP_WORDS = (
    "the of and to in that is was it for with on as are this be at by from or "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le les et en un une du que pour dans qui sur au par plus ne pas "
    "el los las y del se por con una su para al lo como más no"
).split()


class Rule(NamedTuple):
    """Keeps texts whose `metric`, an SQL expression over the columns of `measured`, is from `least` to `most`."""

    name: str
    metric: str
    least: float | None
    most: float | None


RULES = [
    Rule("length", "n_words", 50, 1_000_000),
    Rule("word length", "try_divide(word_chars, n_words)", 2.0, 12.0),
    Rule("symbols", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("marks", "try_divide(n_marks, n_words)", None, 0.5),
    Rule("stop words", "try_divide(n_stop, n_words)", 0.01, None),
    Rule("repeated lines", "try_divide(n_dup_lines, n_lines)", None, 0.3),
    Rule("repeated windows", "try_divide(n_repeat_words, n_words)", None, 0.5),
    Rule("words a line", "try_divide(n_words, n_lines)", 2.0, None),
]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the metrics. Each step is a projection of its own, so that none is evaluated twice."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.expr(f"coalesce(`{text_col}`, '')").alias("text"))
        .selectExpr("doc_id", "text", f"array_remove(split(text, '{SPACE}'), '') AS words", f"filter(split(text, '\\n'), l -> l rlike '{WORD}') AS lines")
        .selectExpr(
            "doc_id",
            "cast(size(words) AS bigint) AS n_words",
            "cast(length(array_join(words, '')) AS bigint) AS word_chars",
            "cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS bigint) AS n_symbols",
            "cast(length(regexp_replace(text, '[^!?]+', '')) AS bigint) AS n_marks",
            "cast(size(lines) AS bigint) AS n_lines",
            "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
            f"cast(size(filter(words, w -> lower(w) IN ({stop}))) AS bigint) AS n_stop",
            "transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))) AS windows",
        )
        # only texts in which a window recurs are sorted
        .withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (h, i) -> struct(h, i))) END"))
        .withColumn("found", F.expr("array_sort(transform(filter(sorted, (s, k) -> s.h = get(sorted, k - 1).h OR s.h = get(sorted, k + 1).h), s -> s.i))"))
        .withColumn("n_repeat_words", F.expr("coalesce(cast(aggregate(transform(found, (p, k) -> least(3, coalesce(get(found, k + 1), p + 3) - p)), 0, (a, b) -> a + b) AS bigint), 0)"))
        # a filter on the metrics stays above this, instead of having the steps folded into it
        .selectExpr("inline(array(struct(doc_id, n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_stop, n_repeat_words)))")
    )


def verdict(rules: list[Rule]) -> F.Column:
    """The rules as one expression; a null metric fails."""
    parts = [f"({r.metric}) {sign} {bound}" for r in rules for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None]
    return F.expr("coalesce(" + " AND ".join(parts) + ", false)" if parts else "true")


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The metrics with base_failed and kept."""
    return (
        measured(docs)
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .withColumn("kept", ~F.col("base_failed") & verdict(RULES if rules is None else rules))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_marks", "n_stop")
    )
