"""Tokens of LaTeX text, by a table of states and rules; of the rules of a state the first that matches stands.

The states need a loop over a line, so this is the one Python function of the package's own operators, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COMMENT, COMMAND, BRACKETS = r"%(.*)$", r"\\[a-zA-Z]+", r"[{}()\[\]]"


def math(end: str, kind: str, comments: bool) -> list[tuple[str, str, str | None]]:
    rules: list[tuple[str, str, str | None]] = [(end, kind, "pop"), (COMMAND, "keyword.math", None), (BRACKETS, "delimiter.math", None), (r"[_^\-+*/=<>]", "operator.math", None)]
    return [*rules, *([(COMMENT, "comment", None)] if comments else []), (".", kind, None)]


# The rules (pattern, token, next state).
RULES = {
    "root": [
        (COMMENT, "comment", None),
        (COMMAND, "keyword", None),
        (r"\\[@\w]+", "keyword.control", None),
        (r"\\[%$&_#\\]", "constant.escape", None),
        (r"\$\$", "string.math.block", "mathBlock"),
        (r"\$", "string.math.inline", "mathInline"),
        (r"\\\[", "string.math.block", "mathBlockBracket"),
        (r"\\\(", "string.math.inline", "mathInlineBracket"),
        (BRACKETS, "delimiter", None),
        (r"(?<=\\begin\{)[a-zA-Z0-9*]+(?=\})", "type.environment", None),
        (r"(?<=\\end\{)[a-zA-Z0-9*]+(?=\})", "type.environment", None),
        (r"\d*\.\d+([eE][\-+]?\d+)?", "number.float", None),
        (r"\d+", "number", None),
        (r'"([^"\\]|\\.)*$', "string.invalid", None),
        (r'"', "string", "string"),
    ],
    "mathBlock": math(r"\$\$", "string.math.block", True),
    "mathInline": math(r"\$", "string.math.inline", False),
    "mathBlockBracket": math(r"\\\]", "string.math.block", True),
    "mathInlineBracket": math(r"\\\)", "string.math.inline", False),
    "string": [(r'[^\\"]+', "string", None), (r"\\.", "string.escape", None), (r'"', "string", "pop")],
}
#: What a dot stands for: anything but the ends of lines.
DOT = "[^\n\r\u2028\u2029]"


def compiled(pattern: str) -> re.Pattern:
    """Classes such as those of digits and words are ASCII, and a dot that is no escaped one and in no brackets ends at any end of a line."""
    return re.compile(re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\.", lambda m: DOT if m[0] == "." else m[0], pattern), re.ASCII)


#: The rules of a state in one pattern; its search finds the first place where any of them matches, and of these the first.
COMPILED = {s: re.compile("|".join(f"(?P<r{k}>{compiled(p).pattern})" for k, (p, _, _) in enumerate(rules)), re.ASCII) for s, rules in RULES.items()}


def tokens(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Line, start, end and kind. What no rule matches is skipped; states outlast lines."""
    states = ["root"]
    for number, line in enumerate(text.split("\n")):
        at = 0
        while m := COMPILED[states[-1]].search(line, at):
            _, kind, to = RULES[states[-1]][int(m.lastgroup[1:])]
            yield number, m.start(), m.end(), kind
            at = m.end()
            if to == "pop":
                states.pop()
            elif to:
                states.append(to)


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each token: key, line, start, end, kind."""

    def batch_of(rows: list) -> pa.RecordBatch:
        k, line, start, end, kind = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *[pa.array(c, pa.int32()) for c in (line, start, end)], pa.array(kind, pa.string())], names=[key, "line", "start", "end", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token in tokens(x or ""):
                    rows.append((k, *token))
                    if len(rows) == 20_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return docs.select(key, text).mapInArrow(run, f"{key} long, line int, start int, end int, kind string")
