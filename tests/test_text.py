import random

from pyspark.sql import functions as F

from foliant.functions import checks
from foliant.functions import text as t
from foliant.functions.lexer import RULES, compiled, tokens
from foliant.plans import compiling, edits

FENCE = "```"


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_preprocess(spark):
    cases = {"a % c\nb": "a \nb", "50\\% of x\ny": "50\\\ny", "a  \tb\n\n\n \nc": "a b\n\nc", "a\n% only\nb": "a\n\nb", "  \n x \n ": "x", "": ""}
    assert values(spark, t.preprocess, [*cases, None]) == [*cases.values(), None]


def test_fenced_block(spark):
    cases = {f"a {FENCE}latex\nX\n{FENCE} b": "X", f"{FENCE}\nX\n{FENCE}": "X", f"{FENCE}python\nX\n{FENCE}": None, f"{FENCE}python\nX\n{FENCE}\nY\n{FENCE}": "Y", f"{FENCE}latex\n{FENCE}": "", "none": None}
    assert values(spark, t.fenced_block, list(cases)) == list(cases.values())


def test_ids_and_types(spark):
    assert values(spark, t.chunk_id, ["CHUNK_ID: 3", "CHUNK_ID:12", "chunk_id: 3", "CHUNK_ID: x"]) == [3, 12, None, None]
    names = {"main.tex": "tex", "refs.bib": "bib", "a.b.cls": "cls", "README": "README", "x.": "txt", "main.tex ": "tex "}
    assert values(spark, t.file_type, list(names)) == list(names.values())
    assert values(spark, t.download_name, ["a.tex", "a.tex.tex", "", None]) == ["a.pdf", "a.tex.pdf", "document.pdf", "document.pdf"]


def test_token_estimate_counts_utf16(spark):
    assert values(spark, t.token_estimate, ["", "abcd", "abcde", "😀😀😀"]) == [0, 1, 2, 2]


def test_retry(spark):
    assert values(spark, t.retry_after, ["try again in 7.2s", "Try Again in 1.1s", "soon"]) == [8, 2, 0]
    body = '{"error": {"message": "try again in 7.2s"}}'
    rows = spark.createDataFrame([(429, 1, body), (429, 3, body.replace("7.2", "1.1")), (429, 4, body), (200, 1, "{}")], "s int, a int, b string")
    got = [tuple(r[0])[:2] for r in rows.select(compiling.next_step(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == [("retry", 8), ("retry", 5), ("error", 0), ("done", 0)]


def test_choose(spark):
    block = f"UPDATED_LATEX:\n{FENCE}latex\n{{}}\n{FENCE}\nCHANGES_SUMMARY: {{}}"
    cases = [
        ("o" * 600, block.format("x" * 400, "No changes needed"), "o" * 600),
        ("o" * 600, block.format("x" * 299, "some"), "o" * 600),
        ("o" * 600, block.format("x" * 300, "some"), "x" * 300),
        ("o" * 500, block.format("x", "some"), "x"),
        ("o" * 10, "nothing", "o" * 10),
        ("o" * 10, f"{FENCE}latex\n{FENCE}", "o" * 10),
        ("o", None, "o"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r[0] for r in rows.orderBy("i").select(edits.chosen(F.col("a"), edits.replied_block(F.col("b")), t.changes_summary(F.col("b")))).collect()] == [c for _, _, c in cases]


def test_paths_and_checks(spark):
    assert values(spark, t.inside, ["a", "a/../b", "../a", "a/../../b", "/a", "", "."]) == [True, True, False, False, False, False, False]
    assert values(spark, checks.is_uuid, ["123e4567-e89b-42d3-a456-426614174000", "x", None]) == [True, False, False]
    assert values(spark, checks.password_ok, ["12345678", "1234567", None]) == [True, False, False]


def test_outcome(spark):
    rows = spark.createDataFrame([(None, None, "", "bad"), ("p", "o", None, "bad"), (None, None, "", ""), ("p", "a", "b", None)], "pdf string, o string, e string, m string")
    got = [tuple(r[0]) for r in rows.select(compiling.outcome(F.col("pdf"), F.col("o"), F.col("e"), F.col("m"))).collect()]
    assert got == [(None, "bad", False), ("p", "o\nbad", True), (None, "Unknown compilation error", False), ("p", "a\nb", True)]


def test_lexer():
    got = [(line, a, b, kind) for line, a, b, kind in tokens("\\a{1.5} % c\n$x$\\%")]
    assert [(k, n) for n, *_, k in got] == [("keyword", 0), ("delimiter", 0), ("number.float", 0), ("delimiter", 0), ("comment", 0), ("string.math.inline", 1), ("string.math.inline", 1), ("string.math.inline", 1), ("constant.escape", 1)]


def test_lexer_classes():
    """Letters and digits are ASCII; a comment reaches to the end of its line or is none."""
    assert list(tokens("\\é1 ٣")) == [(0, 2, 3, "number")]
    assert list(tokens("% a\rb")) == [] and list(tokens("% a\u2028")) == [] and list(tokens("%")) == [(0, 0, 1, "comment")]
    assert [k for *_, k in tokens("\\begin{a*} \\end{b}{c}")] == ["keyword", "delimiter", "type.environment", "delimiter", "keyword", "delimiter", "type.environment", "delimiter", "delimiter", "delimiter"]
    assert [(a, k) for _, a, _, k in tokens("$a\r$ 1")] == [(0, "string.math.inline"), (1, "string.math.inline"), (3, "string.math.inline"), (5, "number")]


def test_lexer_rule_by_rule():
    """The first rule of the state that matches at a place, place by place."""
    rng = random.Random(9)
    pieces = ["\\a", "\\@b", "\\%", "\\[", "\\]", "\\(", "\\)", "$", "$$", "%", "{", "}", '"', "\\begin{x}", "1.5e3", "12", " ", "é", "\r", "\n", "+", "\\\\", "\\", "\u2028", "word"]
    for _ in range(400):
        text, want, states = "".join(rng.choices(pieces, k=rng.randint(0, 25))), [], ["root"]
        for number, line in enumerate(text.split("\n")):
            at = 0
            while at < len(line):
                for pattern, kind, to in RULES[states[-1]]:
                    if m := compiled(pattern).match(line, at):
                        want.append((number, at, m.end(), kind))
                        at = m.end()
                        states = states[:-1] if to == "pop" else [*states, to] if to else states
                        break
                else:
                    at += 1
        assert list(tokens(text)) == want, text
