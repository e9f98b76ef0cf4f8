"""Text expressions, Column to Column. All stay in the JVM; a null argument gives null unless the docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and \s know, line terminators, and the fence of a code block.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_LINE_END = r"[^\n\r\u2028\u2029]"
FENCE = "```"
BLOCK = FENCE + r"(?:latex)?" + SPACE + r"*\n([\s\S]*?)" + FENCE

# Sizes and limits of the editing flow.
SINGLE_CALL_TOKENS = 6000
LEAST_RETRY_SECONDS = 5


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(x, "UTF-16BE")) / 2


def token_estimate(x: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(utf16_length(x) / 4).cast("long")


def trim_space(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def strip_comments(x: Column) -> Column:
    """From each percent sign to the end of its line; an escaped sign counts as well."""
    return F.regexp_replace(x, f"%{NOT_LINE_END}*", "")


def squeeze_blanks(x: Column) -> Column:
    return F.regexp_replace(x, "[ \t]+", " ")


def squeeze_lines(x: Column) -> Column:
    """Runs of blank lines become one."""
    return F.regexp_replace(x, rf"\n{SPACE}*\n", "\n\n")


def preprocess(x: Column) -> Column:
    return trim_space(squeeze_lines(squeeze_blanks(strip_comments(x))))


def matched(x: Column, pattern: str, group: int) -> Column:
    """The group of the first match, null where there is none."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def fenced_block(x: Column) -> Column:
    """The trimmed content of the first code block, with the latex tag or none."""
    return trim_space(matched(x, BLOCK, 1))


def from_marker(x: Column, marker: str) -> Column:
    """The text from the first marker on, null without it."""
    at = F.instr(x, marker)
    return F.when(at > 0, F.substring(x, at, F.length(x)))


def updated_block(x: Column) -> Column:
    """The code block after the marker of updated text; of the whole text where the marker is missing."""
    return fenced_block(F.coalesce(from_marker(x, "UPDATED_LATEX:"), x))


def chunk_id(x: Column) -> Column:
    return matched(x, rf"CHUNK_ID:{SPACE}*([0-9]+)", 1).try_cast("int")


def changes_summary(x: Column) -> Column:
    marker = "CHANGES_SUMMARY:"
    at = F.instr(x, marker)
    return F.when(at > 0, trim_space(F.substring(x, at + len(marker), F.length(x))))


def hide_code(x: Column, applies: Column) -> Column:
    """Each latex block becomes a placeholder, in rows where `applies`."""
    return F.when(applies, F.regexp_replace(x, FENCE + r"latex[\s\S]*?" + FENCE, "[CODE BLOCK TRUNCATED FOR CONTEXT]")).otherwise(x)


def hide_document(x: Column) -> Column:
    """The document that a prompt embeds is left out."""
    return F.regexp_replace(x, r"Here is the current LaTeX document:[\s\S]*?User request:", "User request:")


def says_no_change(summary: Column) -> Column:
    return F.lower(summary).contains("no change")


def retry_after(message: Column) -> Column:
    """Whole seconds that an error text asks to wait; 0 where it asks for none."""
    return F.coalesce(F.ceil(matched(message, r"(?i)try again in ([0-9]+\.?[0-9]*)s", 1).try_cast("double")), F.lit(0)).cast("long")


def is_token_limit(message: Column) -> Column:
    return message.contains("max_tokens") & message.contains("less than or equal to")


def or_else(x: Column, other: Column) -> Column:
    """`other` where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def json_or(x: Column, path: str, other: Column) -> Column:
    return or_else(F.get_json_object(x, path), other)


def file_type(name: Column) -> Column:
    """tex for names that end so, else what follows the last dot, else txt; a name without a dot is its own type."""
    last = F.element_at(F.split(name, r"\.", -1), -1)
    return F.when(name.endswith(".tex"), F.lit("tex")).otherwise(or_else(last, F.lit("txt")))


def download_name(name: Column) -> Column:
    """The first .tex goes and .pdf is added; document.pdf without a name."""
    at = F.instr(name, ".tex")
    stem = F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 4, F.length(name)))).otherwise(name)
    return F.concat(or_else(stem, F.lit("document")), F.lit(".pdf"))


def asset_kind(mime: Column) -> Column:
    return F.when(mime.startswith("image/"), F.lit("image")).otherwise(F.lit("file"))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its base: no prefix of it has more steps up than down."""
    steps = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return ~path.startswith("/") & F.aggregate(steps, start, step, lambda acc: acc["ok"] & (acc["depth"] > 0))


def encoded(x: Column) -> Column:
    """Base64 of a text's UTF-8 bytes, in one line."""
    return F.base64(x.cast("binary"))


def decoded(x: Column) -> Column:
    return F.unbase64(x)


def data_url_content(x: Column) -> Column:
    """What follows the first comma of a data URL, or all of it without one."""
    return F.when(F.instr(x, ",") > 0, F.element_at(F.split(x, ",", -1), 2)).otherwise(x)


def shown_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def with_suffix(name: Column) -> Column:
    return F.when(name.endswith(".tex"), name).otherwise(F.concat(name, F.lit(".tex")))


def route_class(path: Column) -> Column:
    """auth, open (static files and calls that check for themselves), public or private."""
    static = path.rlike(r"\.(ico|svg|png|jpg|jpeg|gif|webp|css|js)\z")
    free = path.startswith("/_next") | path.startswith("/api/trpc") | path.startswith("/api/upload") | path.startswith("/uploads") | static
    return F.when(path.startswith("/api/auth"), "auth").when(free, "open").when(path.isin("/login", "/register"), "public").otherwise("private")


def route_decision(route: Column, authenticated: Column) -> Column:
    away = F.when(authenticated & (route == "public"), "/dashboard").when(~authenticated & (route == "private"), "/login")
    return F.coalesce(away, F.lit("next"))


def asset_url(project: Column, name: Column) -> Column:
    return F.concat(F.lit("/uploads/"), project.cast("string"), F.lit("/"), name)


def header_start(header: Column) -> Column:
    return F.substring(header, 1, 15)


def chunk_prompt(chunk: Column, total: Column, text: Column, request: Column) -> Column:
    """What a worker is asked about its chunk."""
    form = "CHUNK_ID: %1$d\nTOTAL_CHUNKS: %2$d\n\nHere is body chunk %1$d of %2$d:\n\n```latex\n%3$s\n```\n\nUser editing instruction: %4$s"
    return F.format_string(form, chunk, total, text, request)


def document_prompt(text: Column, request: Column) -> Column:
    return F.format_string("Here is the current LaTeX document:\n\n```latex\n%s\n```\n\nUser request: %s", text, request)


def worker_lines(status: Column, models: list[str]) -> Column:
    """A line for each worker, from the array of what they are at; they take the models in turn."""
    names = F.array(*map(F.lit, models))

    def line(s: Column, i: Column) -> Column:
        sign = F.when(s == "completed", "✅").otherwise("⏳")
        return F.concat(sign, F.lit(" Agent "), (i + 1).cast("string"), F.lit(" ("), F.element_at(names, (i % len(models) + 1).cast("int")), F.lit("): "), s)

    return F.array_join(F.transform(status, line), "\n")
