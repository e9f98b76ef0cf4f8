"""Row checks that guard a call, as boolean expressions. A null where a value is required fails; lengths are in UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import utf16_length

# Identifiers of versions 1 to 8, and the nil and the greatest one.
UUID = r"\A(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}|00000000-0000-0000-0000-000000000000|[fF]{8}-[fF]{4}-[fF]{4}-[fF]{4}-[fF]{12})\z"


def sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def is_uuid(x: Column) -> Column:
    return sure(x.rlike(UUID))


def project_ok(name: Column, description: Column) -> Column:
    """A name of 1 to 100 characters; a description, if there is one, of at most 500."""
    return sure(utf16_length(name).between(1, 100)) & (description.isNull() | (utf16_length(description) <= 500))


def file_name_ok(name: Column) -> Column:
    return sure(utf16_length(name).between(1, 255))


def asset_ok(name: Column, kind: Column) -> Column:
    return sure((F.length(name) >= 1) & kind.isin("image", "file"))


def source_ok(text: Column) -> Column:
    return sure(F.length(text) > 0)


def chat_ok(roles: Column, key: Column) -> Column:
    """At least one message, known roles, a key."""
    known = F.forall(roles, lambda r: sure(r.isin("system", "user", "assistant")))
    return sure((F.size(roles) >= 1) & known & (F.length(key) > 0))


# Fixed value: the model that is asked where a call names none.
DEFAULT_MODEL = "qwen-qwq-32b"


def model_or_default(model: Column) -> Column:
    return F.coalesce(model, F.lit(DEFAULT_MODEL))


def password_ok(x: Column) -> Column:
    return sure(utf16_length(x) >= 8)


def with_defaults(name: Column, kind: Column, content: Column) -> Column:
    """A file's fields, with the type tex and empty content where they are missing."""
    return F.struct(name.alias("name"), F.coalesce(kind, F.lit("tex")).alias("type"), F.coalesce(content, F.lit("")).alias("content"))
