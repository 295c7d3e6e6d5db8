"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def estimate_tokens(text: Column) -> Column:
    """One token per four characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def mask(value: Column) -> Column:
    """A preview of the ends only: stars up to two characters, ``a***@d***`` for mail addresses, else ``a***z``."""
    domain = F.regexp_replace(value, "(?s)^[^@]*@", "")
    return (
        F.when(F.length(value) <= 2, F.rpad(F.lit(""), 2, "*").substr(F.lit(1), F.length(value)))
        .when(F.instr(value, "@") > 0, F.concat(F.when(F.instr(value, "@") > 1, F.substring(value, 1, 1)).otherwise(F.lit("")), F.lit("***@"), F.substring(domain, 1, 1), F.lit("***")))
        .otherwise(F.concat(F.substring(value, 1, 1), F.lit("***"), F.right(value, F.lit(1))))
    )


def safe_identifier(text: Column, limit: int = 80) -> Column:
    """Every character that is no ASCII letter or digit as ``_``, cut to ``limit``."""
    return F.substring(F.regexp_replace(text, "[^0-9A-Za-z]", "_"), 1, limit)


def snake(text: Column) -> Column:
    """camelCase as snake_case."""
    return F.lower(F.regexp_replace(text, "(?<!^)([A-Z])", "_$1"))


def looks_like_email(text: Column) -> Column:
    """One ``@``, allowed ASCII characters on both sides, a dot in the domain."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]*\.[A-Za-z0-9.-]*$"), F.lit(False))


def preview_width(length: Column) -> Column:
    """Width of a masked preview: all of up to two characters, then one, then two."""
    return F.when(length <= 0, 0).when(length <= 2, length).when(length <= 8, 1).otherwise(2)


def media_type(path: Column) -> Column:
    """Media type of a file by its suffix."""
    out = F.when(path.endswith(".jsonl"), "application/x-ndjson").when(path.endswith(".jsonld"), "application/ld+json").when(path.endswith(".json"), "application/json")
    return out.when(path.endswith(".md"), "text/markdown").when(path.endswith(".txt"), "text/plain").otherwise("application/octet-stream")
