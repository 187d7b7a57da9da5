"""Text expressions: tokens, lines, digests, names, entropy. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"


def tokens(text: Column) -> Column:
    """All tokens of the original text, each lower-cased after it was matched."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def bigrams(words: Column) -> Column:
    """Adjacent pairs joined by the unit separator."""
    return F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws("\x1f", F.get(words, i - 1), F.get(words, i))),
    ).otherwise(F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    """Lines without their ends; a trailing line end opens no further line, and no text has no lines."""
    return F.when(F.length(text) > 0, F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)).otherwise(F.array().cast("array<string>"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def content_id(size: int, *fields: Column) -> Column:
    """SHA-256 over fields joined by NUL, cut to so many hex digits."""
    return F.substring(F.sha2(F.concat_ws("\x00", *(f.cast("string") for f in fields)).cast("binary"), 256), 1, size)


def slug(value: Column) -> Column:
    """Lower case, letters, digits and separators only, separators as hyphens."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9 _-]", "")), "[ _]+", "-")


def short_name(value: Column) -> Column:
    """The last part of a name that dots or colons qualify."""
    return F.element_at(F.split(value, "[.:]+"), -1)


def query_digest(value: Column) -> Column:
    """SHA-256 of a query with line ends as line feeds; case counts."""
    return F.sha2(F.regexp_replace(value, "\r\n?", "\n").cast("binary"), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for a row: an expression that is repeated in a lambda is evaluated each time."""
    return F.get(F.transform(F.array(value), use), 0)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits of a text's characters."""

    def of(v: Column) -> Column:
        n = F.length(v)
        part = lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n.cast("double")
        return F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), lambda acc, c: acc - let(part(c), lambda p: p * F.log2(p)))

    return let(value, of)


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, rounded down; the session's zone has no part in it."""
    return F.expr(f"floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1000)").cast("long")


def query_normalised(value: Column) -> Column:
    """A query without white space around it, and with one space for each run of it inside."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))
