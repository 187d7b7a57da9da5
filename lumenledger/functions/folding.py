"""Names and queries as they are compared: Unicode folded, so that ligatures, full-width forms and case make no difference.

Spark has no compatibility normalisation, so these run on Arrow batches in Python workers. Each character's part
is looked up in a table that fills itself.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Refused(ValueError):
    pass


class _Parts(dict):
    """What becomes of a folded character: white space, separators and punctuation a space, others themselves; controls and the like are refused."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind == "C":
            raise _Refused(c)
        self[code] = " " if kind in "PZ" or c.isspace() else c
        return self[code]


_PARTS = _Parts()


def folded(text: str | None) -> str | None:
    """Compatibility forms, case and punctuation folded, with one space between words; null where a character is refused or nothing is left."""
    if text is None:
        return None
    try:
        return " ".join(unicodedata.normalize("NFKC", text).casefold().translate(_PARTS).split()) or None
    except _Refused:
        return None


def fold_alias(value: Column) -> Column:
    """The key under which an alias is found. Line ends are controls, and refused."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(folded, na_action="ignore")

    return fold(value)


def fold_query(value: Column) -> Column:
    """A query in which aliases are looked for. White space of any kind is a space before anything is refused."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: folded(" ".join(t.split())), na_action="ignore")

    return fold(value)


def query_digest(value: Column) -> Column:
    """SHA-256 of a query with composed characters and line feeds for line ends; case counts. Null for blank ones."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        one = lambda t: hashlib.sha256(unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")).encode()).hexdigest() if t.strip() else None
        return texts.map(one, na_action="ignore")

    return digest(value)
