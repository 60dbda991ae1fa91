"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """The column of just this name, also where it has dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct."""
    return F.struct(*[named(c).alias(c) for c in docs.columns])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on pure ASCII, where it is the faster of the two."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def utf8(c: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(c, F.lit(""))
