"""Closed ranges of suffix-array rows, and counting in bit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class SearchRange:
    """Rows from start_ptr to end_ptr, both included; empty if start_ptr > end_ptr."""

    start_ptr: int
    end_ptr: int

    @classmethod
    def zero(cls) -> SearchRange:
        return cls(1, 0)

    def is_empty(self) -> bool:
        return self.start_ptr > self.end_ptr

    def __len__(self) -> int:
        return max(self.end_ptr - self.start_ptr + 1, 0)

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.start_ptr, self.end_ptr + 1))


@dataclass(frozen=True, order=True)
class LocalizedPosition:
    """A place in the collection: sequence, and 0-based position within it."""

    sequence_idx: int
    local_position: int


def range_length(start: Column, end: Column) -> Column:
    return F.greatest(end - start + 1, F.lit(0).cast("long"))


def range_rows(start: Column, end: Column) -> Column:
    """An array of the rows; empty for an empty range (``sequence`` would count down)."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))


def bit_of(words: Column, position: Column) -> Column:
    """The bit at a position of a vector held as an array of longs."""
    return F.getbit(F.element_at(words, (F.shiftright(position, 6) + 1).cast("int")), position.bitwiseAND(F.lit(63)).cast("int"))


def with_bit(words: Column, position: Column) -> Column:
    """The vector with the bit at a position set."""
    place = F.shiftright(position, 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(F.lit(63)).cast("int"))
    return F.transform(words, lambda w, i: F.when(i == place, w.bitwiseOR(bit)).otherwise(w))


def empty_bits(length: Column) -> Column:
    """A vector of so many bits, none set."""
    return F.array_repeat(F.lit(0).cast("long"), F.ceil(length / F.lit(64)).cast("int"))


def masked_popcount(word: Column, position: Column) -> Column:
    """Set bits of a long from bit 0 to ``position``, included."""
    return F.bit_count(F.call_function("shiftleft", word, (F.lit(63) - position).cast("int")))
