"""Bits of 64-bit words, the first row at the most significant bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_of(row: Column) -> Column:
    """A word with only the row's bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - row % 64).cast("int"))


def bit_at(word: Column, position: Column) -> Column:
    """The bit of the row at a position of the word."""
    return F.call_function("shiftrightunsigned", word, (F.lit(63) - position % 64).cast("int")).bitwiseAND(1)


def bits_at(word: Column, position: Column, n: int) -> Column:
    """n bits from a position of the word on."""
    return F.call_function("shiftrightunsigned", word, (F.lit(64 - n) - position % 64).cast("int")).bitwiseAND((1 << n) - 1)


def shown(word: Column) -> Column:
    """All 64 bits as text."""
    return F.lpad(F.bin(word), 64, "0")
