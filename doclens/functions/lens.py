"""Byte lens: binary content as text with one character per byte, so that byte patterns are ordinary regexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"


def lens(content: str | Column) -> Column:
    """Text whose n-th character is the n-th byte."""
    return F.decode(F.col(content) if isinstance(content, str) else content, LATIN)


def unlens(t: str | Column) -> Column:
    """The bytes again; exact for text made by lens."""
    return F.encode(F.col(t) if isinstance(t, str) else t, LATIN)


def text_of(hex_bytes: str) -> Column:
    """Lens text of a byte signature given in hex."""
    return F.lit(bytes.fromhex(hex_bytes).decode("latin-1"))


def byte_at(t: Column, offset: Column | int) -> Column:
    """Value of the byte at a zero-based offset; null beyond the end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    char = F.substring(t, at + 1, F.lit(1))
    return F.when(F.length(char) == 1, F.ascii(char)).cast("bigint")


def little_endian(t: Column, offset: Column | int, size: int) -> Column:
    """Unsigned little-endian number of size bytes at a zero-based offset."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    total = byte_at(t, at)
    for k in range(1, size):
        total = total + byte_at(t, at + k) * F.lit(256**k).cast("bigint")
    return total


def u16(t: Column, offset: Column | int) -> Column:
    return little_endian(t, offset, 2)


def u32(t: Column, offset: Column | int) -> Column:
    return little_endian(t, offset, 4)


def any_of(value: Column, needles: list[str]) -> Column:
    """Whether the value holds one of the needles, case-sensitively; false for null."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(value, F.lit(needle))
    return F.coalesce(found, F.lit(False))


def unhexed(value: Column) -> Column:
    """Bytes of a hex string; null unless it has an even number of hex digits and nothing else."""
    return F.when(value.rlike("^(?:[0-9a-fA-F]{2})+$"), F.unhex(value))


def offsets_of(matches: Column, t: Column, length: int) -> Column:
    """Zero-based offsets of fixed-length matches in order, right for repeated equal records too."""

    def following(acc: Column, m: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1)) + length, F.lit(1))
        return F.array_append(acc, F.call_function("locate", m, t, start))

    places = F.aggregate(matches, F.array().cast("array<int>"), following)
    return F.transform(places, lambda p: (p - 1).cast("bigint"))
