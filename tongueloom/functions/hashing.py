"""Keyed hashes in place of random numbers: the same on every run, plan and retry."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, functions as F

SPAN = 4294967296  # values of one 32-bit word


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """md5 (32 hex digits) of the parts joined by ``|``; plain values become literals."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def hash_word(hex_digest: Column, i: int = 0) -> Column:
    """The i-th 32-bit word (0-3) of a hex digest as a bigint."""
    return F.conv(F.substring(hex_digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def hash32(*parts) -> Column:
    return hash_word(digest(*parts))


def hash60(*parts) -> Column:
    """The first 60 bits of the digest as a bigint: an index without wrap-around for any table size."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def uniform(h: Column) -> Column:
    """A 32-bit hash as a number strictly inside (0, 1), safe under a logarithm."""
    return (h + F.lit(1)) / F.lit(float(SPAN + 1))


def hash_word32(text: str) -> int:
    """``hash32`` of one text in Python; parts are joined by the caller."""
    return int.from_bytes(md5(text.encode(), usedforsecurity=False).digest()[:4], "big")
