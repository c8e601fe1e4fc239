"""Draws that depend only on their key, never on partitioning or retries.

All draws come from md5, which every SQL engine has, so a query built on them
can be checked elsewhere value by value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 8  # 16 bits each


def digest(*key: Column) -> Column:
    """Hex md5 of the key parts joined by ":"."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary"))


def draw(hex_digest: Column, i: int) -> Column:
    """The i-th uniform double in [0, 1) of a digest, in steps of 1/65536."""
    return F.conv(F.substring(hex_digest, 4 * i + 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def unit(*key: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(*key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def pick(u: Column, n: Column | int) -> Column:
    """Uniform int in [0, n) from a uniform double."""
    return F.floor(u * n).cast("int")
