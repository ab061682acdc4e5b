"""Seeded orders and draws that depend on the row key only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_digest(seed: int, salt: str, *keys: Column) -> Column:
    """Hex md5 of seed, salt and keys: uniform, and the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys]))


def order_key(seed: int, salt: str, key: Column) -> Column:
    """Sort key that shuffles rows; the row key itself breaks a digest collision."""
    return F.concat(keyed_digest(seed, salt, key), F.lit("|"), key.cast("string"))


def uniform_draw(seed: int, salt: str, *keys: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 digest bits."""
    head = F.substring(keyed_digest(seed, salt, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)
