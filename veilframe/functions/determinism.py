"""Hash-driven order and uniforms, equal on every engine and partitioning.

A device for tests and reproducible runs only. Published noise needs entropy that nobody can replay: it is drawn by
entropy(), on the driver, and never stands in a plan as a seed.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, key: Column) -> Column:
    """Hex digest by which rows are shuffled."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def uniform(seed: int | str, key: Column) -> Column:
    """A double in [0, 1) from the digest's first 32 bits."""
    return F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def entropy() -> float:
    """A double in [0, 1) from 53 bits of the operating system's entropy."""
    return secrets.randbits(53) / (1 << 53)


def fresh_salt() -> str:
    """128 bits of the operating system's entropy: keys draws that need not be secret, but should differ from run to run."""
    return secrets.token_hex(16)
