"""Numbers drawn from hashes: another run, or a lost task, draws the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of the MD5 hash of seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def whole(seed: int, low: Column | int, beyond: Column | int, *parts: Column) -> Column:
    """A whole number from ``low`` up to, but not, ``beyond``."""
    low, beyond = (x if isinstance(x, Column) else F.lit(x) for x in (low, beyond))
    return (low + F.floor(uniform(seed, *parts) * (beyond - low))).cast("int")
