"""Random draws that depend on a row's key only, not on partitions, order or engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.values import col

DRAW_RANGE = 1 << 32


def key_draw(keys: Sequence[str], seed: int) -> Column:
    """A whole number in [0, 2^32) from the seed and the row's key columns.

    The key should tell rows apart: rows that share a key share their draw. Every field carries its length
    and nulls are marked, so that keys that differ do not read alike.
    """
    fields = [F.coalesce(F.concat(F.lit("v"), F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in (col(k).cast("string") for k in keys)]
    text = F.concat(F.lit(f"{seed}|"), *fields)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def below(draw: Column, fraction) -> Column:
    """True for the given fraction of draws; the fraction may be a number or a column."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return draw < share * F.lit(float(DRAW_RANGE))
