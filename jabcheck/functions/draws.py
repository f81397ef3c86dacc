"""Repeatable pseudo-random draws from a row key.

Plain whole-number arithmetic on the key: the same row gives the same draw on any
partitioning, after any retry, and in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2**31 - 1
MULTIPLIER = 48271
HIGH_MULTIPLIER = 16807
SALT_STEP = 69621


def draw(key: Column, salt: int) -> Column:
    """A value in ``[0, MODULUS)``; both halves of the key count and no step leaves 64 bits."""
    modulus = F.lit(MODULUS).cast("long")
    low, high = F.pmod(key, modulus), F.pmod(F.shiftright(key, 31), modulus)
    h = (low * MULTIPLIER + high * HIGH_MULTIPLIER + (salt * SALT_STEP + 1)) % MODULUS
    h = (h * h + (salt * HIGH_MULTIPLIER + 11)) % MODULUS
    return (h * MULTIPLIER + 7) % MODULUS


def draw_below(key: Column, salt: int, n: int) -> Column:
    """A whole number from 0 to ``n - 1``."""
    return (draw(key, salt) % n).cast("int")
