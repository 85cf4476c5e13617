"""Reproducible random draws from a row number, as integer arithmetic any SQL engine repeats."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modulus (a prime) and the multipliers of the mixing steps.
MODULUS = 2147483647
FIRST = 48271
SECOND = 69621


def salt_of(*names: object) -> int:
    """A stable number for a table, column or purpose."""
    return zlib.crc32(":".join(map(str, names)).encode())


def constants(salt: int) -> tuple[int, int, int]:
    """Multiplier and offsets of one stream of draws."""
    return FIRST + 2 * (salt % 100003), (salt * 7919) % MODULUS, (salt * 104729 + 1) % MODULUS


def draw(row: Column, salt: int) -> Column:
    """Uniform integer below the modulus. All intermediate values fit a bigint."""
    a, b, c = constants(salt)
    p = F.lit(MODULUS).cast("bigint")
    row = row.cast("bigint")
    low, high = F.pmod(row, p), F.pmod(F.floor(row / p).cast("bigint"), F.lit(1000003))
    x = F.pmod(low * a + high * SECOND + b, p)
    x = F.pmod(x * x + c, p)
    return F.pmod(x * SECOND + b, p)


def unit(row: Column, salt: int) -> Column:
    """Uniform double in [0, 1)."""
    return draw(row, salt) / F.lit(float(MODULUS))


def integer(row: Column, salt: int, low: int, high: int) -> Column:
    """Uniform integer between both bounds, inclusive."""
    return draw(row, salt) % F.lit(high - low + 1) + F.lit(low)


def choice(row: Column, salt: int, values: list | tuple) -> Column:
    """One of a fixed list of values."""
    position = (draw(row, salt) % len(values)).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def skewed_index(
    row: Column, salt: int, size: Column | int, hot_share: float = 0.8, hot_part: float = 0.2
) -> Column:
    """Index below ``size``; ``hot_share`` of the picks fall in the first ``hot_part`` of it."""
    n = F.lit(size) if isinstance(size, int) else size
    hot = F.greatest(F.lit(1), F.floor(n * hot_part))
    inside = F.floor(unit(row, salt + 1) * hot)
    outside = hot + F.floor(unit(row, salt + 1) * F.greatest(F.lit(1), n - hot))
    picked = F.when(unit(row, salt) < hot_share, inside).otherwise(outside)
    return F.least(picked, n - 1).cast("bigint")


def unique_number(row: Column, salt: int, digits: int) -> Column:
    """A number that differs for every row; below ten to the power ``digits`` it has that many at most.

    A multiplication by a factor without common divisor with ten permutes the numbers of the first
    ten to that power rows; rows beyond keep their own number, which is larger than all of these.
    """
    if not 1 <= digits <= 9:
        raise ValueError("between 1 and 9 digits")
    size = 10**digits
    factor = (salt % (size // 10 + 1)) * 10 + 7
    number = row.cast("bigint")
    permuted = F.pmod(number * (factor % size) + salt % size, F.lit(size).cast("bigint"))
    return F.when(number < size, permuted).otherwise(number)


def unique_key(row: Column, prefix: str, digits: int = 9) -> Column:
    number = unique_number(row, salt_of("key", prefix), digits)
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) > digits, text).otherwise(F.lpad(text, digits, "0")))
