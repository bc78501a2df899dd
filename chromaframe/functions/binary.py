"""Numbers at places of binary columns, and bytes of numbers, in either byte order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import lit


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f looks at it, and stands once in the plan."""
    return F.transform(F.array(value), f)[0]


def _turned(v: Column, size: int) -> Column:
    """A number of so many bytes with its bytes in the other order."""
    out = F.shiftleft(v.bitwiseAND(255), 8 * (size - 1))
    for k in range(1, size):
        byte = F.shiftright(v, 8 * k).bitwiseAND(255)
        out = out.bitwiseOR(F.shiftleft(byte, 8 * (size - 1 - k)))
    return out


def unsigned(data: Column, at: Column, size: int, little: Column) -> Column:
    """The number of up to 4 bytes at a place from 0, as bigint; null if the place lies outside."""

    def read(at: Column) -> Column:
        big = F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(size))), 16, 10).cast("bigint")
        number = big if size == 1 else F.when(little, held(big, lambda v: _turned(v, size))).otherwise(big)
        return F.when((at >= 0) & (at + size <= F.length(data)), number)

    return held(at, read)


def big(data: Column) -> Column:
    """The number of up to 7 bytes, high ones first, as bigint."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def turned(data: Column) -> Column:
    """Bytes from last to first."""
    return F.encode(F.reverse(F.decode(data, "ISO-8859-1")), "ISO-8859-1")


def as_signed(v: Column, size: int) -> Column:
    return F.when(v >= 1 << (8 * size - 1), v - (1 << 8 * size)).otherwise(v)


def signed(data: Column, at: Column, size: int, little: Column) -> Column:
    return held(unsigned(data, at, size, little), lambda v: as_signed(v, size))


def _floating(negative: Column, exponent: Column, fraction: Column, bias: int, top: int) -> Column:
    """fraction is below 1, bias and top belong to the format."""
    normal = (fraction + 1) * F.pow(lit(2), exponent - bias)
    size = F.when(exponent == top, F.when(fraction == 0, lit(float("inf"))).otherwise(lit(float("nan")))).when(exponent == 0, fraction * F.pow(lit(2), F.lit(1 - bias))).otherwise(normal)
    return F.when(negative, -size).otherwise(size)


def as_float32(v: Column) -> Column:
    return _floating(v >= 1 << 31, F.floor(v / (1 << 23)) % 256, (v % (1 << 23)) / lit(2.0**23), 127, 255)


def float32(data: Column, at: Column, little: Column) -> Column:
    return held(unsigned(data, at, 4, little), as_float32)


def as_float64(first: Column, second: Column, little: Column) -> Column:
    """Of two numbers of 4 bytes, as they follow each other in the block."""
    high, low = F.when(little, second).otherwise(first), F.when(little, first).otherwise(second)
    fraction = ((high % (1 << 20)) * lit(2.0**32) + low) / lit(2.0**52)
    return _floating(high >= 1 << 31, F.floor(high / (1 << 20)) % 2048, fraction, 1023, 2047)


def float64(data: Column, at: Column, little: Column) -> Column:
    return held(F.struct(unsigned(data, at, 4, little).alias("first"), unsigned(data, at + 4, 4, little).alias("second")), lambda words: as_float64(words["first"], words["second"], little))


def packed(value: Column, size: int, little: Column) -> Column:
    """The bytes of a whole number, of a negative one in two's complement."""
    digits = F.lpad(F.hex(F.when(value < 0, value + (1 << 8 * size)).otherwise(value).cast("bigint")), 2 * size, "0")
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.unhex(F.when(little, turned).otherwise(digits))
