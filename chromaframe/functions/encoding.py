"""Sample encodings and display rules as Column expressions: scalings, bit fields, half floats, headrooms, captions."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import color as C
from .binary import held
from .color import RGB, lit

# Scalings of decoded samples (0 to 1).


def reference_black_white(v: RGB, bits: int, black: tuple[float, float, float], white: tuple[float, float, float], ycbcr: bool = False) -> RGB:
    """Code values between reference black and white at full range; chroma lies around one half, over 127 codes."""
    top = float(2**bits - 1)
    out = []
    for k, c in enumerate(v):
        chroma = ycbcr and k > 0
        out.append((c * lit(top) - lit(black[k])) * lit((127.0 if chroma else top) / (white[k] - black[k]) / top) + lit(0.5 if chroma else 0.0))
    return tuple(out)


def between_levels(v: Column, black: float = 0.0, white: float = 1.0) -> Column:
    """A display hint's black and white as 0 and 1."""
    return v if (black, white) == (0.0, 1.0) else (v - lit(black)) * lit(1.0 / (white - black))


def grey_to_linear(v: Column, inverted: bool = False) -> Column:
    """sRGB-coded grey, inverted where 0 is white."""
    return C.srgb_to_linear(lit(1) - v if inverted else v)


def uninvert_inks(cmyk: tuple[Column, Column, Column, Column], ycck: bool = False) -> tuple[Column, Column, Column, Column]:
    """Inks of files that store their complement: all four, or black alone where the others went through YCC."""
    return tuple(v if ycck and k < 3 else lit(1) - v for k, v in enumerate(cmyk))


def decode_alpha(v: Column, alpha: Column, transfer: str, kind: str) -> Column:
    """A coded sample as premultiplied linear light. kind is straight, premultiplied (in linear light),
    premultiplied_nonlinear (before the transfer function) or none; an alpha up to 1e-4 is not divided by."""
    if kind == "premultiplied_nonlinear":
        coded = F.when(alpha > 1e-4, v / alpha).otherwise(v)
        return F.when(alpha > 1e-4, C.to_linear(transfer, coded) * alpha).otherwise(C.to_linear(transfer, coded))
    linear = C.to_linear(transfer, v)
    return linear * alpha if kind == "straight" else linear


def inspected(v: RGB, alpha: Column | None, matrix: C.Matrix, transfer: str) -> RGB:
    """Values as a probe or a statistic shows them: straight, in other primaries and coded. Alpha is divided out once."""
    straight = tuple(C.unpremultiply(c, alpha) for c in v) if alpha is not None else v
    return tuple(C.from_linear(transfer, c) for c in C.apply_matrix(matrix, straight))


def display_clamp(v: Column, limit_stops: float, shoulder_stops: float, to_ldr: bool) -> Column:
    """Gamma 2.2, a roll-off of the last stops below the limit, gamma 1/2.2, and the range of the display."""
    held = C.roll_off(C.signed_power(v, 2.2), 2.0 ** (limit_stops - shoulder_stops), 2.0**limit_stops)
    return C.clip(C.signed_power(held, 1 / 2.2), 0.0 if to_ldr else -64.0, 1.0 if to_ldr else 64.0)


def white_multiplier(setting: Column, custom: Column, image_white: Column, system_white: float) -> Column:
    """By how much the display's white is overridden: by the custom level, by the image's, or, for the system's, not at all."""
    level = F.when(setting == "custom", custom).when(setting == "image", image_white)
    return F.coalesce(F.when(level > 0, level / lit(system_white)), lit(1))


# Gain maps.


def headroom(text: Column) -> Column:
    """struct<value, percent> of 'N%' (a share of the map's stops) or stops; null for anything else."""
    percent = text.endswith("%")
    number = F.when(percent, F.substring(text, 1, F.length(text) - 1)).otherwise(text).try_cast("double")
    return F.when(number.isNotNull(), F.struct(F.when(percent, number / lit(100)).otherwise(number).alias("value"), percent.alias("percent")))


def maker_stops(note_33: Column, note_48: Column) -> Column:
    """A vendor gain map's stops from its two maker notes; missing ones count as the weakest effect. Fixed values."""
    a, b = F.coalesce(note_33, lit(0)), F.coalesce(note_48, lit(8))
    low, high = F.when(b <= 0.01, lit(-20) * b + lit(1.8)).otherwise(lit(-0.101) * b + lit(1.601)), F.when(b <= 0.01, lit(-70) * b + lit(3)).otherwise(lit(-0.303) * b + lit(2.303))
    return F.when(a < 1, low).otherwise(high)


def vendor_headroom(stops: Column, target: Column) -> Column:
    """Linear headroom for a target as headroom() gives it."""
    part = F.greatest(lit(0), F.least(stops * target["value"], stops))
    return F.pow(lit(2), F.when(target["percent"], part).otherwise(F.greatest(lit(0), F.least(stops, target["value"]))))


# Bits.


def to_half(v: Column, half_up: bool = False) -> Column:
    """The nearest half-precision value as a double: ties to even, or away from zero; beyond the range null."""
    size = F.abs(v)
    guess = F.floor(F.ln(F.greatest(size, lit(2.0**-24))) / lit(math.log(2.0)))
    exponent = F.when(F.pow(lit(2), guess) > size, guess - 1).when(F.pow(lit(2), guess + 1) <= size, guess + 1).otherwise(guess)
    unit = F.pow(lit(2), F.greatest(exponent, F.lit(-14)) - 10)
    steps = F.floor(size / unit + lit(0.5)) if half_up else F.rint(size / unit)
    found = F.when(v < 0, -(steps * unit)).otherwise(steps * unit)
    return F.when(F.abs(found) <= 65504, found)


def unpack_bits(data: Column, width: int, signed: bool = False) -> Column:
    """array<bigint> of the fields of width bits, most significant bit first, of up to 62 bits; a rest is left out."""
    bits = F.length(data) * 8

    def part(start: Column, n: int) -> Column:
        """n bits, up to 48 as they lie in 7 bytes at most, from the bytes that hold them."""
        first, last = F.shiftright(start, 3), F.shiftright(start + n - 1, 3)
        whole = F.conv(F.hex(F.substring(data, first + 1, last - first + 1)), 16, 10).cast("bigint")
        return F.call_function("shiftright", whole, (last + 1) * 8 - start - n).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))

    low = width - 48 if width > 48 else 0
    field = lambda start: F.shiftleft(part(start, 48), low).bitwiseOR(part(start + 48, low)) if low else part(start, width)
    value = (lambda v: held(v, lambda v: F.when(v >= 1 << width - 1, v - (1 << width)).otherwise(v))) if signed else (lambda v: v)
    return F.when(bits >= width, F.transform(F.sequence(F.lit(0), bits - width, F.lit(width)), lambda start: value(field(start)))).otherwise(F.array().cast("array<bigint>"))


def four_cc(text: Column) -> Column:
    """The first four bytes as a big-endian number."""
    return F.conv(F.hex(F.substring(F.rpad(text, 4, "\0"), 1, 4)), 16, 10).cast("bigint")


def positive_product(*factors: Column) -> Column:
    """The product of sizes; a negative one ends the query."""
    out = F.lit(1).cast("bigint")
    for f in factors:
        out = out * F.when(f < 0, F.raise_error(F.concat(F.lit("negative size "), f.cast("string"))).cast("bigint")).otherwise(f)
    return out


def repaired_utf8(data: Column) -> Column:
    """Text of bytes, with a replacement character for what is not UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


# Matrices on the driver.


def almost_equal(a, b) -> bool:
    return float(np.linalg.norm(np.asarray(a, float) - np.asarray(b, float))) < 1e-6


def scale_of(matrix) -> float:
    """How much a plane transform enlarges: the root of the determinant of its first two rows and columns."""
    return math.sqrt(abs(float(np.linalg.det(np.asarray(matrix, float)[:2, :2]))))


# Captions.

#: Display colours of channels by the lower-case tail: plain and pastel. Fixed values.
CHANNEL_COLOURS = {"r": ("#ff0000", "#cc3333"), "g": ("#00ff00", "#33cc33"), "b": ("#0000ff", "#334dff")}


def channel_colour(tail: Column, pastel: bool = False) -> Column:
    """White for all but red, green and blue."""
    out = F.lit("#ffffff")
    for name, colours in CHANNEL_COLOURS.items():
        out = F.when(F.lower(tail) == name, colours[pastel]).otherwise(out)
    return out


def probe_caption(name: Column, group: Column, zoom: float, x: Column, y: Column, size: tuple[int, int], shown: list[Column], values: list[Column], has_alpha: bool = False) -> Column:
    """Name, group, zoom, place, relative place and size, the inspected values, and sRGB bytes in hexadecimal digits; null where a value is missing."""
    place = F.format_string("@%d,%d (%.3f,%.3f) / %dx%d", x, y, x / lit(size[0]), y / lit(size[1]), F.lit(size[0]), F.lit(size[1]))
    numbers = F.concat_ws(",", *[F.format_string("%.2f", v) for v in shown])
    coded = [v if has_alpha and k == len(values) - 1 else C.linear_to_srgb(v) for k, v in enumerate(values)]
    digits = F.concat(*[F.format_string("%02X", C.to_byte(v)) for v in coded])
    there = functools.reduce(operator.and_, [v.isNotNull() for v in (*shown, *values)])
    return F.when(there, F.concat_ws(" – ", name, group, F.lit(f"{round(zoom * 100)}%"), F.concat(place, F.lit(": "), numbers, F.lit(" / 0x"), digits)))
