"""Gain-map metadata: a binary record of fractions, and the properties of a metadata packet that mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import held, packed, unsigned
from .color import lit
from .names import parse_number

#: Flags of the record. Fixed values of the format.
BACKWARD, COMMON_DENOMINATOR, BASE_COLOURS, THREE_CHANNELS = 1 << 2, 1 << 3, 1 << 6, 1 << 7
#: The parts of a channel in their order, and whether they are signed.
PARTS = (("gain_min", True), ("gain_max", True), ("gamma", False), ("base_offset", True), ("alternate_offset", True))
FIELDS = "version:string,base_colours:boolean,base_headroom:double,alternate_headroom:double," + ",".join(f"{p}:array<double>" for p, _ in PARTS) + ",error:string"


def _turned(found: dict[str, Column], backward: Column) -> dict[str, Column]:
    """Base and alternate change places where the map leads backward."""
    swap = {"base_headroom": "alternate_headroom", "base_offset": "alternate_offset"}
    swap |= {b: a for a, b in swap.items()}
    return {k: F.when(backward, found[swap[k]]).otherwise(v) if k in swap else v for k, v in found.items()}


def _record(found: dict[str, Column], error: Column) -> Column:
    names = [f.split(":")[0] for f in FIELDS.split(",") if ":" in f]
    cells = [error.alias("error") if n == "error" else F.when(error.isNull(), found[n]).alias(n) for n in names]
    return F.struct(*cells).cast(f"struct<{FIELDS}>")


def iso_gain_map(data: Column) -> Column:
    """The record in bytes as a struct of version, base_colours, headrooms, five arrays of three channels, and error.

    One channel stands for all three. A quotient by 0 is null. A record that is too short or of a later version has an error and nothing
    else; bytes after it do not count. Records of 62 or 142 bytes have a byte in front of them that does not count.
    """
    big = F.lit(False)

    def read(data: Column, at0: Column) -> Column:
        u = lambda at, size: unsigned(data, at0 + at, size, big)
        #: All numbers of four bytes after the flags, at most two headrooms and five parts of three channels with a denominator each.
        most = 2 * (2 + 3 * len(PARTS))
        words = F.transform(F.sequence(F.lit(0), F.least(F.floor((F.length(data) - at0 - 5) / 4), F.lit(most)).cast("int")), lambda k: u(k * 4 + 5, 4))
        return held(F.struct(u(0, 2).alias("version"), u(2, 2).alias("writer"), u(4, 1).alias("flags"), F.when(F.length(data) - at0 > 8, words).alias("words")), lambda h: record(data, at0, h))

    def record(data: Column, at0: Column, h: Column) -> Column:
        has = lambda bit: h["flags"].bitwiseAND(bit) != 0
        return held(F.struct(has(COMMON_DENOMINATOR).alias("common"), F.when(has(THREE_CHANNELS), 3).otherwise(1).alias("channels")), lambda form: parts(data, at0, h, has, form))

    def parts(data: Column, at0: Column, h: Column, has, form: Column) -> Column:
        over = lambda v, d: F.when(d != 0, v / d)
        word = lambda k: F.get(h["words"], k).cast("double")
        signed = lambda v, sign: held(v, lambda v: F.when(v >= 2.0**31, v - 2.0**32).otherwise(v)) if sign else v
        #: With a common denominator numbers follow each other, else each is followed by its own.
        fraction = lambda k, sign: F.when(form["common"], over(signed(word(k + 1), sign), word(F.lit(0)))).otherwise(over(signed(word(k * 2), sign), word(k * 2 + 1)))
        size = F.when(form["common"], 9 + 4 * (form["channels"] * 5 + 2)).otherwise(5 + 8 * (form["channels"] * 5 + 2))
        found = {"version": F.format_string("ISO 21496-1 v%d / v%d", h["version"], h["writer"]), "base_colours": has(BASE_COLOURS), "base_headroom": fraction(F.lit(0), False), "alternate_headroom": fraction(F.lit(1), False)}
        for p, (name, sign) in enumerate(PARTS):
            found[name] = F.transform(F.array(*[F.lit(c) for c in range(3)]), lambda c: fraction(F.when(form["channels"] == 3, c).otherwise(0) * 5 + 2 + p, sign))  # noqa: B023
        short = data.isNull() | h["flags"].isNull()
        error = F.when(short, "not enough data").when(h["version"] > 0, F.concat(F.lit("version "), h["version"].cast("string"))).when(at0 + size > F.length(data), "not enough data")
        return held(error, lambda error: _record(_turned(found, has(BACKWARD)), error))

    return held(data, lambda data: held(F.when(F.length(data).isin(62, 142), 1).otherwise(0).cast("bigint"), lambda at0: read(data, at0)))


def packed_gain_map(headrooms: list[Column], channels: list[list[Column]], denominator: int, flags: Column, common: bool) -> Column:
    """The bytes of a record: two headrooms and, for one or three channels, the five parts, all as whole numbers over the denominator."""
    big, n = F.lit(False), len(channels)
    bits = flags.bitwiseOR(F.lit((COMMON_DENOMINATOR if common else 0) | (THREE_CHANNELS if n == 3 else 0)))
    own = [] if common else [packed(F.lit(denominator), 4, big)]
    out = [packed(F.lit(0), 4, big), packed(bits, 1, big)] + ([packed(F.lit(denominator), 4, big)] if common else [])
    for v in [*headrooms, *[v for channel in channels for v in channel]]:
        out += [packed(v, 4, big), *own]
    return F.concat(*out)


def property_gain_map(leaves: DataFrame, key: str, prefix: str = "hdrgm") -> DataFrame:
    """key and the struct of iso_gain_map() of each packet with a version of the gain-map schema, from metadata leaves (key, property, value).

    A property is one number, three with commas between them, or an array of one or three items. Missing ones have their usual values;
    a missing greatest gain or capacity, and what is no number, is an error.
    """
    own = F.regexp_replace("property", r"\[[0-9]+\]$", "")
    name = F.when(F.startswith("property", F.lit(f"{prefix}:")), F.substring(own, len(prefix) + 2, 1 << 20))
    item = F.coalesce(F.regexp_extract("property", r"\[([0-9]+)\]$", 1), F.lit(""))
    rows = leaves.select(F.col(key), name.alias("name"), F.when(item != "", item.cast("int")).otherwise(0).alias("item"), "value").where("name is not null and value <> ''")
    listed = rows.groupBy(key, "name").agg(F.array_sort(F.collect_list(F.struct("item", "value"))).alias("v"))
    values = listed.select(key, "name", F.array_join(F.transform("v", lambda s: s["value"]), ",").alias("text"))
    text = lambda n: F.max(F.when(F.col("name") == n, F.col("text")))
    names = ("Version", "GainMapMin", "GainMapMax", "Gamma", "OffsetSDR", "OffsetHDR", "HDRCapacityMin", "HDRCapacityMax", "BaseRendition", "BaseRenditionIsHDR")
    wide = values.groupBy(key).agg(*[text(n).alias(n) for n in names]).where("Version is not null")
    three = lambda n, usual: F.when(F.col(n).isNull(), F.array(*[lit(usual)] * 3)).otherwise(_three(F.col(n)))
    at_least = lambda v, low: F.zip_with(v, low, lambda a, b: F.greatest(a, b))
    same = lambda low: F.array(*[lit(low)] * 3)
    low, one = three("GainMapMin", 0.0), lambda n, usual: F.when(F.col(n).isNull(), lit(usual)).otherwise(parse_number(F.col(n)))
    base = one("HDRCapacityMin", 0.0)
    found = {
        "version": F.concat(F.lit("XMP v"), "Version"), "base_colours": F.lit(True), "base_headroom": base, "alternate_headroom": F.greatest(parse_number(F.col("HDRCapacityMax")), base),
        "gain_min": low, "gain_max": at_least(_three(F.col("GainMapMax")), low), "gamma": at_least(three("Gamma", 1.0), same(0.001)),
        "base_offset": at_least(three("OffsetSDR", 1 / 64), same(0.0)), "alternate_offset": at_least(three("OffsetHDR", 1 / 64), same(0.0)),
    }
    error = F.lit(None).cast("string")
    for n in ("GainMapMin", "GainMapMax", "Gamma", "OffsetSDR", "OffsetHDR", "HDRCapacityMin", "HDRCapacityMax"):
        wrong = F.col(n).isNotNull() & (parse_number(F.col(n)).isNull() if n.startswith("HDR") else _three(F.col(n)).isNull())
        error = F.coalesce(error, F.when(wrong, f"{n} is not one number or three"))
    for n in ("GainMapMax", "HDRCapacityMax"):
        error = F.coalesce(error, F.when(F.col(n).isNull(), f"{n} is required"))
    backward = F.when(F.col("BaseRendition").isNotNull(), F.col("BaseRendition").isin("HDR", "HighDynamicRange")).otherwise(F.coalesce(F.lower("BaseRenditionIsHDR").isin("true", "t", "1", "on", "yes"), F.lit(False)))
    return wide.select(key, _record(_turned(found, backward), error).alias("gain_map"))


def _three(text: Column) -> Column:
    """Three numbers of one or three with commas between them; null for anything else."""
    parts = F.transform(F.split(text, ","), lambda p: parse_number(F.trim(p)))
    whole = F.size(parts).isin(1, 3) & ~F.exists(parts, lambda v: v.isNull())
    return F.when(whole, F.when(F.size(parts) == 1, F.array_repeat(parts[0], 3)).otherwise(parts))
