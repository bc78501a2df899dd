"""Headers of self-describing attributes in binary columns: name, type and size, then as many bytes, until an empty name.

Where an attribute begins is known only from the one before it, so a fold carries the place; no place outside the block is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import float32, float64, held, signed, unsigned
from .encoding import repaired_utf8

#: First bytes of a header (and a version after them), and its types of numbers: what one is and how many there are. Fixed values.
MAGIC, START = "762F3101", 8
NUMBERS = {
    "int": ("i", 1), "float": ("f", 1), "double": ("d", 1), "v2i": ("i", 2), "v2f": ("f", 2), "v2d": ("d", 2), "v3i": ("i", 3), "v3f": ("f", 3), "v3d": ("d", 3), "box2i": ("i", 4), "box2f": ("f", 4),
    "m33f": ("f", 9), "m33d": ("d", 9), "m44f": ("f", 16), "m44d": ("d", 16), "chromaticities": ("f", 8), "rational": ("i", 2), "timecode": ("u", 2), "keycode": ("i", 7),
}
#: Types of one byte, and the names of its values.
NAMED = {
    "compression": ("none", "rle", "zips", "zip", "piz", "pxr24", "b44", "b44a", "dwaa", "dwab"), "lineOrder": ("increasingY", "decreasingY", "randomY"),
    "envmap": ("latlong", "cube"), "deepImageState": ("messy", "sorted", "non-overlapping", "tidy"),
}
#: Attributes of a header; one with more of them is an error.
MOST_ATTRIBUTES = 256
_FOUND = "struct<name:string,type:string,at:bigint,size:bigint>"


def _attributes(data: Column, text: Column) -> Column:
    """struct<found, error>; text is the block with a character for each byte. Places count from 1 here, as in text."""
    none = F.array().cast(f"array<{_FOUND}>")
    first = F.struct(F.lit(START + 1).alias("at"), none.alias("found"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"))
    after = lambda at: F.call_function("locate", F.lit("\0"), text, at)
    part = lambda start, end: repaired_utf8(F.encode(F.substring(text, start, end - start), "ISO-8859-1"))

    def read(acc: Column, name_end: Column, type_end: Column, size: Column) -> Column:
        at, end = acc["at"], type_end + 4 + size
        error = F.when((name_end == 0) | (type_end == 0) | size.isNull(), "the header ends early").when(end > F.length(data), F.concat(F.lit("no "), size.cast("string"), F.lit(" bytes for "), part(at, name_end)))
        own = F.struct(part(at, name_end).alias("name"), part(name_end + 1, type_end).alias("type"), (type_end + 4).cast("bigint").alias("at"), size.alias("size"))
        finished = F.struct(at.alias("at"), acc["found"].alias("found"), F.lit(True).alias("done"), F.lit(None).cast("string").alias("error"))
        failed = F.struct(at.alias("at"), acc["found"].alias("found"), F.lit(True).alias("done"), error.alias("error"))
        going = F.struct((end + 1).cast("int").alias("at"), F.concat(acc["found"], F.array(own)).alias("found"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"))
        return F.when((name_end == at) & (name_end > 0), finished).when((name_end > 0) & error.isNull(), going).otherwise(failed)

    def sized(acc: Column, name_end: Column, type_end: Column) -> Column:
        return held(unsigned(data, type_end.cast("bigint"), 4, F.lit(True)), lambda size: read(acc, name_end, type_end, size))

    def step(acc: Column, _: Column) -> Column:
        going = held(after(acc["at"]), lambda name_end: held(after(name_end + 1), lambda type_end: sized(acc, name_end, type_end)))
        return F.when(acc["done"], acc).otherwise(going)

    last = lambda acc: F.struct(acc["found"].alias("found"), F.coalesce(acc["error"], F.when(~acc["done"], F.lit(f"more than {MOST_ATTRIBUTES} attributes"))).alias("error"))
    # An attribute has 7 bytes at least, so a short block needs fewer steps.
    return F.aggregate(F.sequence(F.lit(1), F.least(F.floor(F.length(data) / 7).cast("int") + 2, F.lit(MOST_ATTRIBUTES + 1))), first, step, last)


def _numbers(kind: Column, data: Column) -> Column:
    little = F.lit(True)
    read = {
        "i": (4, lambda at: signed(data, at, 4, little)), "u": (4, lambda at: unsigned(data, at, 4, little)), "f": (4, lambda at: float32(data, at, little)), "d": (8, lambda at: float64(data, at, little)),
    }
    out = F.lit(None).cast("array<double>")
    for letter, (size, one) in read.items():
        names = [n for n, (own, _) in NUMBERS.items() if own == letter]
        whole = F.floor(F.length(data) / size)
        out = F.when(kind.isin(names) & (whole > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), whole - 1), lambda k: one(k * size).cast("double"))).otherwise(out)  # noqa: B023
    return out


def header_rows(blocks: DataFrame, key: str, data: str) -> DataFrame:
    """key, position, name, type, bytes, numbers, text and error: a row per attribute of each header.

    numbers hold the values of number types; text that of strings, the names of channels and named values. A block that is null, has other first bytes
    or breaks off is one row with an error beside the attributes before the break; one whose size does not fit its type has an error.
    """
    rows = blocks.select(F.col(key).alias("key"), F.col(data).alias("block"), F.decode(F.col(data), "ISO-8859-1").alias("latin"))
    known = F.coalesce(F.hex(F.substring("block", 1, 4)) == MAGIC, F.lit(False)) & (F.length("block") > START)
    walked = rows.withColumn("walk", F.when(known, _attributes(F.col("block"), F.col("latin"))))
    own = F.transform("walk.found", lambda a, k: F.struct(k.alias("position"), a["name"].alias("name"), a["type"].alias("type"), F.substring(F.col("block"), (a["at"] + 1).cast("int"), a["size"].cast("int")).alias("bytes"), F.lit(None).cast("string").alias("error")))
    kind = "struct<position:int,name:string,type:string,bytes:binary,error:string>"
    error = F.coalesce(F.col("walk.error"), F.when(~known, F.lit("no header")))
    broken = F.when(error.isNotNull(), F.array(F.struct(*[F.lit(None).alias(c) for c in ("position", "name", "type", "bytes")], error.alias("error")).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    each = walked.select("key", F.concat(F.coalesce(own.cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>")), broken).alias("all"))
    # A plain explode would be filtered by the size of its array before it, which repeats the walk.
    each = each.select("key", F.explode_outer("all").alias("a")).where("a is not null").select("key", "a.*")

    latin = F.decode("bytes", "ISO-8859-1")
    channels = F.array_join(F.regexp_extract_all(latin, F.lit(r"(?s)([^\x00]+)\x00.{16}"), F.lit(1)), ", ")
    text = F.when(F.col("type") == "string", repaired_utf8(F.col("bytes"))).when(F.col("type") == "chlist", repaired_utf8(F.encode(channels, "ISO-8859-1")))
    for name, values in NAMED.items():
        value = F.try_element_at(F.array(*[F.lit(v) for v in values]), F.ascii(latin) + 1)
        text = text.when(F.col("type") == name, F.coalesce(value, F.lit("invalid")))
    sizes = F.create_map(*[F.lit(v) for n, (letter, count) in NUMBERS.items() for v in (n, count * (8 if letter == "d" else 4))])
    wrong = F.length("bytes") != F.coalesce(F.try_element_at(sizes, F.col("type")), F.when(F.col("type").isin(*NAMED), 1))
    fits = ~F.coalesce(wrong, F.lit(False))
    return each.select(
        F.col("key").alias(key), "position", "name", "type", "bytes", F.when(fits, _numbers(F.col("type"), F.col("bytes"))).alias("numbers"), F.when(fits, text).alias("text"),
        F.coalesce("error", F.when(~fits, F.concat(F.lit("not the size of "), "type"))).alias("error"),
    )
