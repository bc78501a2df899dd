"""Directories of tagged values in binary columns: the walk along their offsets, and values by type.

A block begins with its byte order, a magic number and the place of its first directory. A directory is a count, entries
of 12 bytes (tag, type, count, value or its place) and the place of the next directory; some tags point to directories of
their own. All places count from the block's start. A block that is broken anywhere is one row with an error; no
place outside the block is read and no directory twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binary import as_float32, as_float64, as_signed, big, held, turned, unsigned
from .encoding import repaired_utf8

#: Types of values by number: name and bytes. Fixed values of the format.
TYPES = {1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1), 7: ("UNDEFINED", 1), 8: ("SSHORT", 2), 9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8)}
#: Tags that point to directories. Fixed values of the format.
POINTERS = {0x8769: "EXIF", 0x8825: "GPS", 0xA005: "Interoperability"}
#: Names of common tags. Fixed values of the format.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit",
    0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0213: "YCbCrPositioning", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x8769: "ExifIfdPointer", 0x8822: "ExposureProgram", 0x8825: "GpsInfoIfdPointer", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote",
    0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA005: "InteroperabilityIfdPointer", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA405: "FocalLengthIn35mmFilm", 0xA434: "LensModel",
}
ORIENTATION, COLOR_SPACE = 0x0112, 0xA001
#: Directories of a block; one with more of them is an error.
MOST_DIRECTORIES = 64
#: Characters of a shown value.
SHOWN = 255

_PLACE = "struct<path:string,at:bigint>"
_FOUND = "struct<path:string,at:bigint,count:bigint>"
_ENTRY = "struct<path:string,at:bigint,position:int,digits:string,error:string>"


def _size(kind: Column) -> Column:
    sizes = F.array(*[F.lit(TYPES[k][1] if k in TYPES else 1) for k in range(max(TYPES) + 1)])
    return F.coalesce(F.get(sizes, kind.cast("int")), F.lit(1))


def _numbered(n: Column, f) -> Column:
    """f(0) to f(n - 1) as an array; none for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), f))


class _Turned:
    """A block whose numbers all stand with their high bytes first: one of low bytes first is turned from last to first as a whole."""

    def __init__(self, data: Column, little: Column):
        self.data, self.little = data, little

    def start(self, place: Column, size: int) -> Column:
        """Where the bytes at a place begin, as substring() counts; from the end in a turned block."""
        return F.when(self.little, -(place + size)).otherwise(place + 1).cast("int")

    def number(self, place: Column, size: int) -> Column:
        """Of a place that is known to lie inside."""
        return big(F.substring(self.data, self.start(place, size), F.lit(size)))

    def entries(self, at: Column, count: Column, size: int, f) -> Column:
        """f of the first bytes of each entry of a directory; an empty array if it has none."""
        step = F.when(self.little, -12).otherwise(12)
        starts = held(self.start(at + 2, size), lambda first: F.sequence(first, first + (count.cast("int") - 1) * step, step))
        return F.when(count > 0, F.transform(starts, lambda start, k: f(F.substring(self.data, start, F.lit(size)), k)))


def _directories(block: _Turned, length: Column) -> Column:
    """struct<found: array<struct<path, at, count>>, error> of all directories, in the order in which they are met."""
    none = F.array().cast(f"array<{_PLACE}>")
    place = lambda path, at: F.struct(path.alias("path"), at.cast("bigint").alias("at"))
    fail = lambda text: F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text])
    pointers = [F.unhex(F.lit(f"{tag:04X}")) for tag in POINTERS]
    name = lambda tag: F.create_map(*[F.lit(v) for pair in POINTERS.items() for v in pair])[tag.cast("int")]

    def read(acc: Column, count: Column) -> Column:
        head, found = acc["queue"][0], acc["found"]
        end = head["at"] + 2 + count * 12
        error = (
            F.when(F.exists(found, lambda p: p["at"] == head["at"]), fail(["directory at ", head["at"], " twice"]))
            .when(count.isNull(), F.lit("too short for tag count"))
            .when(end + 4 > length, fail(["too short for ", count, " tags"]))
        )
        own = lambda k: head["at"] + 2 + k * 12
        pointing = F.filter(block.entries(head["at"], count, 2, lambda tag, k: F.when(tag.isin(*pointers), k)), lambda k: k.isNotNull())
        inner = F.coalesce(F.transform(pointing, lambda k: place(F.concat_ws("/", head["path"], name(block.number(own(k), 2))), block.number(own(k) + 8, 4))), none)
        chained = head["path"].rlike("^[0-9]+$")
        more = held(block.number(end, 4), lambda following: F.when((following > 0) & chained, F.array(place((head["path"].cast("int") + 1).cast("string"), following))).otherwise(none))
        rest = F.slice(acc["queue"], 2, MOST_DIRECTORIES * 8)
        seen = F.struct(head["path"].alias("path"), head["at"].alias("at"), count.alias("count"))
        going = F.struct(F.concat(rest, inner, more).alias("queue"), F.concat(found, F.array(seen)).alias("found"), F.lit(None).cast("string").alias("error"))
        failed = F.struct(none.alias("queue"), found.alias("found"), error.alias("error"))
        return F.when(error.isNotNull(), failed).otherwise(going)

    def step(acc: Column, _: Column) -> Column:
        at = acc["queue"][0]["at"]
        # After an error the queue is empty too.
        return F.when(F.size(acc["queue"]) == 0, acc).otherwise(held(F.when(at + 2 <= length, block.number(at, 2)), lambda count: read(acc, count)))

    start = place(F.lit("0"), block.number(F.lit(4).cast("bigint"), 4))
    first = F.struct(F.array(start).alias("queue"), F.array().cast(f"array<{_FOUND}>").alias("found"), F.lit(None).cast("string").alias("error"))
    last = lambda acc: F.struct(acc["found"].alias("found"), F.coalesce(acc["error"], F.when(F.size(acc["queue"]) > 0, F.lit(f"more than {MOST_DIRECTORIES} directories"))).alias("error"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIRECTORIES)), first, step, last)


def _field(digits: Column, little: Column, at: int, size: int) -> Column:
    """Digits of a number of an entry; in one of low bytes first the numbers follow each other from last to first."""
    return F.substring(digits, F.when(little, 25 - 2 * (at + size)).otherwise(2 * at + 1), F.lit(2 * size))


def _last_positions(block: _Turned, directory: Column, found: Column) -> Column:
    """Positions of a directory without those whose tag comes again at a later one, in it or in another one of its path."""
    none = F.array().cast("array<bigint>")
    keys = lambda d: F.coalesce(block.entries(d["at"], d["count"], 2, lambda tag, k: F.shiftleft(big(tag), 16).bitwiseOR(k.cast("bigint"))), none)
    tag = lambda key: F.shiftright(key, 16)
    last = lambda keys: held(F.sort_array(keys), lambda keys: F.filter(keys, lambda key, k: F.coalesce(tag(F.get(keys, k + 1)) != tag(key), F.lit(True))))
    shared = F.filter(found, lambda other: other["path"] == directory["path"])
    # Pointers that come twice give directories of one path; entries that are equal in tag and position all stay there.
    kept = F.array_intersect(keys(directory), last(F.array_distinct(F.flatten(F.transform(shared, keys)))))
    return F.transform(kept, lambda key: key.bitwiseAND(65535).cast("int"))


def _entries(block: _Turned, found: Column) -> Column:
    """array of the last entry of each tag: path and place of its directory, position and digits of its 12 bytes."""
    entry = lambda d, k, digits: F.struct(d["path"].alias("path"), d["at"].alias("at"), k.alias("position"), digits.alias("digits"), F.lit(None).cast("string").alias("error"))
    once = lambda values: F.size(F.array_distinct(values)) == F.size(values)
    whole = lambda d: F.coalesce(block.entries(d["at"], d["count"], 12, lambda data, _: F.hex(data)), F.array().cast("array<string>"))

    def listed(d: Column, digits: Column) -> Column:
        single = once(found["path"]) & once(F.transform(digits, lambda e: _field(e, block.little, 0, 2)))
        each = F.transform(digits, lambda e, k: entry(d, k, e))
        return F.when(single, each).otherwise(F.transform(_last_positions(block, d, found), lambda k: entry(d, k, digits[k])))

    return F.flatten(F.transform(found, lambda d: held(whole(d), lambda digits: listed(d, digits))))


def _values(at, hold) -> dict[int, Column]:
    """The value of each number type; at(offset, size) is the unsigned number there, hold() lets a function look at one often."""
    signed = lambda offset, size: hold(at(offset, size), lambda v: as_signed(v, size))
    divisor = lambda v: hold(v, lambda v: F.when(v != 0, v))
    return {
        1: at(0, 1), 3: at(0, 2), 4: at(0, 4), 5: at(0, 4) / divisor(at(4, 4)), 6: signed(0, 1), 8: signed(0, 2), 9: signed(0, 4),
        10: signed(0, 4) / divisor(signed(4, 4)), 11: hold(at(0, 4), as_float32),
    }


def _numbers(kind: Column, count: Column, data: Column, little: Column, first: Column, second: Column) -> Column:
    """array<double> of the values; null for text. first and second are the numbers of the bytes of a single value."""
    single = _values(lambda offset, _: second if offset else first, lambda v, f: f(v)) | {12: as_float64(first, second, little)}

    def each(number: int) -> Column:
        size = TYPES[number][1]

        def value(k: Column) -> Column:
            at = lambda offset, width: unsigned(data, k * size + offset, width, little)
            if number == 12:
                return held(F.struct(at(0, 4).alias("first"), at(4, 4).alias("second")), lambda w: as_float64(w["first"], w["second"], little))
            return _values(at, held)[number].cast("double")

        return _numbered(count, value)

    of = lambda f: reduce(lambda rest, number: F.when(kind == number, f(number)).otherwise(rest), single, F.lit(None).cast("array<double>"))
    # A single value, as most are, needs no lambda, so its code is generated.
    return F.when(count == 1, of(lambda number: F.array(single[number].cast("double")))).otherwise(of(each))


def directory_rows(blocks: DataFrame, key: str, data: str) -> DataFrame:
    """key, path, position, tag, type, count, bytes, numbers, text and error: a row per entry of each block.

    path is the number of a directory in the chain (0, 1, ...), with the names of pointers after it. Of entries that
    repeat a tag in a directory the last counts. numbers hold the values of number types, a quotient by 0 as null; text that
    of ASCII values, up to its NUL. A block that is null, has no byte order or breaks off is one row with an error and no
    tag, beside the entries of directories before the break; an entry whose value lies outside has an error and no bytes.
    """
    block = F.col(data)
    order = F.when(F.length(block) < 8, F.lit(None)).otherwise(F.hex(F.substring(block, 1, 2)))
    little = order == F.lit("4949")
    readable = order.isin("4949", "4D4D")
    rows = blocks.select(F.col(key).alias("key"), block.alias("block"), little.alias("little"), F.when(little, turned(block)).otherwise(block).alias("turned"), F.coalesce(readable, F.lit(False)).alias("readable"))
    high_first = _Turned(F.col("turned"), F.col("little"))
    rows = rows.select("*", F.when(F.col("readable"), _directories(high_first, F.length("block"))).alias("walk"))
    none = F.array().cast(f"array<{_ENTRY}>")
    error = F.coalesce(F.col("walk.error"), F.when(~F.col("readable"), F.lit("no byte order")))
    broken = F.when(error.isNotNull(), F.array(F.struct(*[F.lit(None).alias(c) for c in ("path", "at", "position", "digits")], error.alias("error")).cast(_ENTRY))).otherwise(none)
    each = rows.select("key", "block", "little", F.concat(F.coalesce(_entries(high_first, F.col("walk.found")), none), broken).alias("all"))
    # A plain explode would be filtered by the size of its array before it, which repeats the walk for each entry of each entry.
    each = each.select("key", "block", "little", F.explode_outer("all").alias("e")).where("e is not null").select("key", "block", "little", "e.*")
    # No lambdas from here on but for arrays of values: generated code reads each entry. A column that is looked at often is a step of its own.
    kind, size, place = F.col("type"), F.col("size"), F.col("place")
    field = lambda at, size: F.conv(_field(F.col("digits"), F.col("little"), at, size), 16, 10)
    each = each.select("*", field(0, 2).cast("int").alias("tag"), field(2, 2).cast("int").alias("type"), field(4, 4).cast("bigint").alias("count"), field(8, 4).cast("bigint").alias("value"))
    each = each.withColumn("size", F.col("count") * _size(kind))
    each = each.withColumn("place", F.when(size > 4, F.col("value")).otherwise(F.col("at") + F.col("position") * 12 + 10))
    outside = F.concat(F.lit("offset overflow "), place.cast("string"), F.lit("+"), size.cast("string"), F.lit(" vs. "), F.length("block").cast("string"))
    each = each.withColumn("error", F.coalesce("error", F.when(place + size > F.length("block"), outside)))
    each = each.withColumn("bytes", F.when(F.col("error").isNull(), F.substring(F.col("block"), (place + 1).cast("int"), size.cast("int"))))
    # The numbers of a single value, of a fraction or a double two of them.
    part = lambda k: F.substring(F.col("bytes"), 4 * k + 1, 4)
    word = lambda k: big(F.when(F.col("little"), turned(part(k))).otherwise(part(k)))
    single = lambda *sizes: (F.col("count") == 1) & size.isin(*sizes)
    each = each.withColumn("first", F.when(single(1, 2, 4, 8), word(0))).withColumn("second", F.when(single(8), word(1)))
    numbers = _numbers(kind, F.col("count"), F.col("bytes"), F.col("little"), F.col("first"), F.col("second"))
    text = F.when(kind == 2, repaired_utf8(F.encode(F.substring_index(F.decode("bytes", "ISO-8859-1"), "\0", 1), "ISO-8859-1")))
    return each.select(F.col("key").alias(key), "path", "position", "tag", "type", "count", "bytes", F.when(F.col("bytes").isNotNull(), numbers).alias("numbers"), text.alias("text"), "error")


def shown_value(numbers: Column, text: Column, data: Column) -> Column:
    """A value as text: numbers with up to six decimals, text, else bytes in hexadecimal; at most 255 characters and a mark if there are more."""
    plain = F.transform(numbers, lambda v: F.when(v.isNull(), "n/a").otherwise(F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")))
    full = F.coalesce(F.array_join(plain, ", "), text, F.hex(data))
    general = held(full, lambda t: F.when(t == "", "n/a").when(F.length(t) >= SHOWN, F.concat(F.substring(t, 1, SHOWN), F.lit("…"))).otherwise(t))
    one = numbers[0]
    # A single whole number needs no format; 0 may have a sign.
    whole = (F.size(numbers) == 1) & (F.abs(one) < 1e15) & (one != 0) & (F.floor(one) == one)
    return F.when(whole, one.cast("bigint").cast("string")).otherwise(general)


def attribute_rows(entries: DataFrame, key: str) -> DataFrame:
    """key, path, name, value and type of the tags that have a name, from directory_rows()."""
    names = F.create_map(*[F.lit(v) for pair in TAGS.items() for v in pair])
    types = F.create_map(*[F.lit(v) for number, (name, _) in TYPES.items() for v in (number, name)])
    rows = entries.where("error is null and tag is not null").withColumn("name", F.try_element_at(names, F.col("tag"))).where("name is not null")
    value = shown_value(F.col("numbers"), F.col("text"), F.col("bytes"))
    return rows.select(key, F.concat(F.lit("EXIF/"), "path").alias("path"), "name", value.alias("value"), F.coalesce(F.try_element_at(types, F.col("type")), F.lit("unknown")).alias("type"))


def picture_rows(entries: DataFrame, key: str) -> DataFrame:
    """key, orientation (1 to 8, else 0) and force_srgb, from directory_rows(): what the first directory says."""
    counts = (F.col("path") == "0") & F.col("tag").isin(ORIENTATION, COLOR_SPACE) & (F.col("type") == 3)
    # Looked at once, the numbers are read of these entries alone.
    said = entries.select(key, "tag", F.when(counts, F.col("numbers")[0]).alias("said"))
    first = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("said")))
    out = said.groupBy(key).agg(first(ORIENTATION).alias("o"), first(COLOR_SPACE).alias("c"))
    return out.select(key, F.when(F.col("o").between(1, 8), F.col("o").cast("int")).otherwise(0).alias("orientation"), F.coalesce(F.col("c") == 1, F.lit(False)).alias("force_srgb"))
