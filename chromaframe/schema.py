"""Table schemas and the enumerations that appear in them.

An image is a table of pixels: rows are places (x, y), columns are named channels. Arithmetic is in double.
"""

from __future__ import annotations

from pyspark.sql import types as T

BOX = "struct<min_x:int,min_y:int,max_x:int,max_y:int>"

IMAGES = (
    "image_id long, path string, name string, selector string, part string, mtime timestamp, width int, height int, "
    f"data_window {BOX}, display_window {BOX}, chroma array<struct<x:double,y:double>>, transfer string, gamma double, intent string, "
    "white_level double, max_cll double, max_fall double"
)
CHANNELS = "image_id long, ordinal int, name string, layer string, tail string, is_alpha boolean, fmt string, desired_fmt string"
CHANNEL_GROUPS = "image_id long, ordinal int, group_name string, channels array<string>"
PIXELS_LONG = "image_id long, channel string, x int, y int, value double"
PIXELS_WIDE = "image_id long, layer string, x int, y int, r double, g double, b double, a double"
ATTRIBUTES = "image_id long, tab string, path array<string>, depth int, ord int, name string, value string, type string"
VG_COMMANDS = "image_id long, ord int, op int, args array<float>, text string"
TILES = "seq long, image_name string, channel string, x int, y int, w int, h int, data array<float>"
#: What every image reader returns: pixels of one part of one file.
READER = "path string, part string, channel string, x int, y int, value double"

METRICS = ("e", "ae", "se", "rae", "rse")
#: "none" is another name of gamma.
TONEMAPS = ("none", "gamma", "falsecolor", "posneg")
#: EXIF orientations 1 to 8; 0 counts as 1.
ORIENTATIONS = tuple(range(9))
ALPHA_KINDS = ("straight", "premultiplied", "premultiplied_nonlinear", "none")
INTENTS = ("perceptual", "relative", "saturation", "absolute")

#: Spark types that hold the pixel formats; Spark has no unsigned and no half types.
FORMAT_TYPES: dict[str, T.DataType] = {
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(),
    "f16": T.FloatType(), "f32": T.FloatType(),
}
FORMAT_MAX = {"u8": 2**8 - 1, "u16": 2**16 - 1, "u32": 2**32 - 1, "i8": 2**7 - 1, "i16": 2**15 - 1, "i32": 2**31 - 1}


def choice(value: str, options: tuple[str, ...], default: str) -> str:
    """The option of that name, whatever its case; the default for an unknown one."""
    return next((o for o in options if o.lower() == value.strip().lower()), default)
