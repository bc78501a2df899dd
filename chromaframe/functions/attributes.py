"""Metadata trees as rows: path, name, value and type of each leaf, with its depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of the light metadata: path, name, columns and type. Fixed values.
HDR_LEAVES = (
    ("Content light level", "Best guess white level", ("white_level",), "cd/m²"),
    ("Content light level", "Max content light level", ("max_cll",), "cd/m²"),
    ("Content light level", "Max frame average light level", ("max_fall",), "cd/m²"),
    ("Mastering display color volume", "Min luminance", ("min_luminance",), "cd/m²"),
    ("Mastering display color volume", "Max luminance", ("max_luminance",), "cd/m²"),
    ("Mastering display color volume", "Red primary", ("red_x", "red_y"), "xy"),
    ("Mastering display color volume", "Green primary", ("green_x", "green_y"), "xy"),
    ("Mastering display color volume", "Blue primary", ("blue_x", "blue_y"), "xy"),
    ("Mastering display color volume", "White point", ("white_x", "white_y"), "xy"),
)


def number_or_na(v: Column) -> Column:
    """Six decimals; what is not positive or missing is not available."""
    return F.when(v > 0, F.format_string("%.6f", v)).otherwise("n/a")


def hdr_attributes(images: DataFrame, key: str) -> DataFrame:
    """key, ord, path, depth, name, value, type: a row per leaf. Columns that images lacks are not available."""
    leaves = []
    for k, (section, name, columns, kind) in enumerate(HDR_LEAVES):
        parts = [number_or_na(F.col(c).cast("double") if c in images.columns else F.lit(None).cast("double")) for c in columns]
        value = parts[0] if len(parts) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))
        leaves.append(F.struct(F.lit(k).alias("ord"), F.lit(f"HDR metadata/{section}").alias("path"), F.lit(2).alias("depth"), F.lit(name).alias("name"), value.alias("value"), F.lit(kind).alias("type")))
    return images.select(key, F.explode(F.array(*leaves)).alias("a")).select(key, "a.*")


def printed(depth: Column, name: Column, value: Column) -> Column:
    """A line of the tree, indented by two blanks a level."""
    return F.concat(F.repeat(F.lit("  "), depth), name, F.when(value.isNull() | (value == ""), F.lit("")).otherwise(F.concat(F.lit(": "), value)))


def colour_metadata(icc: dict[str, Column], cicp: dict[str, Column], white_by_transfer: Column) -> dict[str, Column]:
    """chroma, transfer and white_level: what the code points say comes before the profile; unspecified primaries do not count."""
    return {
        "chroma": F.coalesce(F.when(cicp["primaries"] != "unspecified", cicp["primaries"]), icc["chroma"]),
        "transfer": cicp["transfer"],
        "white_level": F.when(cicp["transfer"].isNotNull(), white_by_transfer),
    }
