"""Batch conversion: scan images, flatten, tone-map and write them in another format."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import names as N
from ..sources import formats, images
from ..storage import materialise


def wide_pixels(pixels: DataFrame, key: list[str]) -> DataFrame:
    """key, x, y, r, g, b, a from long pixels: one channel fills three, a missing third is 0, missing alpha is 1."""
    value = lambda *tails: F.max(F.when(F.col("channel").isin(*tails), F.col("value")))
    rows = pixels.groupBy(*key, "x", "y").agg(value("R", "L").alias("r"), value("G").alias("g"), value("B").alias("b"), value("A").alias("a"), value("L").alias("l"))
    colour = lambda c: F.coalesce(F.col("l"), F.col(c), F.lit(0.0)).alias(c)
    return rows.select(*key, "x", "y", colour("r"), colour("g"), colour("b"), F.coalesce("a", F.lit(1.0)).alias("a"))


def convert(spark: SparkSession, source: str, target: str, template: str = "{file}", extension: str = "png", selector: str = "", tonemap: str = "none", gamma: float = 2.2, exposure: float = 0.0, offset: float = 0.0, background: tuple[float, float, float, float] = (0, 0, 0, 0)) -> DataFrame:
    """Writes the first part of each file and returns path and error of those that failed.

    Float formats get linear values, 8-bit ones tone-mapped values. Two files with one target keep the first by path; a file
    is not written over itself; one that cannot be decoded does not stop the others. Each file is decoded once.
    """
    if extension not in formats.ENCODERS:
        raise formats.UnsupportedFormat(f"no encoder for {extension}")
    files = images.scan_files(spark, source)
    name = N.fill_template(template + "." + extension, F.col("path"), F.lit(0))
    targets = files.select("path", name.alias("target")).groupBy("target").agg(F.min("path").alias("path"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "/+", "/")
    itself = plain(F.concat(F.lit(target + "/"), "target")) == plain(F.col("path"))
    targets = targets.withColumn("itself", itself)
    decoded = images.decode_images(files.join(targets.where("not itself").select("path"), "path", "left_semi"), selector, first_part=True)
    wide = wide_pixels(decoded, ["path", "error"])
    flat = [C.over_background(F.col(c), F.col("a"), background[k]) for k, c in enumerate("rgb")]
    alpha = F.col("a") + (1 - F.col("a")) * float(background[3])
    if not formats.ENCODERS[extension][1]:
        flat = [C.signed_power(c, 2.2) if tonemap in ("none", "gamma") else c for c in C.tonemap(tonemap, tuple(C.expose(c, exposure, offset) for c in flat), gamma)]
    ready = wide.select("path", "error", "x", "y", *[c.alias(n) for c, n in zip(flat, "rgb", strict=True)], alpha.alias("a"))
    encoded = materialise(images.encode_images(ready, extension).join(targets, "path"))
    images.write_images(encoded.where("error is null").select(F.col("target").alias("path"), "content"), target)
    own = targets.where("itself").select("path", F.lit("the target is the file itself").alias("error"))
    return encoded.where("error is not null").select("path", "error").unionAll(own)


def main() -> None:
    parser = argparse.ArgumentParser(description="Convert image files")
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--template", default="{file}")
    parser.add_argument("--extension", default="png")
    parser.add_argument("--selector", default="")
    parser.add_argument("--tonemap", default="none")
    parser.add_argument("--gamma", type=float, default=2.2)
    parser.add_argument("--exposure", type=float, default=0.0)
    parser.add_argument("--offset", type=float, default=0.0)
    parser.add_argument("--background", default="", help="#RGBA or numbers apart by commas")
    args = vars(parser.parse_args())
    args["background"] = N.parse_color(args["background"])
    spark = SparkSession.builder.getOrCreate()
    for row in convert(spark, args.pop("source"), args.pop("target"), **args).toLocalIterator():
        print(f"{row.path}: {row.error}")


if __name__ == "__main__":
    main()
