"""Uncompressed image files as a registered source, read by bands of rows.

    spark.read.format("imagebands").load(folder).where("channel = 'R' and y < 100")

The driver lists files and cuts them into bands by their sizes; a task reads a file's header, and of its band only the rows
and planes that pushed filters leave. What comes out are the stored samples with how to make values of them, so
scaling and transfer are expressions (`linear_values`). Formats whose rows lie at fixed places can be
read: PNM, PAM and PFM (binary, also several in a file), BMP, TGA, FITS, EXR by scan lines without compression.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..functions.color import srgb_to_linear
from .formats import UnsupportedFormat, channel_names

SCHEMA = "path string, part string, channel string, x int, y int, sample double, scale double, shift double, srgb boolean"
#: Bytes of a band, and of files that share a task, unless the option bandBytes says otherwise.
BAND_BYTES = 64 << 20
#: Bytes that are read at once, and bytes of a header that are read before it is known how long it is.
READ_BYTES, HEAD_BYTES = 8 << 20, 1 << 16
#: Bytes that opening a file counts for, so that many small files are dealt over more tasks.
OPEN_BYTES = 1 << 18
BATCH_ROWS = 1 << 16


@dataclass(frozen=True)
class Plane:
    """Samples of one channel: the sample (x, y) lies at byte at + y * row + x * pixel."""

    channel: str
    at: int
    row: int
    pixel: int
    kind: str
    scale: float = 1.0
    shift: float = 0.0
    srgb: bool = False


@dataclass(frozen=True)
class Frame:
    part: str
    width: int
    height: int
    planes: tuple[Plane, ...]

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0 or not self.planes:
            raise UnsupportedFormat("an image without pixels")


class File:
    """Bytes of a file by place."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.size = source, source.size()

    def get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)


def _interleaved(names: list[str], at: int, row: int, kind: str, top: float | None, order: list[int] | None = None, step: int | None = None) -> tuple[Plane, ...]:
    """Planes of samples that lie pixel by pixel. Integers, which have a top value, are sRGB but for alpha."""
    size = np.dtype(kind).itemsize
    scale = 1.0 if top is None else 1 / top
    places = order or list(range(len(names)))
    return tuple(Plane(c, at + places[k] * size, row, (step or len(names)) * size, kind, scale, 0.0, top is not None and c != "A") for k, c in enumerate(names))


def _fields(head: bytes, n: int) -> tuple[list[bytes], int]:
    """The first n words of a PNM header, which comments may part, and where samples begin."""
    found = re.match(rb"\s*" + rb"(?:\s|#[^\n]*\n)*".join([rb"([^\s#]+)"] * n) + rb"\s", head)
    if found is None:
        raise UnsupportedFormat("the header ends early")
    return list(found.groups()), found.end()


def _pnm(file: File) -> list[Frame]:
    frames, at = [], 0
    while at < file.size:
        head = file.get(at, HEAD_BYTES)
        if not head.strip():
            break
        magic = head.split(None, 1)[0]
        top: float | None
        if magic == b"P7":
            end = head.find(b"ENDHDR")
            fields = {k: v.strip() for k, _, v in (line.strip().partition(b" ") for line in head[: max(end, 0)].splitlines())}
            w, h, n, top = (int(fields.get(k, 0)) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
            start = head.find(b"\n", end) + 1
        elif magic in (b"P5", b"P6", b"Pf", b"PF", b"PF4"):
            words, start = _fields(head, 4)
            w, h, top = int(words[1]), int(words[2]), float(words[3])
            n = {b"P6": 3, b"PF": 3, b"PF4": 4}.get(magic, 1)
        else:
            raise UnsupportedFormat(f"PNM {magic!r} has no rows at fixed places")
        floats = magic[1:2] in (b"f", b"F")
        kind = ("<f4" if top < 0 else ">f4") if floats else "u1" if top < 256 else ">u2"
        row = w * n * np.dtype(kind).itemsize
        if floats:
            # The bottom row comes first.
            planes = tuple(replace(p, scale=abs(top)) for p in _interleaved(channel_names(n), at + start + (h - 1) * row, -row, kind, None))
        else:
            planes = _interleaved(channel_names(n), at + start, row, kind, top)
        frames.append(Frame(f"frames.{len(frames)}", w, h, planes))
        at += start + row * h
    return [replace(frames[0], part="")] if len(frames) == 1 else frames


def _bmp(file: File) -> list[Frame]:
    head = file.get(0, 54)
    (start,), (header, w, h, _, bits, packing) = struct.unpack_from("<I", head, 10), struct.unpack_from("<IiiHHI", head, 14)
    if header < 40 or packing not in (0, 3) or bits not in (24, 32):
        raise UnsupportedFormat(f"BMP with {bits} bits and compression {packing}")
    row, rows = -(-w * bits // 32) * 4, abs(h)
    names, order = (["R", "G", "B", "A"], [2, 1, 0, 3]) if bits == 32 and packing == 3 else (["R", "G", "B"], [2, 1, 0])
    first, step = (start, row) if h < 0 else (start + (rows - 1) * row, -row)
    return [Frame("", w, rows, _interleaved(names, first, step, "u1", 255, order, bits // 8))]


def _tga(file: File) -> list[Frame]:
    head = file.get(0, 18)
    skip, _, kind, w, h, bits, flags = *struct.unpack_from("<BBB", head, 0), *struct.unpack_from("<HHBB", head, 12)
    if kind not in (2, 3) or bits not in (8, 24, 32):
        raise UnsupportedFormat(f"TGA of type {kind} with {bits} bits")
    n, row = bits // 8, w * bits // 8
    first, step = (18 + skip, row) if flags & 0x20 else (18 + skip + (h - 1) * row, -row)
    return [Frame("", w, h, _interleaved(channel_names(n), first, step, "u1", 255, [2, 1, 0, 3][:n] if n > 1 else None))]


def _fits(file: File) -> list[Frame]:
    frames, at = [], 0
    while at < file.size:
        fields: dict[str, str] = {}
        done = False
        while not done and at < file.size:
            block = file.get(at, 2880).decode("latin-1")
            for card in (block[k : k + 80] for k in range(0, 2880, 80)):
                if card[:8].strip() == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    quoted = re.match(r"\s*'((?:[^']|'')*)'", card[10:])
                    fields[card[:8].strip()] = quoted[1].replace("''", "'").rstrip() if quoted else card[10:].split("/")[0].strip()
            at += 2880
        axes = [int(fields[f"NAXIS{k + 1}"]) for k in range(int(fields.get("NAXIS", 0)))]
        bits, n = int(fields.get("BITPIX", 8)), math.prod(axes) if axes else 0
        if len(axes) in (2, 3) and fields.get("XTENSION", "IMAGE") == "IMAGE" and n:
            w, h, count = axes[0], axes[1], axes[2] if len(axes) == 3 else 1
            scale, shift = float(fields.get("BSCALE", 1)), float(fields.get("BZERO", 0))
            if "CBLACK" in fields and "CWHITE" in fields:
                black, span = float(fields["CBLACK"]), float(fields["CWHITE"]) - float(fields["CBLACK"])
                scale, shift = scale / span, (shift - black) / span
            kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bits]
            size = abs(bits) // 8
            names = ["L"] if count == 1 else ["R", "G", "B"] if count == 3 else [str(k) for k in range(count)]
            down = fields.get("ROWORDER") == "BOTTOM-UP"
            planes = [Plane(c, at + k * w * h * size + (0 if down else (h - 1) * w * size), w * size * (1 if down else -1), size, kind, scale, shift) for k, c in enumerate(names)]
            frames.append(Frame(f"hdu.{fields.get('EXTNAME', len(frames))}", w, h, tuple(planes)))
        at += -(-n * abs(bits) // 8 // 2880) * 2880
    if not frames:
        raise UnsupportedFormat("FITS without an image")
    return [replace(frames[0], part="")] if len(frames) == 1 else frames


def _exr(file: File) -> list[Frame]:
    head = file.get(0, HEAD_BYTES)
    if struct.unpack_from("<I", head, 4)[0] & 0x1A00:
        raise UnsupportedFormat("tiled, deep or multi-part EXR")
    at, fields = 8, {}
    while head[at : at + 1] != b"\0":
        name, kind, rest = head[at:].split(b"\0", 2)
        (size,) = struct.unpack_from("<I", rest)
        at += len(name) + len(kind) + 6 + size
        fields[name.decode()] = rest[4 : 4 + size]
    if fields["compression"][0] or fields["lineOrder"][0]:
        raise UnsupportedFormat("EXR with compression or another order of lines")
    x0, y0, x1, y1 = struct.unpack("<4i", fields["dataWindow"])
    w, h, rest, listed = x1 - x0 + 1, y1 - y0 + 1, fields["channels"], []
    while rest[:1] != b"\0":
        name, rest = rest.split(b"\0", 1)
        kind, _, sx, sy = struct.unpack_from("<iiii", rest)
        if (sx, sy) != (1, 1):
            raise UnsupportedFormat("EXR with sub-sampled channels")
        listed.append((name.decode(), ("<u4", "<f2", "<f4")[kind]))
        rest = rest[16:]
    line = sum(np.dtype(kind).itemsize for _, kind in listed) * w
    (first,) = struct.unpack("<Q", file.get(at + 1, 8))
    planes, own = [], first + 8  # each line has its number and size before it
    for name, kind in listed:
        planes.append(Plane(name, own, line + 8, np.dtype(kind).itemsize, kind))
        own += np.dtype(kind).itemsize * w
    return [Frame("", w, h, tuple(planes))]


_LAYOUTS = [((b"\x76\x2f\x31\x01",), _exr), ((b"P",), _pnm), ((b"SIMPLE  =",), _fits), ((b"BM",), _bmp)]


def layout(file: File, path: str) -> list[Frame]:
    start = file.get(0, 16)
    found = next((f for starts, f in _LAYOUTS if start.startswith(starts)), _tga if path.lower().endswith(".tga") else None)
    if found is None:
        raise UnsupportedFormat("no format with rows at fixed places")
    try:
        return found(file)
    except (struct.error, KeyError, IndexError, ValueError) as e:
        raise e if isinstance(e, UnsupportedFormat) else UnsupportedFormat(f"broken header: {type(e).__name__} {e}") from e


@dataclass(frozen=True)
class Wanted:
    """What pushed filters leave: names, or None for all, and ranges with both ends."""

    names: tuple[tuple[str, frozenset[str]], ...] = ()
    x: tuple[int, int] = (0, 2**31 - 1)
    y: tuple[int, int] = (0, 2**31 - 1)

    def takes(self, column: str, value: str) -> bool:
        return all(value in names for c, names in self.names if c == column)

    def narrowed(self, f: D.Filter) -> Wanted | None:
        """With one more filter, or None if it is not of a kind that is taken over wholly."""
        if len(getattr(f, "attribute", ())) != 1:
            return None
        column = f.attribute[0]
        if isinstance(f, D.IsNotNull):
            return self if column in ("path", "part", "channel", "x", "y") else None
        if column in ("path", "part", "channel") and isinstance(f, D.EqualTo | D.In):
            values = f.value if isinstance(f, D.In) else [f.value]
            return replace(self, names=(*self.names, (column, frozenset(v for v in values if v is not None))))
        if column not in ("x", "y") or not isinstance(getattr(f, "value", None), int):
            return None
        low, high = getattr(self, column)
        bounds = {
            D.EqualTo: (f.value, f.value), D.GreaterThan: (f.value + 1, high), D.GreaterThanOrEqual: (f.value, high),
            D.LessThan: (low, f.value - 1), D.LessThanOrEqual: (low, f.value),
        }.get(type(f))
        return bounds and replace(self, **{column: (max(low, bounds[0]), min(high, bounds[1]))})


@dataclass
class Bands(D.InputPartition):
    """Bands (path, number, count): the rows of each frame from height * number / count to height * (number + 1) / count."""

    bands: tuple[tuple[str, int, int], ...]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def natural_key(name: str) -> list:
    """Runs of digits compare as numbers, all else by lower case; then the name itself."""
    return [[(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"[0-9]+|[^0-9]+", name)], name]


def _rows(frame: Frame, number: int, count: int, wanted: Wanted) -> tuple[int, int]:
    return max(frame.height * number // count, wanted.y[0]), min(frame.height * (number + 1) // count, wanted.y[1] + 1)


def read_frame(file: File, frame: Frame, rows: tuple[int, int], wanted: Wanted) -> Iterator[tuple[Plane, int, np.ndarray]]:
    """Samples by plane and run of rows: the plane, the first row and an array of wanted rows and columns."""
    left, right = wanted.x[0], min(frame.width, wanted.x[1] + 1)
    planes = sorted((p for p in frame.planes if wanted.takes("channel", p.channel)), key=lambda p: p.at)
    if left >= right or rows[0] >= rows[1]:
        return
    while planes:
        # Planes whose samples lie in the same rows are read together.
        group = [p for p in planes if p.row == planes[0].row and p.at - planes[0].at < abs(p.row)]
        planes = planes[len(group) :]
        step = max(1, READ_BYTES // abs(group[0].row))
        for top in range(rows[0], rows[1], step):
            end = min(top + step, rows[1])
            ends = [p.at + y * p.row + x * p.pixel for p in group for y in (top, end - 1) for x in (left, right - 1)]
            low, high = min(ends), max(ends) + max(np.dtype(p.kind).itemsize for p in group)
            data = file.get(low, high - low)
            if len(data) < high - low:
                raise UnsupportedFormat("the samples end early")
            for p in group:
                yield p, top, np.ndarray((end - top, right - left), p.kind, data, p.at + top * p.row + left * p.pixel - low, (p.row, p.pixel))


class BandReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pattern = options.get("pathGlobFilter", "*")
        self.recursive = options.get("recursiveFileLookup", "false").lower() == "true"
        self.band_bytes = int(options.get("bandBytes", BAND_BYTES))
        self.skips = options.get("onError", "raise") == "skip"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def partitions(self) -> list[Bands]:
        system, top = _store(self.path)
        found = system.get_file_info(top)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=self.recursive))
        files = [i for i in infos if i.type == fs.FileType.File and fnmatch(i.base_name, self.pattern) and not i.base_name.startswith(("_", ".")) and self.wanted.takes("path", i.path)]
        out, own, held = [], [], 0
        for info in sorted(files, key=lambda i: natural_key(i.path)):
            count = max(1, -(-info.size // self.band_bytes))
            for number in range(count):
                cost = info.size // count + OPEN_BYTES
                if own and held + cost > max(self.band_bytes, OPEN_BYTES):
                    out.append(Bands(tuple(own)))
                    own, held = [], 0
                own.append((info.path, number, count))
                held += cost
        return [*out, Bands(tuple(own))] if own else out

    def read(self, partition: Bands) -> Iterator[pa.RecordBatch]:
        system, _ = _store(self.path)
        for path, number, count in partition.bands:
            with system.open_input_file(path) as source:
                file = File(source)
                try:
                    for frame in layout(file, path):
                        if self.wanted.takes("part", frame.part):
                            for plane, top, samples in read_frame(file, frame, _rows(frame, number, count, self.wanted), self.wanted):
                                yield from self._batches(path, frame, plane, top, samples)
                except UnsupportedFormat as e:
                    if not self.skips:
                        raise UnsupportedFormat(f"{path}: {e}") from e

    def _batches(self, path: str, frame: Frame, plane: Plane, top: int, samples: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, width = samples.astype(np.float64).ravel(), samples.shape[1]
        for at in range(0, len(values), BATCH_ROWS):
            own = values[at : at + BATCH_ROWS]
            place = np.arange(at, at + len(own))
            same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(own))  # noqa: B023, E731
            columns = [same(v, pa.string()) for v in (path, frame.part, plane.channel)]
            columns += [pa.array((place % width + self.wanted.x[0]).astype(np.int32)), pa.array((place // width + top).astype(np.int32)), pa.array(own)]
            columns += [same(plane.scale, pa.float64()), same(plane.shift, pa.float64()), same(plane.srgb, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


class ImageBands(D.DataSource):
    """Source of samples by path, part, channel, x and y.

    Options: pathGlobFilter and recursiveFileLookup as in binaryFile, bandBytes, onError ("raise" ends the query at a file
    that cannot be read, "skip" leaves it out).
    """

    @classmethod
    def name(cls) -> str:
        return "imagebands"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BandReader:
        return BandReader(self.options)


def read_bands(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Stored samples of all files under a path; filters on path, part, channel, x and y are pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageBands)
    return spark.read.format("imagebands").options(**{k: str(v) for k, v in options.items()}).load(path)


def linear_value(sample: Column, scale: Column, shift: Column, srgb: Column) -> Column:
    value = sample * scale + shift
    return F.when(srgb, srgb_to_linear(value)).otherwise(value)


def linear_values(samples: DataFrame) -> DataFrame:
    """path, part, channel, x, y, value."""
    return samples.select("path", "part", "channel", "x", "y", linear_value(*[F.col(c) for c in ("sample", "scale", "shift", "srgb")]).alias("value"))
