"""Decoding and encoding of single image files with the standard library and numpy.

A decoded part is (part name, channel names, array of shape (height, width, channels) in double). Values are
linear: integer formats that carry sRGB are decoded, float formats are taken as they are.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

Part = tuple[str, list[str], np.ndarray]


class UnsupportedFormat(ValueError):
    """The bytes are of no format, or of a variant, that can be decoded here."""


def channel_names(n: int) -> list[str]:
    """L, LA, RGB, RGBA, and numbers from the fourth colour on."""
    return {1: ["L"], 2: ["L", "A"], 3: ["R", "G", "B"], 4: ["R", "G", "B", "A"]}.get(n, ["R", "G", "B", *map(str, range(3, n))])


def _linear(values: np.ndarray) -> np.ndarray:
    return np.where(values <= 0.04045, values / 12.92, ((values + 0.055) / 1.055) ** 2.4)


def _encoded(values: np.ndarray) -> np.ndarray:
    v = np.maximum(values, 0)
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)


def _colours(samples: np.ndarray, top: int) -> np.ndarray:
    """Integer samples as linear colours; a second or fourth channel is alpha and stays."""
    out = samples.astype(np.float64) / top
    colours = out.shape[2] - (out.shape[2] in (2, 4))
    out[:, :, :colours] = _linear(out[:, :, :colours])
    return out


# PNM and PFM: P1 to P7, Pf, PF, PF4. Several may follow each other in a file.


def _words(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    out: list[bytes] = []
    while len(out) < n:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) % (len(data) + 1)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise UnsupportedFormat("the header ends early")
        out.append(data[at:end])
        at = end
    return out, at + 1


def decode_pnm(data: bytes) -> list[Part]:
    parts, at = [], 0
    while data[at:].strip():
        at += len(data[at:]) - len(data[at:].lstrip())
        (magic,), at = _words(data, at, 1)
        if magic == b"P7":
            fields, end = {}, data.index(b"ENDHDR", at)
            for line in data[at:end].splitlines():
                key, _, value = line.strip().partition(b" ")
                fields[key] = value
            at = data.index(b"\n", end) + 1
            w, h, n, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        else:
            n = {b"P3": 3, b"P6": 3, b"PF": 3, b"PF4": 4}.get(magic, 1)
            with_top = magic not in (b"P1", b"P4")
            fields, at = _words(data, at, 2 + with_top)
            w, h = int(fields[0]), int(fields[1])
            top = 1 if not with_top else float(fields[2]) if magic in (b"Pf", b"PF", b"PF4") else int(fields[2])
        if magic in (b"Pf", b"PF", b"PF4"):
            raw = np.frombuffer(data, "<f4" if top < 0 else ">f4", w * h * n, at).reshape(h, w, n)
            at += raw.nbytes
            pixels = raw[::-1].astype(np.float64) * abs(top)
        elif magic in (b"P1", b"P2", b"P3"):
            if magic == b"P1":
                bits = bytes(c for c in data[at - 1 :] if c in b"01")[: w * h]
                pixels, at = (1.0 - np.frombuffer(bits, np.uint8).reshape(h, w, 1) + 48.0), len(data)
            else:
                fields, at = _words(data, at - 1, w * h * n)
                pixels = _colours(np.array(fields, np.int64).reshape(h, w, n), top)
        elif magic == b"P4":
            row = -(-w // 8)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
            at += row * h
            pixels = 1.0 - bits[:, :, None]
        elif magic in (b"P5", b"P6", b"P7"):
            raw = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * n, at).reshape(h, w, n)
            at += raw.nbytes
            pixels = _colours(raw, top)
        else:
            raise UnsupportedFormat(f"no PNM: {magic!r}")
        parts.append((f"frames.{len(parts)}", channel_names(n), pixels))
    return [("", *parts[0][1:])] if len(parts) == 1 else parts


def encode_pfm(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    magic = {1: "Pf", 3: "PF", 4: "PF4"}[n]
    return f"{magic}\n{w} {h}\n-1.0\n".encode() + pixels[::-1].astype("<f4").tobytes()


# QOI.


def decode_qoi(data: bytes) -> list[Part]:
    w, h, n, space = struct.unpack_from(">IIBB", data, 4)
    seen, pixel, out, at = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), [], 14
    while len(out) < w * h:
        b = data[at]
        at += 1
        r, g, bl, a = pixel
        if b >= 0xFE:
            pixel = (*data[at : at + 3], a) if b == 0xFE else tuple(data[at : at + 4])
            at += 3 + (b == 0xFF)
        elif b >> 6 == 3:
            out += [pixel] * ((b & 63) + 1)
            continue
        elif b >> 6 == 0:
            pixel = seen[b]
        elif b >> 6 == 1:
            pixel = ((r + (b >> 4 & 3) - 2) & 255, (g + (b >> 2 & 3) - 2) & 255, (bl + (b & 3) - 2) & 255, a)
        else:
            dg, c = (b & 63) - 32, data[at]
            at += 1
            pixel = ((r + dg - 8 + (c >> 4)) & 255, (g + dg) & 255, (bl + dg - 8 + (c & 15)) & 255, a)
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out.append(pixel)
    samples = np.array(out[: w * h], np.uint8).reshape(h, w, 4)[:, :, :n]
    return [("", channel_names(n), samples / 255.0 if space else _colours(samples, 255))]


def encode_qoi(pixels: np.ndarray) -> bytes:
    """Runs and whole pixels only."""
    samples = to_bytes(pixels)
    h, w, n = samples.shape
    out, last, run = bytearray(b"qoif" + struct.pack(">IIBB", w, h, n, 0)), (0, 0, 0, 255), 0
    for p in samples.reshape(-1, n).tolist():
        pixel = (*p, 255) if n == 3 else tuple(p)
        if pixel == last and run < 62:
            run += 1
            continue
        if run:
            out.append(0xC0 | (run - 1))
            run = 0
        if pixel == last:
            run = 1
            continue
        out += bytes([0xFE, *pixel[:3]]) if pixel[3] == last[3] else bytes([0xFF, *pixel])
        last = pixel
    if run:
        out.append(0xC0 | (run - 1))
    return bytes(out) + b"\0" * 7 + b"\1"


# PNG.

_PNG = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> list[Part]:
    at, body, palette, alphas, linear, gamma = 8, b"", None, b"", False, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alphas = chunk
        elif kind == b"cICP":
            linear = chunk[1] == 8
        elif kind == b"gAMA":
            gamma = struct.unpack(">I", chunk)[0] / 1e5
    if interlace:
        raise UnsupportedFormat("interlaced PNG")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = -(-w * n * depth // 8), max(1, n * depth // 8)
    raw, rows, before = zlib.decompress(body), [], np.zeros(stride, np.int64)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind:
            for x in range(stride):
                a, b, c = (line[x - step] if x >= step else 0), before[x], (before[x - step] if x >= step else 0)
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    p = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (line[x] + p) & 255
        rows.append(line)
        before = line
    lines = np.array(rows, np.uint8)
    if depth == 16:
        samples = lines.reshape(h, w, n, 2).astype(np.int64) @ np.array([256, 1])
    elif depth == 8:
        samples = lines.reshape(h, w, n).astype(np.int64)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, :w]
        samples = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :, None].astype(np.int64)
    if colour == 3:
        shown = np.zeros((len(palette), 4 if alphas else 3), np.int64)
        shown[:, :3] = palette
        if alphas:
            shown[:, 3] = 255
            shown[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)
        samples, depth = shown[np.minimum(samples[:, :, 0], len(palette) - 1)], 8
    elif alphas:
        key = np.array(struct.unpack(f">{n}H", alphas))
        opaque = (samples != key).any(axis=2, keepdims=True) * (2**depth - 1)
        samples = np.concatenate([samples, opaque], axis=2)
    top = 2**depth - 1
    if linear:
        pixels = samples / top
    elif gamma and abs(gamma - 1 / 2.2) > 0.01:
        pixels = samples / top
        colours = pixels.shape[2] - (pixels.shape[2] in (2, 4))
        pixels[:, :, :colours] **= 1 / gamma
    else:
        pixels = _colours(samples, top)
    return [("", channel_names(pixels.shape[2]), pixels)]


def encode_png(pixels: np.ndarray) -> bytes:
    samples = to_bytes(pixels)
    h, w, n = samples.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in samples)
    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


# BMP, uncompressed.


def decode_bmp(data: bytes) -> list[Part]:
    (start,) = struct.unpack_from("<I", data, 10)
    header, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if header < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise UnsupportedFormat(f"BMP with {bits} bits and compression {packing}")
    rows = abs(h)
    stride = -(-w * bits // 32) * 4
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits <= 8:
        count = struct.unpack_from("<I", data, 46)[0] or 2**bits
        palette = np.frombuffer(data, np.uint8, count * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)[:, :w] @ (1 << np.arange(bits - 1, -1, -1))
        samples = palette[np.minimum(index, count - 1)]
    else:
        samples = lines[:, : w * bits // 8].reshape(rows, w, bits // 8)
        samples = samples[:, :, [2, 1, 0, 3] if bits == 32 and packing == 3 else [2, 1, 0]]
    return [("", channel_names(samples.shape[2]), _colours(samples if h < 0 else samples[::-1], 255))]


def encode_bmp(pixels: np.ndarray) -> bytes:
    samples = to_bytes(pixels)
    samples = np.repeat(samples, 3, axis=2) if samples.shape[2] < 3 else samples[:, :, :3]
    h, w, _ = samples.shape
    lines = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    lines[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def encode_tga(pixels: np.ndarray) -> bytes:
    samples = to_bytes(pixels)
    h, w, n = samples.shape
    order = [0] if n == 1 else [2, 1, 0, 3][:n]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * n, 0x20 | (8 if n == 4 else 0)) + np.ascontiguousarray(samples[:, :, order]).tobytes()


def decode_tga(data: bytes) -> list[Part]:
    skip, _, kind, w, h, bits, flags = *struct.unpack_from("<BBB", data, 0), *struct.unpack_from("<HHBB", data, 12)
    if kind not in (2, 3) or bits not in (8, 24, 32):
        raise UnsupportedFormat(f"TGA of type {kind} with {bits} bits")
    n = bits // 8
    samples = np.frombuffer(data, np.uint8, w * h * n, 18 + skip).reshape(h, w, n)
    samples = samples[:, :, [2, 1, 0, 3][:n]] if n > 1 else samples
    return [("", channel_names(n), _colours(samples if flags & 0x20 else samples[::-1], 255))]


# Radiance HDR.


def decode_hdr(data: bytes) -> list[Part]:
    head, _, rest = data.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    fields = size.split()
    if len(fields) != 4 or fields[0] != b"-Y" or fields[2] != b"+X":
        raise UnsupportedFormat("HDR in an unusual direction")
    h, w = int(fields[1]), int(fields[3])
    lines, at = np.zeros((h, w, 4), np.uint8), 0
    for y in range(h):
        if body[at : at + 2] == b"\2\2" and 8 <= w < 1 << 15:
            at += 4
            for c in range(4):
                x = 0
                while x < w:
                    n = body[at]
                    if n > 128:
                        lines[y, x : x + n - 128, c] = body[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        lines[y, x : x + n, c] = np.frombuffer(body, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
        else:
            lines[y] = np.frombuffer(body, np.uint8, w * 4, at).reshape(w, 4)
            at += w * 4
    scale = np.where(lines[:, :, 3:] > 0, np.ldexp(1.0, lines[:, :, 3:].astype(int) - 136), 0.0)
    return [("", ["R", "G", "B"], lines[:, :, :3] * scale)]


def encode_hdr(pixels: np.ndarray) -> bytes:
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]
    rgb = np.maximum(rgb, 0)
    fraction, exponent = np.frexp(rgb.max(axis=2))
    scale = np.where(rgb.max(axis=2) > 1e-32, fraction * 256.0 / np.maximum(rgb.max(axis=2), 1e-300), 0.0)
    out = np.zeros((*rgb.shape[:2], 4), np.uint8)
    out[:, :, :3] = rgb * scale[:, :, None]
    out[:, :, 3] = np.where(scale > 0, exponent + 128, 0)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {rgb.shape[0]} +X {rgb.shape[1]}\n".encode() + out.tobytes()


# FITS.


def decode_fits(data: bytes) -> list[Part]:
    parts, at = [], 0
    while at < len(data):
        fields: dict[str, str] = {}
        done = False
        while not done and at < len(data):
            for k in range(0, 2880, 80):
                card = data[at + k : at + k + 80].decode("latin-1")
                if card[:8].strip() == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    value = card[10:].strip()
                    fields[card[:8].strip()] = value[1:].split("'")[0].rstrip() if value.startswith("'") else value.split("/")[0].strip()
            at += 2880
        axes = [int(fields[f"NAXIS{k + 1}"]) for k in range(int(fields.get("NAXIS", 0)))]
        bits = int(fields.get("BITPIX", 8))
        n = int(np.prod(axes)) if axes else 0
        kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bits]
        if len(axes) in (2, 3) and fields.get("XTENSION", "IMAGE") == "IMAGE" and n:
            planes = np.frombuffer(data, kind, n, at).reshape(axes[2] if len(axes) == 3 else 1, axes[1], axes[0])
            values = planes.astype(np.float64) * float(fields.get("BSCALE", 1)) + float(fields.get("BZERO", 0))
            if "CBLACK" in fields and "CWHITE" in fields:
                values = (values - float(fields["CBLACK"])) / (float(fields["CWHITE"]) - float(fields["CBLACK"]))
            # By its usual convention the first row is the bottom one; the keyword's names are turned around.
            values = values if fields.get("ROWORDER") == "BOTTOM-UP" else values[:, ::-1]
            count = len(values)
            names = ["L"] if count == 1 else ["R", "G", "B"] if count == 3 else [str(k) for k in range(count)]
            parts.append((f"hdu.{fields.get('EXTNAME', len(parts))}", names, values.transpose(1, 2, 0)))
        at += -(-n * abs(bits) // 8 // 2880) * 2880
    if not parts:
        raise UnsupportedFormat("FITS without an image")
    return [("", *parts[0][1:])] if len(parts) == 1 else parts


# EXR: scan lines without compression or with ZIP.


def decode_exr(data: bytes) -> list[Part]:
    version = struct.unpack_from("<I", data, 4)[0]
    if version & 0x1A00:
        raise UnsupportedFormat("tiled, deep or multi-part EXR")
    at, fields = 8, {}
    while data[at]:
        end = data.index(b"\0", at)
        kind_end = data.index(b"\0", end + 1)
        (size,) = struct.unpack_from("<I", data, kind_end + 1)
        fields[data[at:end].decode()] = data[kind_end + 5 : kind_end + 5 + size]
        at = kind_end + 5 + size
    at += 1
    packing = fields["compression"][0]
    if packing not in (0, 2, 3):
        raise UnsupportedFormat(f"EXR with compression {packing}")
    x0, y0, x1, y1 = struct.unpack("<4i", fields["dataWindow"])
    w, h, channels, k = x1 - x0 + 1, y1 - y0 + 1, [], 0
    while fields["channels"][k]:
        end = fields["channels"].index(b"\0", k)
        kind, _, sx, sy = struct.unpack_from("<iiii", fields["channels"], end + 1)
        if (sx, sy) != (1, 1):
            raise UnsupportedFormat("EXR with sub-sampled channels")
        channels.append((fields["channels"][k:end].decode(), ("<u4", "<f2", "<f4")[kind]))
        k = end + 17
    lines = 16 if packing == 3 else 1
    pixels = np.zeros((h, w, len(channels)))
    for (block,) in struct.iter_unpack("<Q", data[at : at + 8 * -(-h // lines)]):
        y, size = struct.unpack_from("<iI", data, block)
        raw, rows = data[block + 8 : block + 8 + size], min(lines, y1 + 1 - y)
        whole = rows * sum(np.dtype(t).itemsize for _, t in channels) * w
        if packing and size < whole:
            d = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.int64)
            d = ((np.cumsum(d) - 128 * np.arange(len(d))) & 255).astype(np.uint8)
            half = (len(d) + 1) // 2
            mixed = np.empty_like(d)
            mixed[0::2], mixed[1::2] = d[:half], d[half:]
            raw = mixed.tobytes()
        o = 0
        for r in range(rows):
            for c, (_, t) in enumerate(channels):
                line = np.frombuffer(raw, t, w, o)
                pixels[y - y0 + r, :, c] = line
                o += line.nbytes
    return [("", [n for n, _ in channels], pixels)]


def encode_exr(pixels: np.ndarray) -> bytes:
    """Float scan lines without compression."""
    h, w, n = pixels.shape
    order = sorted(range(n), key=lambda k: channel_names(n)[k])
    entry = lambda name, kind, body: name + b"\0" + kind + b"\0" + struct.pack("<I", len(body)) + body
    listed = b"".join(channel_names(n)[k].encode() + b"\0" + struct.pack("<iiii", 2, 0, 1, 1) for k in order) + b"\0"
    window = struct.pack("<4i", 0, 0, w - 1, h - 1)
    head = struct.pack("<II", 20000630, 2) + entry(b"channels", b"chlist", listed) + entry(b"compression", b"compression", b"\0") + entry(b"dataWindow", b"box2i", window) + entry(b"displayWindow", b"box2i", window)
    head += entry(b"lineOrder", b"lineOrder", b"\0") + entry(b"pixelAspectRatio", b"float", struct.pack("<f", 1)) + entry(b"screenWindowCenter", b"v2f", struct.pack("<ff", 0, 0)) + entry(b"screenWindowWidth", b"float", struct.pack("<f", 1)) + b"\0"
    size = w * n * 4
    table = b"".join(struct.pack("<Q", len(head) + 8 * h + y * (size + 8)) for y in range(h))
    lines = b"".join(struct.pack("<iI", y, size) + pixels[y, :, order].astype("<f4").tobytes() for y in range(h))
    return head + table + lines


def decode_empty(data: bytes) -> list[Part]:
    """empty width height count, then length and name of each channel: zeros."""
    fields, at = _words(data, 0, 4)
    w, h, n = (int(f) for f in fields[1:])
    names = []
    for _ in range(n):
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        size = int(data[at:end])
        names.append(data[end : end + size].decode())
        at = end + size
    if w * h <= 0 or not n:
        raise UnsupportedFormat("an image without pixels")
    return [("", names, np.zeros((h, w, n)))]


def to_bytes(pixels: np.ndarray) -> np.ndarray:
    """8-bit sRGB; a second or fourth channel is alpha and stays linear."""
    out = pixels.astype(np.float64).copy()
    colours = out.shape[2] - (out.shape[2] in (2, 4))
    out[:, :, :colours] = _encoded(out[:, :, :colours])
    return np.clip(out * 255 + 0.5, 0, 255).astype(np.uint8)


#: First bytes of each format and its decoder, in the order in which they are tried.
DECODERS = [
    ("exr", (b"\x76\x2f\x31\x01",), decode_exr),
    ("pnm", (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"P7", b"Pf", b"PF"), decode_pnm),
    ("empty", (b"empty",), decode_empty),
    ("fits", (b"SIMPLE  =",), decode_fits),
    ("qoi", (b"qoif",), decode_qoi),
    ("png", (_PNG,), decode_png),
    ("bmp", (b"BM",), decode_bmp),
    ("hdr", (b"#?RADIANCE", b"#?RGBE"), decode_hdr),
]
#: First bytes of formats that are known but cannot be decoded without their codecs.
UNDECODED = [("jpeg", b"\xff\xd8"), ("tiff", b"II*\0"), ("tiff", b"MM\0*"), ("jxl", b"\xff\x0a"), ("webp", b"RIFF"), ("gif", b"GIF8"), ("jpeg2000", b"\0\0\0\x0cjP"), ("dds", b"DDS ")]
#: Extension to encoder, whether it takes linear floats, and whether its alpha is straight.
ENCODERS = {"exr": (encode_exr, True, False), "pfm": (encode_pfm, True, False), "hdr": (encode_hdr, True, False), "png": (encode_png, False, True), "qoi": (encode_qoi, False, True), "bmp": (encode_bmp, False, True), "tga": (encode_tga, False, True)}


def sniff(data: bytes, path: str = "") -> str | None:
    for name, starts, _ in DECODERS:
        if data.startswith(starts):
            return name
    if path.lower().endswith(".tga"):
        return "tga"
    return None


def decode(data: bytes, path: str = "") -> list[Part]:
    kind = sniff(data, path)
    if kind is None:
        known = next((n for n, start in UNDECODED if data.startswith(start)), None)
        raise UnsupportedFormat(f"{known} cannot be decoded here" if known else "unknown format")
    decoder = decode_tga if kind == "tga" else next(d for n, _, d in DECODERS if n == kind)
    try:
        return decoder(data)
    except UnsupportedFormat:
        raise
    except Exception as e:
        raise UnsupportedFormat(f"broken {kind}: {type(e).__name__} {e}") from e
