import struct
import zlib

import numpy as np
import pytest

from chromaframe.sources import formats as f


def grid(n, seed=0, h=5, w=7):
    return np.random.default_rng(seed).random((h, w, n))


@pytest.mark.parametrize(("extension", "n"), [("png", 1), ("png", 3), ("png", 4), ("qoi", 3), ("qoi", 4), ("bmp", 3), ("tga", 3), ("tga", 4)])
def test_eight_bit_round_trip(extension, n):
    pixels = grid(n)
    pixels[2] = 0.5  # a run
    (part, names, back), = f.decode(f.ENCODERS[extension][0](pixels), f"x.{extension}")
    assert part == "" and names == f.channel_names(n)
    assert np.abs(f.to_bytes(back).astype(int) - f.to_bytes(pixels)).max() == 0


@pytest.mark.parametrize(("extension", "n"), [("exr", 1), ("exr", 4), ("pfm", 1), ("pfm", 3)])
def test_float_round_trip(extension, n):
    pixels = grid(n) * 20 - 5
    (_, names, back), = f.decode(f.ENCODERS[extension][0](pixels))
    order = [names.index(c) for c in f.channel_names(n)]
    assert np.allclose(back[:, :, order], pixels, atol=1e-5)


def test_hdr_is_close():
    pixels = grid(3, w=12) * 100
    (_, _, back), = f.decode(f.encode_hdr(pixels))
    assert (np.abs(back - pixels) <= pixels.max(axis=2, keepdims=True) / 128).all()


def test_pnm_variants():
    (_, _, ascii_), = f.decode(b"P3\n# note\n2 1\n255\n255 0 0 0 255 0\n")
    assert ascii_.tolist() == [[[1, 0, 0], [0, 1, 0]]]
    (_, _, bits), = f.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))
    assert bits[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    (_, _, plain), = f.decode(b"P1\n3 2\n1 0 1\n0 1 0\n")
    assert plain[:, :, 0].tolist() == bits[:, :, 0].tolist()
    two = b"P5\n1 1\n255\n\xff" * 2
    assert [p for p, _, _ in f.decode(two)] == ["frames.0", "frames.1"]
    (_, names, pam), = f.decode(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + bytes([255, 0, 0, 51]))
    assert names == ["R", "G", "B", "A"] and pam[0, 0].tolist() == [1, 0, 0, 0.2]
    (_, _, big), = f.decode(b"Pf\n1 2\n2.0\n" + struct.pack(">2f", 1, 3))
    assert big[:, 0, 0].tolist() == [6, 2]


def png(colour, depth, lines, extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    w, h = 3, len(lines)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png_filters_and_palette():
    rows = [bytes([0, 10, 20, 30]), bytes([1, 5, 5, 5]), bytes([2, 1, 1, 1]), bytes([3, 4, 4, 4]), bytes([4, 2, 2, 2])]
    (_, _, got), = f.decode(png(0, 8, rows))
    want, before = [], [0, 0, 0]
    for kind, *line in rows:
        out = []
        for x, v in enumerate(line):
            a, b, c = (out[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            p = {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: min((a, b, c), key=lambda q: abs(a + b - c - q))}[kind]
            out.append((v + p) & 255)
        want.append(out)
        before = out
    assert f.to_bytes(got)[:, :, 0].tolist() == want
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    (_, names, shown), = f.decode(png(3, 2, [bytes([0, 0b00011000])], chunk(b"PLTE", bytes([0, 0, 0, 255, 0, 0, 0, 255, 0])) + chunk(b"tRNS", bytes([0, 128]))))
    assert names[-1] == "A"
    assert shown[0].tolist() == [[0, 0, 0, 0], [1, 0, 0, 128 / 255], [0, 1, 0, 1]]


def fits(cards, data):
    head = b"".join(c.ljust(80).encode() for c in [*cards, "END"]).ljust(2880)
    return head + data + b"\0" * (-len(data) % 2880)


def test_fits():
    values = np.arange(6, dtype=">i2")
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "BSCALE  =                  2.0"]
    (_, names, up), = f.decode(fits(cards, values.tobytes()))
    assert names == ["L"] and up[:, :, 0].tolist() == [[6, 8, 10], [0, 2, 4]]
    (_, _, down), = f.decode(fits([*cards, "ROWORDER= 'BOTTOM-UP'"], values.tobytes()))
    assert down[:, :, 0].tolist() == [[0, 2, 4], [6, 8, 10]]


def test_errors_are_typed():
    for data in (b"", b"\xff\xd8\xff", b"II*\0aaaa", b"qoif", b"\x89PNG\r\n\x1a\nxx", b"P5\n9 9\n255\nx", b"empty 0 0 1 1L"):
        with pytest.raises(f.UnsupportedFormat):
            f.decode(data)
    (_, names, zeros), = f.decode(b"empty 2 3 2 1L5depth")
    assert names == ["L", "depth"] and zeros.shape == (3, 2, 2) and not zeros.any()
