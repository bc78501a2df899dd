import struct

import numpy as np
import pytest
from pyspark.sql import datasource as D

from chromaframe.sources import bands, formats

RNG = np.random.default_rng(4)
RGBA = RNG.random((5, 7, 4))


def fits(values, kind=">i2", bits=16, **cards):
    lines = {"SIMPLE": "T", "BITPIX": bits, "NAXIS": 3, "NAXIS1": values.shape[2], "NAXIS2": values.shape[1], "NAXIS3": values.shape[0], **cards}
    head = "".join(f"{k:8}= {v!s:>20}".ljust(80) for k, v in lines.items()) + "END".ljust(80)
    body = values.astype(kind).tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880).encode() + body + b"\0" * (-len(body) % 2880)


FILES = {
    "a.pfm": formats.encode_pfm(RGBA), "b.pfm": formats.encode_pfm(RGBA[:, :, :1]), "c.exr": formats.encode_exr(RGBA), "d.bmp": formats.encode_bmp(RGBA),
    "e.tga": formats.encode_tga(RGBA), "f.tga": formats.encode_tga(RGBA[:, :, :1]),
    "g.ppm": b"P6\n# a note\n3 2\n65535\n" + RNG.integers(0, 65536, (2, 3, 3)).astype(">u2").tobytes(),
    "h.pam": b"P7\nWIDTH 3\nHEIGHT 2\nDEPTH 2\nMAXVAL 255\nTUPLTYPE GRAYSCALE_ALPHA\nENDHDR\n" + bytes(RNG.integers(0, 256, 12).tolist()),
    "i.fits": fits(RNG.integers(-99, 99, (3, 4, 5)), BSCALE=0.5, BZERO=7), "j.fits": fits(RNG.random((2, 4, 5)), ">f4", -32, ROWORDER="'BOTTOM-UP'", CBLACK=0.1, CWHITE=0.9),
    "k.pgm": b"P5 2 2 255\n\1\2\3\4" + b"P5 1 1 255\n\xff",
    "l.pfm": b"Pf 2 1 2.0\n" + struct.pack(">2f", 1, 3),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    for name, data in FILES.items():
        (top / name).write_bytes(data)
    return top


@pytest.mark.parametrize("band_bytes", [40, 1 << 20])
def test_values_are_the_decoders(spark, folder, band_bytes):
    rows = bands.linear_values(bands.read_bands(spark, str(folder), bandBytes=band_bytes)).collect()
    got = {(r.path.rsplit("/", 1)[1], r.part, r.channel, r.x, r.y): r.value for r in rows}
    assert len(got) == len(rows)
    want = {(n, part, c, x, y): px[y, x, k] for n, data in FILES.items() for part, names, px in formats.decode(data, n) for k, c in enumerate(names) for y in range(px.shape[0]) for x in range(px.shape[1])}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-12 * max(1, abs(want[k])) for k in want)


def test_filters_are_pushed(spark, folder):
    every = bands.read_bands(spark, str(folder))
    some = every.where("channel in ('R', 'A') and y >= 1 and y < 3 and x = 2 and part = '' and sample + x > 0")
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "imagebands" in line or "BatchScan" in line]
    condition = [line for line in plan.splitlines() if " Filter (" in line]
    assert scan and [("sample" in line, "channel" in line, "part" in line) for line in condition] == [(True, False, False)], plan
    keep = lambda r: r.channel in ("R", "A") and 1 <= r.y < 3 and r.x == 2 and r.part == "" and r.sample + r.x > 0
    assert sorted(some.collect()) == sorted(r for r in every.collect() if keep(r))
    assert every.where("y > 100").count() == 0 and every.where("channel = 'none'").count() == 0 and every.where("y < 3 and y > 4").count() == 0


def reader(path, *filters, **options):
    own = bands.BandReader({"path": str(path), **options})
    return own, list(own.pushFilters(list(filters)))


def test_bands_and_planes_are_skipped(tmp_path, monkeypatch):
    """Of a file of 2 MB a tenth of the rows of one of three planes is read, and headers."""
    planes = RNG.integers(0, 9, (3, 500, 700))
    (tmp_path / "big.fits").write_bytes(fits(planes))
    read = []
    get = bands.File.get
    monkeypatch.setattr(bands.File, "get", lambda self, at, n: read.append((at, n)) or get(self, at, n))
    own, left = reader(tmp_path, D.EqualTo(("channel",), "G"), D.GreaterThanOrEqual(("y",), 100), D.LessThan(("y",), 150), D.GreaterThan(("sample",), 1.0), bandBytes=300_000)
    assert [type(f) for f in left] == [D.GreaterThan]
    parts = own.partitions()
    assert len(parts) == 8
    batches = [list(own.read(p)) for p in parts]
    got = [b for own in batches for b in own]
    assert sum(b.num_rows for b in got) == 50 * 700
    assert [bool(own) for own in batches] == [False, True, True] + [False] * 5  # rows 62 to 124 and 125 to 186
    samples = [n for _, n in read if n not in (16, 2880)]
    assert sum(samples) == 50 * 700 * 2
    values = {(x, y): v for b in got for x, y, v in zip(*[b.column(c).to_pylist() for c in ("x", "y", "sample")], strict=True)}
    assert all(values[x, y] == planes[1, 499 - y, x] for x in (0, 699) for y in (100, 149))


def test_files_share_tasks_in_natural_order(tmp_path):
    for k in (10, 2, 1):
        (tmp_path / f"f{k}.pfm").write_bytes(FILES["b.pfm"])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    own, _ = reader(tmp_path)
    assert [[p.rsplit("/", 1)[1] for p, _, _ in part.bands] for part in own.partitions()] == [["f1.pfm", "f2.pfm", "f10.pfm"]]
    own, _ = reader(tmp_path, D.EqualTo(("path",), f"{tmp_path}/f2.pfm"))
    assert [b[0] for part in own.partitions() for b in part.bands] == [f"{tmp_path}/f2.pfm"]
    (tmp_path / "none").mkdir()
    assert reader(tmp_path / "none")[0].partitions() == []


BROKEN = {"x.png": formats.encode_png(RGBA), "x.pfm": FILES["a.pfm"][:-1], "y.pfm": b"PF 3", "x.exr": FILES["c.exr"][:60], "x.bmp": b"BM", "x.tga": b"", "z.pgm": b"P5 0 4 255\n"}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files(spark, tmp_path, name):
    (tmp_path / name).write_bytes(BROKEN[name])
    (tmp_path / "good.pfm").write_bytes(FILES["b.pfm"])
    with pytest.raises(Exception, match=name):
        bands.read_bands(spark, str(tmp_path)).collect()
    kept = bands.read_bands(spark, str(tmp_path), onError="skip").select("path").distinct().collect()
    assert {r.path.rsplit("/", 1)[1] for r in kept} >= {"good.pfm"}
