import numpy as np

from chromaframe.plans.convert import convert
from chromaframe.sources import formats, images


def folder(tmp_path):
    pixels = np.random.default_rng(1).random((4, 6, 4)) * 0.8 + 0.1
    (tmp_path / "a.exr").write_bytes(formats.encode_exr(pixels))
    (tmp_path / "b.png").write_bytes(formats.encode_png(pixels))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    return pixels


def test_reading_prunes_channels_and_reports_errors(spark, tmp_path):
    pixels = folder(tmp_path)
    rows = images.decode_images(images.scan_files(spark, str(tmp_path)), "G").collect()
    assert {r.channel for r in rows if not r.error} == {"G"}
    assert [r.path.endswith("c.jpg") for r in rows if r.error] == [True]
    exr = {(r.x, r.y): r.value for r in rows if r.path.endswith("a.exr")}
    assert all(abs(exr[x, y] - pixels[y, x, 1]) < 1e-6 for x in range(6) for y in range(4))


def test_conversion(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    pixels = folder(source)
    failed = convert(spark, str(source), str(target), extension="qoi")
    assert [r.path.endswith("c.jpg") for r in failed.collect()] == [True]
    (_, _, back), = formats.decode((target / "a.qoi").read_bytes())
    want = np.concatenate([pixels[:, :, :3] / pixels[:, :, 3:], pixels[:, :, 3:]], axis=2)
    assert np.abs(formats.to_bytes(back).astype(int) - formats.to_bytes(want)).max() <= 1
    assert (target / "b.qoi").exists() and not (target / "c.qoi").exists()


def test_targets_are_written_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    folder(source)
    convert(spark, str(source), str(tmp_path / "out"), template="same", extension="exr")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["same.exr"]


def test_empty_image(spark):
    assert images.empty_image(spark, 3, 2, ["L", "A"]).count() == 12


def test_targets_keep_their_folders_and_sources_their_bytes(spark, tmp_path):
    for d in ("one", "two"):
        (tmp_path / "in" / d).mkdir(parents=True)
        folder(tmp_path / "in" / d)
    out = tmp_path / "out"
    failed = convert(spark, f"{tmp_path}/in/*", str(out), template="{dir}/{file}", extension="qoi")
    assert len(failed.collect()) == 2
    assert sorted(str(p.relative_to(out)).split("/in/")[1] for p in out.rglob("*.qoi")) == ["one/a.qoi", "one/b.qoi", "two/a.qoi", "two/b.qoi"]
    before = (tmp_path / "in" / "one" / "b.png").read_bytes()
    failed = convert(spark, f"{tmp_path}/in/one", f"{tmp_path}/in/one", extension="png", exposure=2.0)
    assert {r.path.rsplit("/", 1)[1]: "itself" in r.error for r in failed.collect()} == {"b.png": True, "c.jpg": False}
    assert (tmp_path / "in" / "one" / "b.png").read_bytes() == before and (tmp_path / "in" / "one" / "a.png").exists()


def test_errors_are_raised_kept_or_skipped(spark, tmp_path):
    import pytest

    folder(tmp_path)
    assert "error" in images.read_images(spark, str(tmp_path), on_error="keep").columns
    assert images.read_images(spark, str(tmp_path), "R", on_error="skip").count() == 48
    with pytest.raises(Exception, match="c.jpg"):
        images.read_images(spark, str(tmp_path)).collect()


def test_files_in_natural_order(spark, tmp_path):
    for name in ("f10", "F2", "f1", "b/f3", "f02"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = images.in_natural_order(images.scan_files(spark, str(tmp_path), recursive=True)).orderBy("ordinal").collect()
    assert [r.path.split(f"{tmp_path}/")[1] for r in rows] == ["b/f3", "f1", "F2", "f02", "f10"] and [r.ordinal for r in rows] == list(range(5))
