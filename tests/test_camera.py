import numpy as np

from chromaframe.functions import camera
from chromaframe.functions.color import ILLUMINANTS, adapt_white_matrix

FIELDS = "id int, analog_balance array<double>, color_matrix1 array<float>, color_matrix2 array<double>, color_matrix3 array<double>, calibration1 array<double>, calibration2 array<double>, calibration3 array<double>, as_shot_neutral array<double>, as_shot_white array<double>"


def plain(balance, m1, m2, m3, c1, c2, c3, neutral, white):
    source = next((n for n, m in ((3, m3), (2, m2), (1, m1)) if m is not None and len(m) == 9), None)
    if source is None:
        return None, camera.rec709_from_d50()
    m, c = ((m1, c1), (m2, c2), (m3, c3))[source - 1]
    square = lambda v: np.eye(3) if v is None else np.array(v, float).reshape(3, 3)
    to_xyz = np.linalg.inv(np.diag(balance or [1, 1, 1]) @ square(c) @ square(np.float32(m) if source == 1 else m))
    adapt = np.eye(3)
    if neutral is not None:
        xyz = to_xyz @ neutral
        adapt = adapt_white_matrix(tuple(xyz[:2] / xyz.sum()), ILLUMINANTS["D50"])
    elif white is not None:
        adapt = adapt_white_matrix(white, ILLUMINANTS["D50"])
    return source, camera.rec709_from_d50() @ adapt @ to_xyz


def test_matrices(spark):
    rng = np.random.default_rng(2)
    matrix = lambda: (np.eye(3) + rng.normal(0, 0.2, (3, 3))).ravel().tolist()
    maybe = lambda v: v if rng.random() < 0.6 else None
    rows = [(k, maybe([1.1, 1.0, 0.9]), maybe(matrix()), maybe(matrix()), maybe(matrix()), maybe(matrix()), maybe(matrix()), maybe(matrix()), maybe([0.6, 1.0, 0.7]), maybe([0.31, 0.33])) for k in range(60)]
    got = {r.id: (r.source, r.to_rec709) for r in camera.camera_matrices(spark.createDataFrame(rows, FIELDS), "id").collect()}
    for k, *row in rows:
        source, want = plain(*row)
        assert got[k][0] == source and np.allclose(np.array(got[k][1]).reshape(3, 3), want, rtol=1e-9, atol=1e-9)


def test_odd_rows(spark):
    none = [None] * 9
    flat = [*none]
    flat[1] = [0.0] * 9
    short = [*none]
    short[1], short[0] = [1.0, 0.0], [1.0]
    dark = [*none]
    dark[2], dark[7] = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0]
    rows = [(k, *r) for k, r in enumerate((none, flat, short, dark))]
    got = {r.id: (r.source, r.to_rec709) for r in camera.camera_matrices(spark.createDataFrame(rows, FIELDS), "id").collect()}
    assert np.allclose(got[0][1], camera.rec709_from_d50().ravel()) and got[2] == got[0] and got[0][0] is None
    assert got[1] == (1, None) and got[3] == (2, None)
    assert camera.camera_matrices(spark.createDataFrame([], FIELDS), "id").collect() == []
