"""Colour matrices of cameras, row by row: 3 x 3 matrices are columns of nine numbers, by rows.

A chain of products and inverses over columns would be put in wherever an optimiser rule moves a filter through it, so it is worked
out for a batch of rows at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .color import BRADFORD, ILLUMINANTS, PRIMARIES, adapt_white_matrix, rgb_to_xyz_matrix


def rec709_from_d50() -> np.ndarray:
    return np.linalg.inv(rgb_to_xyz_matrix(PRIMARIES["rec709"])) @ adapt_white_matrix(ILLUMINANTS["D50"], ILLUMINANTS["D65"])


def _stack(cells: pd.Series, default: list[float]) -> np.ndarray:
    """Arrays one above the other, a missing element as NaN and a missing array as the default."""
    return np.array([default if c is None else c for c in cells], dtype=float).reshape(-1, len(default))


def _white_xyz(xy: np.ndarray) -> np.ndarray:
    x, y = xy[:, 0], xy[:, 1]
    return np.stack([x / y, np.ones_like(x), (1 - x - y) / y], axis=1)


def to_rec709(matrix: pd.Series, calibration: pd.Series, balance: pd.Series, neutral: pd.Series, white: pd.Series) -> pd.Series:
    """The matrices from camera to Rec. 709 of rows; null where one has no inverse or a white point is none."""
    unit = np.eye(3).ravel().tolist()
    m, c = (_stack(s, unit).reshape(-1, 3, 3) for s in (matrix, calibration))
    with np.errstate(all="ignore"):
        to_camera = _stack(balance, [1.0] * 3)[:, :, None] * (c @ m)
        good = np.isfinite(to_camera).all(axis=(1, 2))
        good[good] = np.linalg.det(to_camera[good]) != 0
        to_xyz = np.linalg.inv(np.where(good[:, None, None], to_camera, np.eye(3)))
        seen = np.einsum("nij,nj->ni", to_xyz, _stack(neutral, [1.0] * 3))
        given, found = white.notna().to_numpy(), neutral.notna().to_numpy()
        xy = np.where(found[:, None], seen[:, :2] / seen.sum(axis=1, keepdims=True), _stack(white, list(ILLUMINANTS["D50"])))
        cone = np.array(BRADFORD)
        ratio = (_white_xyz(np.array([ILLUMINANTS["D50"]])) @ cone.T) / (_white_xyz(xy) @ cone.T)
        ratio[~found & ~given] = 1.0
        # Without a matrix nothing is adapted.
        none = matrix.isna().to_numpy()
        adapted = np.linalg.inv(cone) @ (ratio[:, :, None] * cone) @ to_xyz
        adapted[none], good[none] = np.eye(3), True
        out = (rec709_from_d50() @ adapted).reshape(-1, 9)
    good &= np.isfinite(out).all(axis=1)
    return pd.Series([row.tolist() if ok else None for row, ok in zip(out, good, strict=True)], dtype=object)


def camera_matrices(cameras: DataFrame, key: str) -> DataFrame:
    """key, source and to_rec709 from rows of key, analog_balance, color_matrix1 to 3, calibration1 to 3, as_shot_neutral, as_shot_white.

    Of the matrices from XYZ to the camera the third is taken if there is one, else the second, else the first; source is its number. Its own
    calibration and the analog balance, each the identity where missing, follow it. The inverse is adapted from the white that
    the camera saw as neutral, else from the white point that is given, else as it is, to D50, and from there to Rec. 709. Arrays of
    another length than 3, 9 or 2 count as missing. Without any matrix source is null and to_rec709 that of D50. A matrix without an
    inverse, a null in an array and a white point that is none give null.
    """
    sized = lambda c, n: F.when(F.size(c) == n, F.col(c).cast("array<double>"))
    matrix, calibration, source = (F.lit(None).cast(t) for t in ("array<double>", "array<double>", "int"))
    for n in (1, 2, 3):
        there = F.coalesce(F.size(f"color_matrix{n}") == 9, F.lit(False))
        matrix, calibration, source = F.when(there, sized(f"color_matrix{n}", 9)).otherwise(matrix), F.when(there, sized(f"calibration{n}", 9)).otherwise(calibration), F.when(there, n).otherwise(source)

    def run(matrix: pd.Series, calibration: pd.Series, balance: pd.Series, neutral: pd.Series, white: pd.Series) -> pd.Series:
        return to_rec709(matrix, calibration, balance, neutral, white)

    solved = F.pandas_udf(run, "array<double>")(matrix, calibration, sized("analog_balance", 3), sized("as_shot_neutral", 3), sized("as_shot_white", 2))
    return cameras.select(F.col(key), source.alias("source"), solved.alias("to_rec709"))
