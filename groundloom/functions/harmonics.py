"""View-dependent colour: real spherical harmonics of bands 1-3 (constants are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values and formulas: real spherical harmonics in the published form of the 3D Gaussian splatting paper (Kerbl et al., 2023)
C0 = 0.28209479177387814
C1 = 0.4886025119029199
C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def basis(x: Column, y: Column, z: Column, degree: int = 3) -> list[Column]:
    xx, yy, zz = x * x, y * y, z * z
    bands = [
        [-C1 * y, C1 * z, -C1 * x],
        [C2[0] * x * y, C2[1] * y * z, C2[2] * (2 * zz - xx - yy), C2[3] * x * z, C2[4] * (xx - yy)],
        [C3[0] * y * (3 * xx - yy), C3[1] * x * y * z, C3[2] * y * (4 * zz - xx - yy), C3[3] * z * (2 * zz - 3 * xx - 3 * yy),
         C3[4] * x * (4 * zz - xx - yy), C3[5] * z * (xx - yy), C3[6] * x * (xx - 3 * yy)],
    ]
    return [b for band in bands[:degree] for b in band]


def colour(df: DataFrame, direction: tuple[str, str, str], dc: list[str], rest: str, degree: int = 3) -> DataFrame:
    """Adds red, green, blue seen along the unit ``direction``; coefficients are channel-major."""
    n = (degree + 1) ** 2 - 1
    df = df.withColumn("_basis", F.array(*basis(*[F.col(c) for c in direction], degree)))
    for k, (name, c) in enumerate(zip(("red", "green", "blue"), dc)):
        part = F.slice(F.col(rest), k * n + 1, n)
        total = F.aggregate(F.zip_with(part, F.col("_basis"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        df = df.withColumn(name, F.greatest(F.col(c) * C0 + total + 0.5, F.lit(0.0)))
    return df.drop("_basis")


def rotate(coefficients: Column, matrix: list[list[float]], degree: int = 3) -> Column:
    """Coefficient rows (channel-major) through the block-diagonal matrix of a scene's rotation."""
    n = (degree + 1) ** 2 - 1
    columns = [F.array(*[F.lit(float(matrix[r][c])) for r in range(n)]) for c in range(n)]
    parts = []
    for ch in range(3):
        part = F.slice(coefficients, ch * n + 1, n)
        parts += [F.aggregate(F.zip_with(part, col, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for col in columns]
    return F.array(*parts)


def rotation_matrix(R, degree: int = 3) -> list[list[float]]:
    """The (15 x 15) matrix for one rotation: each band's basis at turned directions is a linear map of
    the basis at the directions, found by least squares on a fixed spiral of directions."""
    import numpy as np

    k = np.arange(200) + 0.5
    polar, turn = np.arccos(1 - k / 100), np.pi * (1 + 5**0.5) * k
    d = np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], 1)
    at = lambda v: np.stack(basis(v[:, 0], v[:, 1], v[:, 2], degree), 1)
    plain, turned = at(d), at(d @ np.asarray(R, float))
    n = (degree + 1) ** 2 - 1
    out, first = np.zeros((n, n)), 0
    for band in range(1, degree + 1):
        s = slice(first, first + 2 * band + 1)
        out[s, s] = np.linalg.lstsq(plain[:, s], turned[:, s], rcond=None)[0].T
        first = s.stop
    return out.tolist()
