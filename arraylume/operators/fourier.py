"""Fourier transforms of packed complex arrays by an Arrow kernel.

The forward transform isn't scaled, the inverse is by 1/N; lengths (each side in
two dimensions) are powers of two.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from arraylume.operators.packed import map_rows


def _check(n: int) -> None:
    if n <= 0 or n & (n - 1):
        raise ValueError(f"length {n} is no power of two")


def _transform(values: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    out = (np.fft.ifftn if inverse else np.fft.fftn)(values)
    return out.real, out.imag


def _line(inverse: bool):
    def run(re, im):
        if len(re) != len(im):
            raise ValueError("arrays differ in length")
        _check(len(re))
        return _transform(re.astype(float) + 1j * im.astype(float), inverse)

    return run


def _plane(width: int, height: int, inverse: bool):
    _check(width)
    _check(height)

    def run(re, im):
        if len(re) != width * height or len(im) != len(re):
            raise ValueError("arrays differ from width * height")
        return _transform((re.astype(float) + 1j * im.astype(float)).reshape(height, width), inverse)

    return run


def fft(df: DataFrame, keep: list[str], re: str = "re", im: str = "im", inverse: bool = False) -> DataFrame:
    """Columns ``keep`` with the transform as arrays ``re`` and ``im``."""
    return map_rows(df, _line(inverse), [re, im], keep, "re array<double>, im array<double>")


def fft2d(df: DataFrame, keep: list[str], width: int, height: int, re: str = "re", im: str = "im", inverse: bool = False) -> DataFrame:
    return map_rows(df, _plane(width, height, inverse), [re, im], keep, "re array<double>, im array<double>")
