"""Pixel geometry on columns of RGBA bytes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def _map(pixels: pd.Series, *columns: pd.Series, f) -> pd.Series:
    return pd.Series([None if p is None else np.ascontiguousarray(f(np.frombuffer(p, np.uint8), *v)).tobytes() for p, *v in zip(pixels, *columns)])


@F.pandas_udf(BinaryType())
def crop(rgba: pd.Series, w: pd.Series, h: pd.Series, x: pd.Series, y: pd.Series, cw: pd.Series, ch: pd.Series) -> pd.Series:
    """The cw x ch pixels at (x, y) of a w x h image."""
    return _map(rgba, w, h, x, y, cw, ch, f=lambda p, w, h, x, y, cw, ch: p.reshape(h, w, 4)[y : y + ch, x : x + cw])


@F.pandas_udf(BinaryType())
def unrotate(rgba: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """A w x h image turned by 90 degrees against the clock: h x w."""
    return _map(rgba, w, h, f=lambda p, w, h: np.rot90(p.reshape(h, w, 4), 1))


@F.pandas_udf(BinaryType())
def place(rgba: pd.Series, w: pd.Series, h: pd.Series, x: pd.Series, y: pd.Series, cw: pd.Series, ch: pd.Series) -> pd.Series:
    """A w x h image at (x, y) of a transparent cw x ch canvas, which it must lie in."""

    def put(p: np.ndarray, w: int, h: int, x: int, y: int, cw: int, ch: int) -> np.ndarray:
        out = np.zeros((ch, cw, 4), np.uint8)
        out[y : y + h, x : x + w] = p.reshape(h, w, 4)
        return out

    return _map(rgba, w, h, x, y, cw, ch, f=put)


@F.pandas_udf(BinaryType())
def swap_red_blue(rgba: pd.Series) -> pd.Series:
    return _map(rgba, f=lambda p: p.reshape(-1, 4)[:, [2, 1, 0, 3]])
