"""Scanned pages: keep what is dark, whiten the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DARK = 80
ROUNDS = 3


def isolate_text(pixels: bytes, width: int, height: int, channels: int) -> bytes:
    """RGB of a page of raw RGB or RGBA: pixels darker than ``DARK`` and their neighbours three
    steps around keep their colour, all others become white."""
    if channels not in (3, 4) or len(pixels) != width * height * channels:
        raise ValueError("the size doesn't fit the pixels")
    rgb = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)[:, :, :3].astype(np.int32)
    dark = (rgb @ np.array([299, 587, 114]) // 1000) < DARK
    for _ in range(ROUNDS):
        framed = np.pad(dark, 1)
        dark = np.any([framed[i : i + height, j : j + width] for i in range(3) for j in range(3)], axis=0)
    return np.where(dark[:, :, None], rgb, 255).astype(np.uint8).tobytes()


def preprocess_page(pixels: Column | str, width: Column | str, height: Column | str, channels: Column | str) -> Column:
    """:func:`isolate_text` on a column of raw pages; null where the sizes don't fit."""

    @F.pandas_udf("binary")
    def run(p: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.Series:
        def one(a, b, d, e):
            try:
                return isolate_text(a, b, d, e)
            except (ValueError, TypeError):
                return None

        return pd.Series([one(*x) for x in zip(p, w, h, c)], dtype=object)

    return run(pixels, width, height, channels)
