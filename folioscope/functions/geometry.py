"""Image sizes: scaling to a grid of blocks within bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# The largest and the smallest image as width and height, and the grid.
LARGEST, SMALLEST, GRID = (3072, 2048), (1792, 28), 28


def fit_blocks(width: np.ndarray, height: np.ndarray, most: int, least: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of blocks: the scale that brings the area within bounds, rounded half to even;
    while the area is still above ``most`` the side goes whose loss changes the ratio less (rows on ties)."""
    w, h = width.astype(float), height.astype(float)
    area = w * h
    scale = np.where(area > most, np.sqrt(most / area), np.where(area < least, np.sqrt(least / area), 1.0))
    columns = np.maximum(1, np.rint(w * scale / grid)).astype(np.int64)
    rows = np.maximum(1, np.rint(h * scale / grid)).astype(np.int64)
    limit = most // (grid * grid)
    ratio = w / h
    while (large := (columns * rows > limit) & ((columns > 1) | (rows > 1))).any():
        narrower = np.abs((columns - 1) / rows - ratio)
        lower = np.abs(columns / np.maximum(rows - 1, 1) - ratio)
        by_column = (rows == 1) | ((columns > 1) & (narrower < lower))
        # One side of a single block: the other takes the rest at once.
        thin = large & ((columns == 1) | (rows == 1))
        columns = np.where(large, np.where(thin & by_column, limit // rows, columns - by_column), columns)
        rows = np.where(large & ~by_column, np.where(thin, limit // columns, rows - 1), rows)
    return columns, rows


_SIZE = "width long, height long"


def scale_to_fit(width, height, largest: tuple[int, int] = LARGEST, smallest: tuple[int, int] = SMALLEST, grid: int = GRID):
    """Struct (width, height) of an image after scaling to the grid; sizes of 0 or less stay."""
    most, least = largest[0] * largest[1], smallest[0] * smallest[1]

    @F.pandas_udf(_SIZE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for w, h in batches:
            w, h = w.to_numpy(np.int64), h.to_numpy(np.int64)
            good = (w > 0) & (h > 0)
            columns, rows = fit_blocks(np.where(good, w, grid), np.where(good, h, grid), most, least, grid)
            yield pd.DataFrame({"width": np.where(good, columns * grid, w), "height": np.where(good, rows * grid, h)})

    return run(width, height)
