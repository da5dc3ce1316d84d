"""Masks, selections and boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subject_weights(grid: DataFrame, mask: DataFrame, size: int, side: int) -> DataFrame:
    """(photo, y, x, weight) of a size x size frame: the side x side mask (values 0..255) sampled bilinearly at pixel centres. The mask is a row of arrays, so four neighbours are four elements."""
    at = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(side - 1)), (v + 0.5) * side / size - 0.5))
    rows = mask.groupBy("photo").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "w"))), lambda s: s["w"]).alias("m"))
    p = grid.join(rows, "photo").withColumn("v", at(F.col("y"))).withColumn("u", at(F.col("x")))
    i, j = F.floor("v").cast("int"), F.floor("u").cast("int")
    i2, j2 = F.least(i + 1, F.lit(side - 1)), F.least(j + 1, F.lit(side - 1))
    fy, fx = F.col("v") - i, F.col("u") - j
    m = lambda a, b: F.get("m", a * side + b)
    top, bottom = m(i, j) * (1 - fx) + m(i, j2) * fx, m(i2, j) * (1 - fx) + m(i2, j2) * fx
    return p.select("photo", "y", "x", ((top * (1 - fy) + bottom * fy) / 255).alias("weight"))


def expose(r: Column, g: Column, b: Column, weight: Column, exposure: float) -> tuple[Column, ...]:
    """A common gain that keeps white where it is, by the pixel's peak, blended by weight."""
    gain = 2.0**exposure
    peak = F.greatest(r, g, b) / 255
    factor = F.pow(gain / (1 + (gain - 1) * F.pow(peak, F.lit(2.2))), F.lit(1 / 2.2))
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(c * (1 + weight * (factor - 1))))).cast("int") for c in (r, g, b))


def suppress(boxes: DataFrame, overlap: float = 0.3, most: int = 16) -> DataFrame:
    """(photo, k): the boxes that greedy suppression keeps, best score first; a box goes when it overlaps a kept one by more. A photo's boxes are few (detectors give 100 at most), so a photo is a group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "k"], ascending=[False, True])
        b = rows[["x0", "y0", "x1", "y1"]].to_numpy()
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        kept: list[int] = []
        for i in range(len(b)):
            if len(kept) == most:
                break
            w = np.minimum(b[kept, 2], b[i, 2]) - np.maximum(b[kept, 0], b[i, 0])
            h = np.minimum(b[kept, 3], b[i, 3]) - np.maximum(b[kept, 1], b[i, 1])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            if not (both > overlap * (area[kept] + area[i] - both)).any():
                kept.append(i)
        return rows.iloc[kept][["photo", "k"]]

    return boxes.groupBy("photo").applyInPandas(run, "photo long, k int")


def components(mask: DataFrame, size: int) -> DataFrame:
    """(photo, label, n): 4-connected components of set pixels (photo, y, x), of 1 % of the frame or more, the three largest; the label is the first pixel in reading order. One frame at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell = np.full((size, size), size * size)
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        cell[y, x] = y * size + x
        on = cell < size * size
        while True:
            around = np.pad(cell, 1, constant_values=size * size)
            low = np.minimum.reduce([cell, around[:-2, 1:-1], around[2:, 1:-1], around[1:-1, :-2], around[1:-1, 2:]])
            low = np.where(on, low, size * size)
            jump = np.append(low.ravel(), size * size)[low]
            if (jump == cell).all():
                break
            cell = jump
        label, n = np.unique(cell[on], return_counts=True)
        big = n * 100 >= size * size
        label, n = label[big], n[big]
        order = np.lexsort((label, -n))[:3]
        return pd.DataFrame({"photo": rows["photo"].iloc[0], "label": label[order], "n": n[order]})

    return mask.groupBy("photo").applyInPandas(run, "photo long, label long, n long")
