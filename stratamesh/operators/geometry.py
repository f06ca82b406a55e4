"""Boxes, principal axes and oriented boxes of groups of triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]


def box_aggregates() -> list[Column]:
    """Aggregates of the six box columns."""
    return [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in CORNERS]


def boxes(df: DataFrame, *by: str) -> DataFrame:
    """The box of each group; without ``by`` one row, zeros if there is nothing."""
    if by:
        return df.groupBy(*by).agg(*box_aggregates())
    return df.agg(*box_aggregates()).fillna(0.0)


def boxes_of_vertices(df: DataFrame, *by: str) -> DataFrame:
    """As ``boxes``, from x, y and z."""
    return boxes(df.withColumns({f"{m}_{a}": F.col(a) for m in ("min", "max") for a in "xyz"}), *by)


def moments(df: DataFrame, *by: str, columns: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """Means and population covariances of three columns for each group, with partial aggregation."""
    x, y, z = columns
    pairs = {"xx": (x, x), "yy": (y, y), "zz": (z, z), "xy": (x, y), "xz": (x, z), "yz": (y, z)}
    cov = [(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(f"cov_{k}") for k, (a, b) in pairs.items()]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{a}") for c, a in zip(columns, "xyz")), *cov)


def principal_axes(df: DataFrame, *by: str, columns: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """``by``, center, axes (rows, by descending eigenvalue) and eigenvalues of each group; the identity where nothing varies."""
    m = moments(df, *by, columns=columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            axes, values = [], []
            for xx, yy, zz, xy, xz, yz in frame[[f"cov_{k}" for k in ("xx", "yy", "zz", "xy", "xz", "yz")]].itertuples(index=False):
                matrix = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]], dtype=float)
                if np.abs(matrix - np.diag(np.diag(matrix))).max() < 1e-12:  # diagonal: the coordinate axes
                    order = np.argsort(-np.diag(matrix), kind="stable")
                    w, v = np.diag(matrix)[order], np.eye(3)[order]
                else:
                    w, v = np.linalg.eigh(matrix)
                    w, v = w[::-1], v.T[::-1]
                axes.append(v.tolist())
                values.append(np.maximum(w, 0).tolist())
            out = frame[list(by)].copy()
            out["center"] = frame[["mean_x", "mean_y", "mean_z"]].to_numpy().tolist()
            out["axes"], out["eigenvalues"] = axes, values
            yield out

    keys = ", ".join(f"`{b}` {m.schema[b].dataType.simpleString()}" for b in by)
    return m.mapInPandas(run, f"{keys}, center array<double>, axes array<array<double>>, eigenvalues array<double>")


def oriented_boxes(tris: DataFrame, *by: str) -> DataFrame:
    """``by``, center, axes, half of each group: the extents, along its principal axes, of its triangles' boxes.

    The farthest corner of a box along an axis needs no look at eight corners: each coordinate adds its better end.
    """
    axes = principal_axes(tris, *by)
    joined = tris.join(axes, list(by))
    ends = []
    for k in range(3):
        a = [F.col("axes")[k][i] for i in range(3)]
        spans = [(a[i] * (F.col(f"min_{c}") - F.col("center")[i]), a[i] * (F.col(f"max_{c}") - F.col("center")[i])) for i, c in enumerate("xyz")]
        ends += [F.min(sum((F.least(*s) for s in spans), F.lit(0.0))).alias(f"lo{k}"), F.max(sum((F.greatest(*s) for s in spans), F.lit(0.0))).alias(f"hi{k}")]
    found = joined.groupBy(*by).agg(*ends).join(axes, list(by))
    middle = [(F.col(f"lo{k}") + F.col(f"hi{k}")) / 2 for k in range(3)]
    center = F.array(*(F.col("center")[i] + middle[0] * F.col("axes")[0][i] + middle[1] * F.col("axes")[1][i] + middle[2] * F.col("axes")[2][i] for i in range(3)))
    half = F.array(*((F.col(f"hi{k}") - F.col(f"lo{k}")) / 2 for k in range(3)))
    return found.select(*by, center.alias("center"), "axes", half.alias("half"))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, descending, in closed form."""
    off = xy * xy + xz * xz + yz * yz
    q = (xx + yy + zz) / F.lit(3.0)
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + F.lit(2.0) * off) / F.lit(6.0))
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (F.lit(2.0) * p * p * p)))).otherwise(F.lit(1.0))
    phi = F.acos(r) / F.lit(3.0)
    first, last = q + F.lit(2.0) * p * F.cos(phi), q + F.lit(2.0) * p * F.cos(phi + F.lit(2.0943951023931953))
    return [first, F.lit(3.0) * q - first - last, last]
