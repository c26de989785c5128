"""Connected flooded regions as polygons.

Pixels of class 3 become runs along rows by window functions, which shrinks a mask to its outline's size before it is
grouped. One task then joins the runs of one raster (a tile and scene, of bounded size) by union-find; cells
touch along sides, not corners.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import BOTH, CELL_SIZE


def row_runs(classified: DataFrame, keys=("aoi_id", "scene_id"), cls: int = BOTH) -> DataFrame:
    """keys, px_row, first, last: maximal stretches of the class along rows."""
    keys = list(keys)
    wet = classified.filter(F.col("cls") == cls).select(*keys, "px_row", "px_col").distinct()
    w = Window.partitionBy(*keys, "px_row").orderBy("px_col")
    d = wet.withColumn("_g", F.col("px_col") - F.row_number().over(w))
    return d.groupBy(*keys, "px_row", "_g").agg(F.min("px_col").alias("first"), F.max("px_col").alias("last")).drop("_g")


def label_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Number of each run's region; runs sorted by row and column. Regions are numbered by their first run."""
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    i = 0
    for j in range(len(row)):
        while i < j and (row[i] < row[j] - 1 or row[i] == row[j] - 1 and last[i] < first[j]):
            i += 1
        k = i
        while k < j and row[k] == row[j] - 1 and first[k] <= last[j]:
            a, b = root(k), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
            k += 1
    roots = np.array([root(k) for k in range(len(row))], np.int64)
    return np.unique(roots, return_inverse=True)[1] if len(roots) else roots


def _one_only(own: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of the first runs (half open, ascending) that no second run covers."""
    out, k = [], 0
    for a, b in own:
        while k < len(other) and other[k][1] <= a:
            k += 1
        j = k
        while j < len(other) and other[j][0] < b:
            if other[j][0] > a:
                out.append((a, other[j][0]))
            a = max(a, other[j][1])
            j += 1
        if a < b:
            out.append((a, b))
    return out


def rings(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[list[tuple[int, int]]]:
    """Boundary of a region as closed rings of cell corners (column, row), the outer one first.

    Edges come from the runs of neighbouring rows, so their number is that of runs and not of cells. Cells lie to the right of an edge."""
    by_row: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(row.tolist(), first.tolist(), last.tolist()):
        by_row.setdefault(r, []).append((a, b + 1))
    for runs in by_row.values():
        runs.sort()
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    add = lambda p, q: step.setdefault(p, []).append(q)
    for r, runs in by_row.items():
        for a, b in runs:
            add((a, r + 1), (a, r))
            add((b, r), (b, r + 1))
        for a, b in _one_only(runs, by_row.get(r - 1, [])):
            add((a, r), (b, r))
        for a, b in _one_only(runs, by_row.get(r + 1, [])):
            add((b, r + 1), (a, r + 1))
    out = []
    for start in sorted(step, key=lambda p: (p[1], p[0])):
        while start in step:
            ring, at, before = [start], start, None
            while True:
                ways = step[at]
                # Where two cells meet at a corner, turning right keeps the ring on one cell.
                k = 0 if len(ways) == 1 or before is None else max(range(len(ways)), key=lambda i: (at[0] - before[0]) * (ways[i][1] - at[1]) - (at[1] - before[1]) * (ways[i][0] - at[0]))
                after = ways.pop(k)
                if not ways:
                    del step[at]
                before, at = at, after
                ring.append(at)
                if at == start:
                    break
            turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])
            body = ring[:-1]
            body = [p for i, p in enumerate(body) if turn(body[i - 1], p, body[(i + 1) % len(body)])]
            out.append([*body, body[0]])
    return out


def _wkt(parts: list[list[tuple[int, int]]], x0: float, y0: float, cell: float) -> str:
    one = lambda ring: "(" + ", ".join(f"{x0 + c * cell:.10g} {y0 - r * cell:.10g}" for c, r in ring) + ")"
    return "POLYGON (" + ", ".join(map(one, parts)) + ")"


def regions(classified: DataFrame, cell: float = CELL_SIZE, keys=("aoi_id", "scene_id"), outline: bool = True, origin: DataFrame | None = None, cls: int = BOTH) -> DataFrame:
    """keys, poly_id (from 1, in reading order), n_cells, area_m2, min_row, min_col, max_row, max_col, and wkt if ``outline``.

    Coordinates are metres right and down from (0, 0), or from ``origin`` (aoi_id, xmin, ymax)."""
    keys = list(keys)
    runs = row_runs(classified, keys, cls)
    if origin is not None:
        runs = runs.join(origin.select("aoi_id", "xmin", "ymax"), "aoi_id")
    else:
        runs = runs.withColumns({"xmin": F.lit(0.0), "ymax": F.lit(0.0)})

    def kernel(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["px_row", "first"], kind="stable")
        row, first, last = (part[c].to_numpy() for c in ("px_row", "first", "last"))
        label = label_runs(row, first, last)
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        made = []
        for k, at in enumerate(np.split(order, cuts), 1):
            r, a, b = row[at], first[at], last[at]
            n = int((b - a + 1).sum())
            wkt = _wkt(rings(r, a, b), float(part["xmin"].iloc[0]), float(part["ymax"].iloc[0]), cell) if outline else None
            made.append((k, n, n * cell * cell, int(r.min()), int(a.min()), int(r.max()), int(b.max()), wkt))
        out = pd.DataFrame(made, columns=["poly_id", "n_cells", "area_m2", "min_row", "min_col", "max_row", "max_col", "wkt"])
        for c in reversed(keys):
            out.insert(0, c, part[c].iloc[0])
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(*keys).schema)
    schema = f"{kinds}, poly_id int, n_cells long, area_m2 double, min_row int, min_col int, max_row int, max_col int, wkt string"
    out = runs.groupBy(*keys).applyInPandas(kernel, schema)
    return out if outline else out.drop("wkt")


def dissolved(classified: DataFrame, cell: float = CELL_SIZE, outline: bool = True) -> DataFrame:
    """Regions per area and date: the cells of the date's scenes together. ``classified`` has obs_date."""
    return regions(classified, cell, ("aoi_id", "obs_date"), outline)


# Workers may not have this package on their path, so kernels travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
