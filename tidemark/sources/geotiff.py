"""GeoTIFF files as tables, and tables as GeoTIFF files.

``read`` lets Spark read whole files, so any storage it knows will do; ``Ranged`` fetches the header and those strips or tiles
that meet a window, at full size or from an overview. Workers decode only what meets the window and give
pixels a batch at a time. Supported: classic and big files, plain and deflated data, all three predictors, strips
and tiles, overviews, bands interleaved or apart, integers and floats.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Side of the tiles of a written file, and the least side of its smallest overview.
TILE = 256
#: Bytes that are fetched at once where a header is read.
HEAD_BYTES = 16 << 10


@dataclass
class Header:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)
    #: Of an overview: the full image.
    full: Header | None = None

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def shape(self) -> tuple[int, int, int]:
        """Bands, rows, columns."""
        return self.one(277, 1), self.one(257), self.one(256)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[self.one(339, 1)]}{self.one(258, 8) // 8}")

    @property
    def transform(self) -> tuple[float, float, float, float]:
        """x and y of the upper left corner, width and height of a pixel."""
        if self.full:
            x, y, sx, sy = self.full.transform
            return x, y, sx * self.full.one(256) / self.one(256), sy * self.full.one(257) / self.one(257)
        scale, tie = self.tags.get(33550, (1.0, 1.0, 0.0)), self.tags.get(33922, (0.0,) * 6)
        return tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]

    @property
    def nodata(self) -> float | None:
        text = (self.full or self).tags.get(42113)
        return float(text) if text else None

    @property
    def epsg(self) -> int | None:
        keys = (self.full or self).tags.get(34735, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        return found.get(3072) or found.get(2048)

    @property
    def names(self) -> list[str]:
        xml = (self.full or self).tags.get(42112, "")
        out = []
        for k in range(self.shape[0]):
            mark = f'name="DESCRIPTION" sample="{k}" role="description">'
            at = xml.find(mark)
            out.append(xml[at + len(mark) : xml.find("<", at + len(mark))] if at >= 0 else f"band{k + 1}")
        return out


class Ranged:
    """A file as slices: ``fetch(at, n)`` gives bytes, and what a header needs is fetched a stretch at a time."""

    def __init__(self, fetch: Callable[[int, int], bytes]) -> None:
        self.fetch, self.fetched, self.kept = fetch, 0, {}

    def _get(self, at: int, n: int) -> bytes:
        out = self.fetch(at, n)
        self.fetched += len(out)
        return out

    def __getitem__(self, s: slice) -> bytes:
        n = s.stop - s.start
        if n > HEAD_BYTES:
            return self._get(s.start, n)
        out = b""
        for k in range(s.start // HEAD_BYTES, (s.stop - 1) // HEAD_BYTES + 1 if n else 0):
            if k not in self.kept:
                self.kept[k] = self._get(k * HEAD_BYTES, HEAD_BYTES)
            out += self.kept[k]
        at = s.start % HEAD_BYTES
        return out[at : at + n]


def headers(data: bytes | Ranged) -> list[Header]:
    """Of the full image, then of its overviews, large to small."""
    start = data[0:16]
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    # Formats of an offset and of the number of entries; sizes of the latter, of an entry and of the room for a value.
    at_, n_, head, entry, room = ("Q", "Q", 8, 20, 8) if big else ("I", "H", 2, 12, 4)
    at = struct.unpack(order + at_, start[8:16] if big else start[4:8])[0]
    out: list[Header] = []
    while at:
        h = Header(order, full=out[0] if out else None)
        entries = struct.unpack(order + n_, data[at : at + head])[0]
        for k in range(entries):
            e = data[at + head + entry * k : at + head + entry * (k + 1)]
            tag, kind, n = struct.unpack(order + "HH" + at_, e[: entry - room])
            size = _SIZES.get(kind, 0) * n
            raw = e[-room:][:size] if size <= room else data[(p := struct.unpack(order + at_, e[-room:])[0]) : p + size]
            if kind == 2:
                h.tags[tag] = raw.rstrip(b"\0").decode("latin-1")
            elif kind in _CODES:
                h.tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", raw)
        if not out or h.one(254, 0) & 5 == 1:  # smaller, and no mask
            out.append(h)
        end = at + head + entry * entries
        at = struct.unpack(order + at_, data[end : end + room])[0]
    return out[:1] + sorted(out[1:], key=lambda h: -h.one(256))


def parse(data: bytes | Ranged, level: int | None = None) -> Header:
    """The header of the full image, or of an overview by number: 0 is the largest, numbers beyond the smallest mean that."""
    found = headers(data)
    return found[0] if level is None or len(found) == 1 else found[1 + min(level, len(found) - 2)]


def _undo(raw: bytes, head: Header, rows: int, cols: int, bands: int) -> np.ndarray:
    predictor, kind = head.one(317, 1), head.dtype
    if predictor == 3:
        own = np.frombuffer(raw, np.uint8)[: rows * cols * bands * kind.itemsize].reshape(rows, cols * bands * kind.itemsize)
        own = np.cumsum(own.reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * bands)
        return np.ascontiguousarray(own.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, bands)
    out = np.frombuffer(raw, kind)[: rows * cols * bands].reshape(rows, cols, bands)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
    return out


def blocks(data: bytes | Ranged, window: tuple[float, float, float, float] | None = None, head: Header | None = None):
    """(first band, first row, first column, array of rows x columns x bands) of each strip or tile that meets the window (in the file's coordinates)."""
    head = head or parse(data)
    bands, height, width = head.shape
    tiled = 322 in head.tags
    bw, bh = (head.one(322), head.one(323)) if tiled else (width, min(head.one(278, height), height))
    offsets, sizes = (head.tags[324], head.tags[325]) if tiled else (head.tags[273], head.tags[279])
    across, down = -(-width // bw), -(-height // bh)
    apart = head.one(284, 1) == 2
    x0, y0, sx, sy = head.transform
    compression = head.one(259, 1)
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression} is not supported")
    for i, (at, n) in enumerate(zip(offsets, sizes)):
        band, k = divmod(i, across * down) if apart else (0, i)
        r, c = k // across * bh, k % across * bw
        if window and (x0 + (c + bw) * sx < window[0] or x0 + c * sx > window[2] or y0 - (r + bh) * sy > window[3] or y0 - r * sy < window[1]):
            continue
        raw = data[at : at + n]
        rows = bh if tiled else min(bh, height - r)
        part = _undo(zlib.decompress(raw) if compression != 1 else raw, head, rows, bw, 1 if apart else bands)
        yield band, r, c, part[: height - r, : width - c]


def array(data: bytes | Ranged, window: tuple[float, float, float, float], level: int | None = None) -> tuple[Header, int, int, np.ndarray]:
    """Header, first row and column, and rows x columns of the first band where it meets the window, NaN for no data and where there is none."""
    head = parse(data, level)
    _, height, width = head.shape
    x0, y0, sx, sy = head.transform
    at = lambda v, most: int(min(max(np.floor(v), 0), most))
    c0, c1, r0, r1 = at((window[0] - x0) / sx, width), at((window[2] - x0) / sx + 1, width), at((y0 - window[3]) / sy, height), at((y0 - window[1]) / sy + 1, height)
    out = np.full((r1 - r0, c1 - c0), np.nan)
    if not out.size:
        return head, r0, c0, out
    for band, r, c, part in blocks(data, window, head):
        if band == 0:
            a, b, e, f = max(r, r0), min(r + part.shape[0], r1), max(c, c0), min(c + part.shape[1], c1)
            if a < b and e < f:
                out[a - r0 : b - r0, e - c0 : f - c0] = part[a - r : b - r, e - c : f - c, 0]
    if head.nodata is not None:
        out[out == head.nodata] = np.nan
    return head, r0, c0, out


def opened(href: str) -> Ranged:
    """A file by path or URI, which is read by ranges where it lies."""
    from pyarrow import fs

    place, path = fs.FileSystem.from_uri(href)
    file = place.open_input_file(path)
    size = file.size()
    return Ranged(lambda at, n: file.read_at(min(n, max(size - at, 0)), at))


def read(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """path, band (name), px_row, px_col, x, y (pixel centres), value (NULL for no data)."""

    def kernel(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                head = parse(data)
                x0, y0, sx, sy = head.transform
                names, none = head.names, head.nodata
                for band, r, c, part in blocks(data, window):
                    rows, cols = np.indices(part.shape[:2])
                    rows, cols = rows.ravel() + r, cols.ravel() + c
                    x, y = x0 + (cols + 0.5) * sx, y0 - (rows + 0.5) * sy
                    keep = slice(None) if window is None else (x >= window[0]) & (x <= window[2]) & (y >= window[1]) & (y <= window[3])
                    for k in range(part.shape[2]):
                        v = part[:, :, k].ravel()[keep].astype(np.float64)
                        gap = np.isnan(v) if none is None or np.isnan(none) else np.isnan(v) | (v == none)
                        n = len(v)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n, pa.string()), pa.array([names[band + k]] * n, pa.string()), pa.array(rows[keep], pa.int32()), pa.array(cols[keep], pa.int32()), pa.array(x[keep]), pa.array(y[keep]), pa.array(v, mask=gap)],
                            ["path", "band", "px_row", "px_col", "x", "y", "value"],
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(kernel, "path string, band string, px_row int, px_col int, x double, y double, value double")


def list_tiles(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """aoi_id, path, modified of the files under a path; ``pattern`` is a regular expression whose first group is the id. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"))
    aoi = F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("int")
    return files.select(aoi.alias("aoi_id"), "path", "modified").filter("aoi_id is not null")


def _predicted(tile: np.ndarray) -> bytes:
    """Deflated rows x columns x bands of float32 after the floating-point predictor: bytes by significance, then differences."""
    rows, cols, n = tile.shape
    planes = np.ascontiguousarray(tile.astype(">f4").reshape(rows, cols * n)).view(np.uint8).reshape(rows, cols * n, 4).transpose(0, 2, 1).reshape(rows, -1, n)
    planes = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)  # bytes wrap
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 6)


def _tiles(data: np.ndarray) -> list[bytes]:
    height, width, n = data.shape
    out = []
    for r in range(0, max(height, 1), TILE):
        for c in range(0, max(width, 1), TILE):
            tile = np.full((TILE, TILE, n), np.nan, np.float32)
            part = data[r : r + TILE, c : c + TILE]
            tile[: part.shape[0], : part.shape[1]] = part
            out.append(_predicted(tile))
    return out


def encode(bands: np.ndarray, names: list[str], x0: float, y0: float, cell: float, epsg: int | None = None, nodata: float = float("nan")) -> bytes:
    """A float32 file of bands x rows x columns: tiles, deflated after the floating-point predictor, with overviews of every second pixel
    until one fits a tile. Headers come first, then overviews from small to large, then the full image, so a reader of ranges finds all it needs in front."""
    n = len(bands)
    levels = [np.ascontiguousarray(bands.transpose(1, 2, 0).astype("<f4"))]
    while max(levels[-1].shape[:2]) > TILE:
        levels.append(levels[-1][::2, ::2])
    parts = [_tiles(v) for v in levels]
    xml = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{v}</Item>' for k, v in enumerate(names)) + "</GDALMetadata>"
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg or 32767)

    def tags(k: int, offsets: tuple[int, ...]) -> list[tuple]:
        height, width = levels[k].shape[:2]
        own = [
            (254, 4, (int(k > 0),)), (256, 4, (width,)), (257, 4, (height,)), (258, 3, (32,) * n), (259, 3, (8,)), (262, 3, (1,)), (277, 3, (n,)), (284, 3, (1,)), (317, 3, (3,)),
            (322, 4, (TILE,)), (323, 4, (TILE,)), (324, 4, offsets), (325, 4, tuple(map(len, parts[k]))), (339, 3, (3,) * n),
        ]
        if k == 0:
            own += [(33550, 12, (cell, cell, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)), (34735, 3, keys), (42112, 2, xml.encode() + b"\0")]
        return [*own, (42113, 2, f"{nodata}".encode() + b"\0")]

    def directory(k: int, at: int, offsets: tuple[int, ...], last: bool) -> bytes:
        own = tags(k, offsets)
        body, extra, extra_at = b"", b"", at + 2 + 12 * len(own) + 4
        for tag, kind, v in own:
            raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_CODES[kind]}", *v)
            count = len(raw) if isinstance(v, bytes) else len(v)
            if len(raw) <= 4:
                body += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                body += struct.pack("<HHII", tag, kind, count, extra_at + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        following = 0 if last else extra_at + len(extra)
        return struct.pack("<H", len(own)) + body + struct.pack("<I", following) + extra

    sizes = [len(directory(k, 8, (0,) * len(parts[k]), False)) for k in range(len(levels))]
    at, offsets = 8 + sum(sizes), [()] * len(levels)
    for k in reversed(range(len(levels))):
        own = []
        for p in parts[k]:
            own.append(at)
            at += len(p)
        offsets[k] = tuple(own)
    if at >= 1 << 32:
        raise ValueError("a file of 4 GB or more needs to be cut first")
    out, place = b"II*\0" + struct.pack("<I", 8), 8
    for k in range(len(levels)):
        out += directory(k, place, offsets[k], k == len(levels) - 1)
        place += sizes[k]
    return out + b"".join(p for k in reversed(range(len(levels))) for p in parts[k])


def files(pixels: DataFrame, key: str, order: str, value: str, tiles: DataFrame, cell: float) -> DataFrame:
    """``key``, content: one file per key with a band per distinct ``order``, ascending. A task holds one raster.

    ``tiles``: key, xmin, ymin, xmax, ymax, epsg; pixels: key, order, px_row, px_col, value."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        t = part.iloc[0]
        shape = int(np.ceil((t["ymax"] - t["ymin"]) / cell)), int(np.ceil((t["xmax"] - t["xmin"]) / cell))
        names = sorted(part["_band"].unique())
        out = np.full((len(names), *shape), np.nan, np.float32)
        out[np.searchsorted(names, part["_band"]), part["px_row"], part["px_col"]] = part["_v"].astype(float)
        return pd.DataFrame({key: [t[key]], "content": [encode(out, list(names), t["xmin"], t["ymax"], cell, int(t["epsg"]))]})

    own = pixels.select(key, F.col(order).cast("string").alias("_band"), "px_row", "px_col", F.col(value).cast("double").alias("_v"))
    kind = dict(pixels.dtypes)[key]
    return own.join(tiles.select(key, "xmin", "ymin", "xmax", "ymax", "epsg"), key).groupBy(key).applyInPandas(kernel, f"{key} {kind}, content binary")


def save(contents: DataFrame, key: str, folder: str, ending: str = "tif") -> DataFrame:
    """Writes each file as ``<folder>/<key>.<ending>`` from the executors and returns key and path. The folder is a URI that all of them reach.

    A file is written under a name of its own and then renamed, so a task that runs again leaves no half file."""

    def kernel(batches):
        import uuid

        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = f"{root}/.{k}-{uuid.uuid4().hex}"
                with place.open_output_stream(own) as out:
                    out.write(data)
                place.move(own, f"{root}/{k}.{ending}")
                done.append(f"{folder}/{k}.{ending}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], [key, "path"])

    return contents.select(key, "content").mapInArrow(kernel, f"{key} {dict(contents.dtypes)[key]}, path string")


# Workers may not have this package on their path, so kernels travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
