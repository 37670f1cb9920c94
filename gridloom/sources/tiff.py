"""TIFF rasters: a header parser, a block decoder, a writer, and a Spark data source that reads blocks in parallel."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Field types and sizes, tag numbers and sample kinds of the TIFF 6.0 format. Fixed values.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "sample_format", 33550: "pixel_scale", 33922: "tie_points", 34735: "geo_keys", 42112: "metadata", 42113: "nodata"}
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


@dataclass(frozen=True)
class Header:
    order: str
    fields: dict

    def one(self, name: str, default=None):
        v = self.fields.get(name, default)
        return v[0] if isinstance(v, (list, tuple)) else v

    @property
    def dtype(self) -> str:
        return self.order + KINDS[self.one("bits", 1), self.one("sample_format", 1)]


def parse(read) -> Header:
    """read(offset, size) returns bytes. Raises ValueError for anything but a classic, whole TIFF."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", head[4:])[0]
    if len(count := read(at, 2)) != 2:
        raise ValueError("no directory")
    n = struct.unpack(order + "H", count)[0]
    raw, fields = read(at + 2, 12 * n), {}
    if len(raw) != 12 * n:
        raise ValueError("directory is cut short")
    for k in range(n):
        tag, kind, count, value = struct.unpack(order + "HHI4s", raw[12 * k : 12 * k + 12])
        if tag not in TAGS or kind not in SIZES:
            continue
        size = SIZES[kind] * count
        data = value[:size] if size <= 4 else read(struct.unpack(order + "I", value)[0], size)
        if len(data) != size:
            raise ValueError(f"value of tag {tag} is cut short")
        fields[TAGS[tag]] = data.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(order + CODES[kind] * count, data) if kind in CODES else data
    out = Header(order, fields)
    if (out.one("bits", 1), out.one("sample_format", 1)) not in KINDS:
        raise ValueError("sample kind is not supported")
    return out


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    table: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("broken LZW code")
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    known, held, bits, out, width = {}, 0, 0, bytearray(), 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def restart() -> None:
        nonlocal width
        put(256)
        known.clear()
        known.update({bytes([k]): k for k in range(256)})
        width = 9

    restart()
    now, top = b"", 258
    for k in range(len(data)):
        nxt = now + data[k : k + 1]
        if nxt in known:
            now = nxt
            continue
        put(known[now])
        known[nxt] = top
        top += 1
        if top > 4093:
            restart()
            top = 258
        else:
            width = 9 + (top > 511) + (top > 1023) + (top > 2047)
        now = data[k : k + 1]
    if now:
        put(known[now])
        top += 1
        width = 9 + (top > 511) + (top > 1023) + (top > 2047)
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def block(header: Header, data: bytes, rows: int, columns: int, samples: int) -> np.ndarray:
    """Decoded samples (rows, columns, samples) of one strip or tile; a short block is an error."""
    kind, size = header.one("compression", 1), np.dtype(header.dtype).itemsize
    if kind in (8, 32946):
        data = zlib.decompress(data)
    elif kind == 5:
        data = unpack_lzw(data)
    elif kind != 1:
        raise ValueError(f"compression {kind} is not supported")
    need = rows * columns * samples * size
    if len(data) < need:
        raise ValueError("block is cut short")
    predictor = header.one("predictor", 1)
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(data[:need], np.uint8).reshape(rows, size * columns, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, columns, samples)
        return np.ascontiguousarray(np.moveaxis(planes, 1, -1)).view(f">{header.dtype[1:]}")[..., 0]
    x = np.frombuffer(data[:need], header.dtype).reshape(rows, columns, samples)
    if predictor == 2:
        return np.cumsum(x, axis=1, dtype=x.dtype)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return x


def blocks(header: Header) -> list[tuple[int, int, int, int, int, int, int]]:
    """(offset, size, first row, first column, rows, columns, plane) of every strip or tile."""
    h, w, planar, samples = header.one("height"), header.one("width"), header.one("planar", 1), header.one("samples", 1)
    planes = samples if planar == 2 else 1
    if "tile_offsets" in header.fields:
        th, tw = header.one("tile_height"), header.one("tile_width")
        grid = [(r, c, th, tw) for r in range(0, h, th) for c in range(0, w, tw)]
        where = list(zip(header.fields["tile_offsets"], header.fields["tile_counts"], strict=True))
    else:
        n = min(header.one("rows_per_strip", h), h)
        grid = [(r, 0, min(n, h - r), w) for r in range(0, h, n)]
        where = list(zip(header.fields["strip_offsets"], header.fields["strip_counts"], strict=True))
    if len(where) != len(grid) * planes:
        raise ValueError("number of blocks doesn't fit the size")
    return [(*where[p * len(grid) + k], *g, p) for p in range(planes) for k, g in enumerate(grid)]


def write(pixels: np.ndarray, origin: tuple[float, float] = (0.0, 0.0), cell: float = 1.0, compression: int = 1, predictor: int = 1, rows_per_strip: int | None = None, order: str = "<", tile: int | None = None, nodata: str | None = None) -> bytes:
    """A classic TIFF of bands x rows x columns samples, pixel-interleaved, in strips or square tiles."""
    bands, h, w = pixels.shape
    kind = pixels.dtype.newbyteorder("=").str[1:]
    bits, fmt = next(k for k, v in KINDS.items() if v == kind)
    size, n = pixels.dtype.itemsize, rows_per_strip or h
    parts = [(r, 0, min(n, h - r), w) for r in range(0, h, n)] if tile is None else [(r, c, tile, tile) for r in range(0, h, tile) for c in range(0, w, tile)]
    packed = []
    for r, c, rows, columns in parts:
        x = np.zeros((rows, columns, bands), pixels.dtype)
        part = np.moveaxis(pixels[:, r : r + rows, c : c + columns], 0, -1)
        x[: part.shape[0], : part.shape[1]] = part
        if predictor == 3:
            p = np.moveaxis(np.ascontiguousarray(x.astype(">" + kind))[..., None].view(np.uint8), -1, 1).reshape(rows, size * columns, bands)
            raw = np.diff(p, axis=1, prepend=np.zeros((rows, 1, bands), np.uint8)).astype(np.uint8).tobytes()
        elif predictor == 2:
            raw = np.diff(x, axis=1, prepend=np.zeros((rows, 1, bands), x.dtype)).astype(order + kind).tobytes()
        else:
            raw = x.astype(order + kind).tobytes()
        packed.append(zlib.compress(raw) if compression == 8 else pack_lzw(raw) if compression == 5 else raw)
    offsets = (8 + np.cumsum([0, *map(len, packed[:-1])])).tolist()
    place, count = ((273, 279) if tile is None else (324, 325))
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * bands), 259: (3, [compression]), 262: (3, [1]), place: (4, offsets), 277: (3, [bands]), count: (4, [len(p) for p in packed]), 284: (3, [1]), 317: (3, [predictor]), 339: (3, [fmt] * bands), 33550: (12, [cell, cell, 0.0]), 33922: (12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0])}
    tags |= {278: (4, [n])} if tile is None else {322: (4, [tile]), 323: (4, [tile])}
    if nodata is not None:
        tags[42113] = (2, nodata.encode() + b"\0")
    body = b"".join(packed)
    at = 8 + len(body) + (len(body) & 1)
    directory, extra, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (k, v) in sorted(tags.items()):
        raw = v if k == 2 else struct.pack(order + CODES[k] * len(v), *v)
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value = struct.pack(order + "I", free + len(extra))
            extra += raw + b"\0" * (len(raw) & 1)
        directory += struct.pack(order + "HHI", tag, k, len(v)) + value
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + b"\0" * (len(body) & 1) + struct.pack(order + "H", len(tags)) + directory + b"\0" * 4 + extra


def _opened(path: str):
    """read(offset, size) for a path or URI that pyarrow's file systems reach."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    f = system.open_input_file(name)
    return lambda offset, size: f.read_at(size, offset)


@dataclass
class Blocks(InputPartition):
    items: list


class GridTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per = options["path"], int(options.get("blocksPerPartition", "16"))

    def partitions(self) -> list[InputPartition]:
        all_ = blocks(parse(_opened(self.path)))
        return [Blocks(all_[a : a + self.per]) for a in range(0, len(all_), self.per)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        read = _opened(self.path)
        header = parse(read)
        h, w, planar = header.one("height"), header.one("width"), header.one("planar", 1)
        samples = 1 if planar == 2 else header.one("samples", 1)
        for offset, size, r0, c0, rows, columns, plane in partition.items:
            x = block(header, read(offset, size), rows, columns, samples)[: h - r0, : w - c0]
            rr, cc = np.mgrid[r0 : r0 + x.shape[0], c0 : c0 + x.shape[1]]
            for b in range(samples):
                yield pa.RecordBatch.from_arrays([pa.array(rr.ravel().astype(np.int32)), pa.array(cc.ravel().astype(np.int32)), pa.array(np.full(rr.size, plane + b + 1, np.int32)), pa.array(x[..., b].ravel().astype(np.float64))], names=["r", "c", "band", "v"])


class GridTiff(DataSource):
    """spark.read.format("grid_tiff").load(path): (r, c, band, v), bands from 1; option blocksPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "grid_tiff"

    def schema(self) -> str:
        return "r int, c int, band int, v double"

    def reader(self, schema) -> DataSourceReader:
        return GridTiffReader(self.options)


def read_tiff(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    spark.dataSource.register(GridTiff)
    df = spark.read.format("grid_tiff").load(path)
    return df.where(df.band.isin(bands)) if bands else df
