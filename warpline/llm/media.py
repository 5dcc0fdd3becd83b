"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized tiles, difference hashes.

decode() reads P1 to P6 Netpbm and uncompressed 8, 24 and 32 bit BMP. Resizing averages exact
areas by an integral image, so one pass over the samples serves any tile size. A tile is kept as
NPY bytes, and its difference hash compares neighbouring cells of a 9 x 8 tile.

A text's payload is stored as a PGM in a table of the shared folder and read back; the NPY tiles, and BMP
copies of them, made from what was read are a table there as well, and are read back for their digests.

Defined cases: null, empty, broken or zero-sized media, and headers that claim more samples than there
are bytes, give null features in featurise(); a null or empty text has a payload of 64 zero bytes, and one whose
size is a multiple of 64 gets no padding; very long texts are one PGM each; repeated rows and null ids
keep a row each; an empty table gives an empty result; extra columns are not read; equal bytes, equal results.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warpline.llm.common import buffers, id_text, materialise, small_batches, table

UNIT = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as binary PGM."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey (h, w) or 24-bit RGB (h, w, 3) samples as bottom-up BMP."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    row = samples if grey else samples[:, :, ::-1].reshape(h, w * 3)
    pad = -row.shape[1] % 4
    body = np.pad(row, ((0, 0), (0, pad)))[::-1].astype(np.uint8).tobytes()
    palette = bytes(v for i in range(256) for v in (i, i, i, 0)) if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0) + palette + body


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, header = data[1] - 48, 2, []
    need = 2 if kind in (1, 4) else 3
    while len(header) < need:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        header.append(int(data[at:end]))
        at = end
    w, h, top = header[0], header[1], header[2] if need == 3 else 1
    planes = 3 if kind in (3, 6) else 1
    if not (w > 0 and h > 0 and 0 < top < 1 << 16) or w * h * planes > 8 * len(data):
        raise ValueError("no size, or more samples than the file can hold")
    if kind == 1:
        bits = [c - 48 for c in data[at:] if c in (48, 49)]
        out = 1 - np.array(bits[: w * h], np.uint8)
    elif kind in (2, 3):
        out = np.array(data[at:].split()[: w * h * planes], np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        out = 1 - np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * planes, at + 1)
    if kind in (2, 3, 5, 6) and (len(out) < w * h * planes or out.min() < 0 or out.max() > top):
        raise ValueError("too few samples, or samples beyond the top value")
    if top != 255:
        out = (out.astype(np.int64) * 255 + top // 2) // top
    return out.astype(np.uint8).reshape((h, w, 3) if planes == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    if w <= 0 or h == 0 or w * abs(h) > len(data) or size < 40 or start < 14 + size:
        raise ValueError("no size, or more samples than the file can hold")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[:, : w * bits // 8][:: -1 if h > 0 else 1]
    if bits > 8:
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    colours = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    out = colours[rows]
    return out[:, :, 0].copy() if (colours == colours[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm or BMP file: (h, w) or (h, w, 3), uint8."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and 49 <= data[1] <= 54:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages by an integral image; float64 (height, width)."""
    grey = samples if samples.ndim == 2 else samples.mean(axis=2)
    h, w = grey.shape
    rows = np.concatenate([np.zeros((1, w)), grey.astype(np.float64).cumsum(0)])
    at = np.linspace(0, h, height + 1)
    low = np.minimum(at.astype(np.int64), h - 1)
    rows = rows[low] + (at - low)[:, None] * (rows[low + 1] - rows[low])
    both = np.concatenate([np.zeros((height + 1, 1)), rows.cumsum(1)], axis=1)
    at = np.linspace(0, w, width + 1)
    low = np.minimum(at.astype(np.int64), w - 1)
    both = both[:, low] + (at - low) * (both[:, low + 1] - both[:, low])
    return np.diff(np.diff(both, axis=0), axis=1) * (height * width) / (h * w)


def tile(samples: np.ndarray, height: int = 8, width: int = 9) -> np.ndarray:
    return np.clip(np.rint(resize(samples, height, width)), 0, 255).astype(np.uint8)


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def dhash(small: np.ndarray) -> str:
    """64 bits: is each cell of the 8 x 9 tile darker than its right neighbour."""
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


FEATURES = pa.schema([("media", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("tile_npy", pa.binary()), ("dhash", pa.string())])


def featurise(media: DataFrame, media_col: str = "media", height: int = 8, width: int = 9) -> DataFrame:
    """All columns of media, and of the Netpbm or BMP bytes in one of them height, width, tile_npy and dhash, whose names must be new.

    Null, empty or unreadable media keep their row, with null features.
    """
    names, own, at = media.columns, FEATURES.names[1:], media.columns.index(media_col)
    if set(names) & set(own):
        raise ValueError("a column has the name of a feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for m in b.column(at).to_pylist():
                try:
                    a = decode(m or b"")
                    out.append((*a.shape[:2], npy(tile(a, height, width)), dhash(tile(a, 8, 9))))
                except (ValueError, OverflowError, struct.error, IndexError):
                    out.append((None, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(own)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), FEATURES.field(n).type) for n, c in zip(own, cols))], names=b.schema.names + own)

    rows = media.toDF(*[f"c{i}" for i in range(len(names))])  # by place, as names with dots can't be passed to Python
    ddl = "height int, width int, tile_npy binary, dhash string"
    fields = [*rows.schema.fields, *rows.sparkSession.createDataFrame([], ddl).schema.fields]
    return rows.mapInArrow(run, StructType(fields)).toDF(*names, *own)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a PGM of width 64: doc_id, n_bytes, media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column(1))
            media = []
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                samples = np.zeros(max(1, -(-(e - s) // UNIT)) * UNIT, np.uint8)
                samples[: e - s] = raw[s:e]
                media.append(encode_pgm(samples.reshape(-1, UNIT)))
            yield table({"doc_id": b.column(0), "n_bytes": np.diff(off), "media": media}, STORED)

    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


TILES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_npy", pa.binary()), ("tile_bmp", pa.binary())])


def tiles(stored: DataFrame, height: int = 8, width: int = 9) -> DataFrame:
    """Decode stored media; describe payload and stored form, and make the tile as NPY and as BMP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                a = decode(m)
                payload, small = a.tobytes(), tile(a, height, width)
                feature = dhash(small if (height, width) == (8, 9) else tile(a))
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature, npy(small), encode_bmp(small)))
            yield table(dict(zip(TILES.names, zip(*rows), strict=True)) if rows else {n: [] for n in TILES.names}, TILES)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary, tile_bmp binary")


def same_samples(tiles_: DataFrame) -> DataFrame:
    """tiles with bmp_equal: whether the BMP, decoded, has the samples of the NPY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(b.schema.get_field_index("tile_npy")), b.column(b.schema.get_field_index("tile_bmp"))
            same = [np.array_equal(np.load(io.BytesIO(m)), decode(n)) for m, n in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same, pa.bool_())], names=[*b.schema.names, "bmp_equal"])

    return tiles_.mapInArrow(run, tiles_.schema.simpleString()[7:-1].replace(":", " ") + ", bmp_equal boolean")


def describe_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as PGM, read back, tiles stored and read back: a row of digests a text."""
    stored = materialise(store_texts(docs, id_col, text_col))
    found = materialise(tiles(stored))
    return same_samples(found).withColumn("tile_sha256", F.sha2("tile_npy", 256)).drop("tile_npy", "tile_bmp")
