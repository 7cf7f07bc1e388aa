"""Pictures: size, content hash and average hash. PNG and BMP are decoded here, other formats with Pillow if present."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _png(content: bytes) -> np.ndarray:
    width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", content[16:29])
    if depth != 8 or lace or colour not in (0, 2, 3, 4, 6):
        raise ValueError("unsupported PNG")
    at, data, palette = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + n]
        if kind == b"IDAT":
            data += part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        at += 12 + n
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * k)
    out = np.zeros((height, width * k), np.int32)
    for y in range(height):
        how, row = int(rows[y, 0]), rows[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros(width * k, np.int32)
        if how == 0:
            out[y] = row
        elif how == 2:
            out[y] = (row + up) & 255
        else:
            line = out[y]
            for x in range(width * k):
                a, b, c = (int(line[x - k]) if x >= k else 0), int(up[x]), (int(up[x - k]) if x >= k else 0)
                if how == 1:
                    guess = a
                elif how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                line[x] = (int(row[x]) + guess) & 255
    pixels = out.reshape(height, width, k).astype(np.uint8)
    if colour == 3:
        if palette is None:
            raise ValueError("PNG without palette")
        return palette[pixels[..., 0]]
    return pixels[..., :3] if k >= 3 else np.repeat(pixels[..., :1], 3, axis=2)


def _bmp(content: bytes) -> np.ndarray:
    at, head, width, height, _, depth, packed = struct.unpack("<IIiiHHI", content[10:34])
    if depth not in (8, 24, 32) or packed not in (0, 3 if depth == 32 else 0):
        raise ValueError("unsupported BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(content[at : at + stride * abs(height)], np.uint8).reshape(abs(height), stride)[:, : width * depth // 8]
    if depth == 8:
        palette = np.frombuffer(content[14 + head : at], np.uint8).reshape(-1, 4)
        rows = palette[rows]
    rgb = rows.reshape(abs(height), width, -1)[..., 2::-1]
    return rgb[::-1] if height > 0 else rgb


def pixels(content: bytes) -> np.ndarray:
    """(height, width, 3) in RGB."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        try:
            return _png(content)
        except ValueError:
            pass
    if content[:2] == b"BM":
        try:
            return _bmp(content)
        except ValueError:
            pass
    import io

    from PIL import Image

    with Image.open(io.BytesIO(content)) as image:
        return np.asarray(image.convert("RGB"))


def average_hash(rgb: np.ndarray) -> str:
    """64 bits, row by row: whether each cell of an 8 x 8 grey reduction is at the mean or above."""
    grey = (rgb[..., 0].astype(np.int64) * 19595 + rgb[..., 1].astype(np.int64) * 38470 + rgb[..., 2].astype(np.int64) * 7471 + 0x8000) >> 16
    h, w = grey.shape
    ys, xs = np.linspace(0, h, 9), np.linspace(0, w, 9)
    small = np.empty((8, 8))
    for i in range(8):
        for j in range(8):
            a, b, c, d = int(ys[i]), max(int(np.ceil(ys[i + 1])), int(ys[i]) + 1), int(xs[j]), max(int(np.ceil(xs[j + 1])), int(xs[j]) + 1)
            small[i, j] = round(float(grey[a:b, c:d].mean()))
    bits = (small >= small.mean()).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def describe(content: bytes) -> dict:
    """sha256, ahash, size, width and height; the last of them null where the picture can't be decoded."""
    out = {"sha256": hashlib.sha256(content).hexdigest(), "ahash": None, "size": len(content), "width": None, "height": None}
    try:
        rgb = pixels(content)
        out |= {"ahash": average_hash(rgb), "width": int(rgb.shape[1]), "height": int(rgb.shape[0])}
    except Exception:  # any failure leaves the picture undecoded
        pass
    return out


ahash64 = pandas_udf(lambda s: s.map(lambda c: describe(bytes(c))["ahash"] if c is not None else None), StringType())
