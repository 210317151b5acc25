"""PNG bytes of 8-bit planes, and back; heat colours; data URLs."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(a: np.ndarray) -> bytes:
    """PNG of a grey (h, w) or RGB (h, w, 3) array of bytes."""
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, c = a.shape
    lines = np.zeros((h, 1 + w * c), np.uint8)
    lines[:, 1:] = a.reshape(h, -1)
    body = b""
    for name, data in ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 6)), (b"IEND", b"")):
        body += struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return MAGIC + body


def decode(raw: bytes) -> np.ndarray:
    """(h, w, channels) of an 8-bit, not interlaced PNG without its alpha; ValueError for anything else."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at + 8 <= len(raw):
        n, name = struct.unpack(">I4s", raw[at : at + 8])
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        elif name == b"IDAT":
            data += raw[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    try:
        lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    except zlib.error as e:
        raise ValueError("broken PNG") from e
    out = np.zeros((h + 1, w + 1, c), np.int64)  # a border of zeros above and to the left
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].reshape(w, c).astype(np.int64)
        up = out[y]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = line.cumsum(axis=0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (line + up[1:]) & 255
        else:
            for x in range(1, w + 1):
                a, b, d = out[y + 1, x - 1], up[x], up[x - 1]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, d))
                out[y + 1, x] = (line[x - 1] + guess) & 255
    return out[1:, 1:, : 1 if c <= 2 else 3].astype(np.uint8)


def heat(plane: np.ndarray) -> np.ndarray:
    """RGB of a plane of residuals: from blue by green to red."""
    v = np.arange(256) / 255
    colours = np.stack([255 * np.minimum(1, 2 * v), 255 * np.maximum(0, 1 - abs(2 * v - 1)), 180 * np.maximum(0, 1 - 2 * v)], axis=1)
    return np.floor(colours + 0.5).astype(np.uint8)[plane]


def data_url(raw: bytes, mime: str = "image/png") -> str:
    return f"data:{mime};base64,{base64.b64encode(raw).decode()}"


def crop_url(a: np.ndarray, left: int, top: int, width: int, height: int) -> str:
    """A part of a plane or an RGB image as a PNG data URL."""
    return data_url(encode(np.ascontiguousarray(a[top : top + height, left : left + width])))
