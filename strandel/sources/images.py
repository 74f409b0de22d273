"""Images as tables: PNG in pure Python, one distributed task a file, sparse masks and dense greys."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(blob: bytes) -> np.ndarray:
    """height x width x channels of an 8- or 16-bit PNG that is not interlaced; palettes become colours."""
    if blob[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, palette, head = 8, b"", None, None
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG files are not read")
    channels = _CHANNELS[colour]
    stride = (width * channels * depth + 7) // 8
    step = max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        mode, line = int(raw[y, 0]), raw[y, 1:]
        if mode == 0:
            row = line
        elif mode == 2:
            row = line + above
        elif mode == 1:
            row = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel() if stride % step == 0 else line
        else:
            done, up, now = bytearray(stride), above.tolist(), line.tolist()
            for x in range(stride):
                a, b, c = (done[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
                if mode == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v, p=p: abs(p - v))
                done[x] = (now[x] + guess) & 255
            row = np.frombuffer(bytes(done), np.uint8)
        out[y] = above = row
    if depth == 16:
        values = out.view(">u2").astype(np.uint16)
    elif depth == 8:
        values = out
    else:
        values = np.stack([(out >> s) & (2**depth - 1) for s in range(8 - depth, -1, -depth)], -1).reshape(height, -1)[:, : width * channels]
    image = values.reshape(height, width, channels)
    return palette[image[..., 0]] if palette is not None else image


def encode_png(image: np.ndarray) -> bytes:
    """8-bit grey or colour PNG without filtering."""
    image = np.asarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = image.reshape(h, -1)
    body = zlib.compress(np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def as_mask(image: np.ndarray) -> np.ndarray:
    """Set where the mean of up to three channels is above 0."""
    return image[..., :3].astype(float).mean(-1) > 0


def as_grey(image: np.ndarray) -> np.ndarray:
    """Channel mean in [0, 1]: 8-bit values by 255, larger ones by their maximum."""
    grey = image[..., :3].astype(np.float32).mean(-1)
    top = float(grey.max(initial=0.0))
    if top > 1.5:
        grey = grey / (255.0 if top <= 255 else top)
    return np.clip(grey, 0.0, 1.0)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path", "content")


def _scene(path: str) -> str:
    return "__".join(path.rstrip("/").split("/")[-3:-1])


def read_masks(spark: SparkSession, root: str, name: str = "mask.png") -> tuple[DataFrame, DataFrame]:
    """scenes(scene_id, height, width) and pixels(scene_id, r, c) of all masks under `root`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, blob in zip(part.path, part.content, strict=True):
                mask = as_mask(decode_png(blob))
                r, c = np.nonzero(mask)
                yield pd.DataFrame({"scene_id": _scene(path), "height": mask.shape[0], "width": mask.shape[1], "r": [r.astype(np.int32).tolist()], "c": [c.astype(np.int32).tolist()]})

    rows = _files(spark, root, name).mapInPandas(run, "scene_id string, height int, width int, r array<int>, c array<int>")
    pixels = rows.selectExpr("scene_id", "inline(arrays_zip(r, c))")
    return rows.select("scene_id", "height", "width"), pixels.toDF("scene_id", "r", "c")


def read_greys(spark: SparkSession, root: str, name: str = "sem.png") -> DataFrame:
    """scene_id, height, width, grey (float array, row by row) of all images under `root`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, blob in zip(part.path, part.content, strict=True):
                grey = as_grey(decode_png(blob))
                yield pd.DataFrame({"scene_id": _scene(path), "height": grey.shape[0], "width": grey.shape[1], "grey": [grey.ravel().tolist()]})

    return _files(spark, root, name).mapInPandas(run, "scene_id string, height int, width int, grey array<float>")
