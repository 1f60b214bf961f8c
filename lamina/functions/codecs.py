"""Compression of binary columns; a codec whose library is missing is not offered."""

from __future__ import annotations

import gzip
import lzma
from collections.abc import Callable
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _codecs() -> dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]]:
    found = {"plain": (bytes, bytes), "gzip": (lambda x: gzip.compress(x, mtime=0), gzip.decompress), "lzma": (lzma.compress, lzma.decompress)}
    if find_spec("zstandard"):
        import zstandard

        found["zstd"] = (lambda x: zstandard.ZstdCompressor().compress(x), lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x))
    if find_spec("lz4"):
        import lz4.frame

        found["lz4"] = (lz4.frame.compress, lz4.frame.decompress)
    return found


def _apply(data: Column, method: str, way: int) -> Column:
    if method not in _codecs():
        raise ValueError(f"no such codec here: {method}")

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        code = _codecs()[method][way]
        return pa.array([None if x is None else code(x) for x in values.to_pylist()], pa.binary())

    return run(data)


def compress(data: Column, method: str) -> Column:
    return _apply(data, method, 0)


def decompress(data: Column, method: str) -> Column:
    return _apply(data, method, 1)


def method_for(size: Column, method: str, least: int) -> Column:
    """The codec for a content: plain below the least size."""
    return F.when(size < least, "plain").otherwise(method)
