"""Containers of compressed chunks: a header, an index of lengths, chunks aligned to 8 bytes, and a checksum of each chunk."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.hashes import crc32c_of

# Our own format.
MAGIC, HEAD, ENTRY = b"FCB1", "<4sI", "<II"


def align(n: int) -> int:
    return (n + 7) // 8 * 8


def pack_all(items: list[list[bytes]]) -> list[bytes]:
    """A container for each list of chunks; all checksums are worked out together."""
    deflate = zstandard.ZstdCompressor().compress
    z = [[deflate(c) for c in chunks] for chunks in items]
    sums = iter(crc32c_of([c for cs in z for c in cs]))
    out = []
    for cs in z:
        head = struct.pack(HEAD, MAGIC, len(cs)) + b"".join(struct.pack(ENTRY, len(c), next(sums)) for c in cs)
        out.append(head.ljust(align(len(head)), b"\0") + b"".join(c.ljust(align(len(c)), b"\0") for c in cs))
    return out


def pack(chunks: list[bytes]) -> bytes:
    """The container of some chunks."""
    return pack_all([chunks])[0]


def index(head: bytes) -> list[tuple[int, int, int]]:
    """(offset, length, checksum) of each chunk from the bytes at the start; offsets are running sums of aligned lengths. Raises if it's no container."""
    magic, n = struct.unpack_from(HEAD, head)
    if magic != MAGIC:
        raise ValueError("not a container")
    at, out = align(struct.calcsize(HEAD) + n * struct.calcsize(ENTRY)), []
    for i in range(n):
        length, crc = struct.unpack_from(ENTRY, head, struct.calcsize(HEAD) + i * struct.calcsize(ENTRY))
        out.append((at, length, crc))
        at += align(length)
    return out


def chunks_of(raws: list[bytes], crcs: list[int]) -> list[bytes]:
    """The contents of chunks; raises if a checksum differs."""
    if crc32c_of(list(raws)) != list(crcs):
        raise ValueError("checksum differs")
    inflate = zstandard.ZstdDecompressor().decompress
    return [inflate(r) for r in raws]


def chunk(raw: bytes, crc: int) -> bytes:
    """A chunk's content; raises if its checksum differs."""
    return chunks_of([raw], [crc])[0]


def encode_plane(codes: np.ndarray) -> bytes:
    """A plane of byte codes as zlib of differences to the row above, modulo 256."""
    up = codes.astype(np.int16)
    up[1:] -= codes[:-1].astype(np.int16)
    return zlib.compress((up % 256).astype(np.uint8).tobytes())


def decode_plane(content: bytes, width: int, height: int) -> np.ndarray:
    """The codes of a plane; raises if the size isn't as declared."""
    flat = np.frombuffer(zlib.decompress(content), np.uint8)
    if flat.size != width * height:
        raise ValueError("plane has another size than declared")
    return np.add.accumulate(flat.reshape(height, width), axis=0, dtype=np.uint8)


class _Span(InputPartition):
    def __init__(self, path: str, number: int, offset: int, length: int, crc: int):
        self.path, self.number, self.offset, self.length, self.crc = path, number, offset, length, crc


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Span]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".fcb"))
        out = []
        for f in files:
            with open(f, "rb") as h:
                start = h.read(struct.calcsize(HEAD))
                n = struct.unpack(HEAD, start)[1] if start[:4] == MAGIC else 0
                out += [_Span(f, i, *e) for i, e in enumerate(index(start + h.read(n * struct.calcsize(ENTRY))))]
        return out

    def read(self, span: _Span) -> Iterator[tuple]:
        with open(span.path, "rb") as h:
            h.seek(span.offset)
            yield span.path, span.number, chunk(h.read(span.length), span.crc)


class ContainerSource(DataSource):
    """``spark.read.format("container").load(path)``: a row per chunk; each task reads only its chunk's bytes."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return "path string, chunk_no int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"))
