"""Bit-packed token files: every id takes the bits that the vocabulary needs; blocks of ids start at known byte offsets.

Layout: blocks of `BLOCK` ids (the last one shorter), each padded to whole bytes; then a footer of documents' keys, key flags, document
starts and block offsets; then the trailer. All numbers are little-endian; ids within a block are big-endian bit fields, one after the other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

MAGIC = b"BITPACK1"
BLOCK = 4096
_TRAILER = struct.Struct("<QQQQII8s")  # footer offset, ids, documents, blocks, bits, block size, magic


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    fields = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(fields.ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = fields
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a local path or a URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Writer:
    """Streams documents into one file; holds one block and the footer's numbers."""

    def __init__(self, path: str, bits: int):
        self.system, self.path = open_folder(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.bits, self.rest = self.system.open_output_stream(self.path), bits, np.zeros(0, np.uint32)
        self.keys, self.valid, self.starts, self.offsets = [], [], [0], [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.valid.append(key is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        while len(self.rest) >= BLOCK:
            self._block(self.rest[:BLOCK])
            self.rest = self.rest[BLOCK:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        footer = self.offsets[-1]
        for values, kind in ((self.keys, "<i8"), (self.valid, "u1"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(_TRAILER.pack(footer, self.starts[-1], len(self.keys), len(self.offsets) - 1, self.bits, BLOCK, MAGIC))
        self.out.close()


class Reader:
    """Random access to one file: `ids(a, b)` reads only the blocks that it needs."""

    def __init__(self, path: str):
        system, inner = open_folder(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        footer, self.n_ids, n_docs, n_blocks, self.bits, self.block, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        data = self.file.read_at(size - _TRAILER.size - footer, footer)
        self.keys, at = np.frombuffer(data, "<i8", n_docs), 8 * n_docs
        self.valid = np.frombuffer(data, "u1", n_docs, at).astype(bool)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at + n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + n_docs + 8 * (n_docs + 1)).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, np.uint32)
        lo, hi = a // self.block, (b - 1) // self.block
        data, begin = self.file.read_at(int(self.offsets[hi + 1] - self.offsets[lo]), int(self.offsets[lo])), self.offsets[lo]
        parts = [unpack(data[self.offsets[k] - begin : self.offsets[k + 1] - begin], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(lo, hi + 1)]
        return np.concatenate(parts)[a - lo * self.block : b - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def spans(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, behind the last, their ids) in order, about `most` ids at a time."""
        k = 0
        while k < len(self.keys):
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most, "right")) - 1)
            yield k, to, self.ids(int(self.starts[k]), int(self.starts[to]))
            k = to


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
