"""File format of token ids: independent zstandard frames with a seek table.

A file is

1. data frames: ids of whole documents as little-endian unsigned 32-bit integers, about ``FRAME_BYTES``
   raw bytes each (a longer document is a frame of its own);
2. a skippable frame with the documents' index: a zstandard frame of their number, then their ids (int64),
   null marks (uint8) and id counts (int64), column by column;
3. a skippable frame with the seek table of the zstandard seekable format: compressed size, raw size and
   checksum (low 32 bits of XXH64) of each data frame and of the index, then the count, flags and magic.

A reader gets the table from the file's end, the index, and then only the frames that it needs; each
frame is verified against its checksum.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard

FRAME_BYTES = 256 << 10
#: Fixed values of the zstandard format.
SEEK_MAGIC, TABLE_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
CHECKSUM_FLAG = 0x80


class CorruptFile(ValueError):
    """A checksum, size or mark of a file is not what was written."""


def _sum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents in the order given and holds one frame in memory."""

    def __init__(self, put: Callable[[bytes], object], level: int = 1):
        self.put, self.squeeze = put, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.raw: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.raw and self.size + len(ids) > FRAME_BYTES:
            self._flush()
        self.raw.append(ids)
        self.size += len(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)

    def _flush(self) -> None:
        if self.raw:
            raw = b"".join(self.raw)
            packed = self.squeeze.compress(raw)
            self.put(packed)
            self.table.append((len(packed), len(raw), _sum(raw)))
            self.raw, self.size = [], 0

    def close(self) -> None:
        self._flush()
        n = len(self.ids)
        index = struct.pack("<q", n) + b"".join(
            (
                np.array([i or 0 for i in self.ids], "<i8").tobytes(),
                np.array([i is None for i in self.ids], np.uint8).tobytes(),
                np.array(self.counts, "<i8").tobytes(),
            )
        )
        packed = self.squeeze.compress(index)
        self.put(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.table.append((len(packed) + 8, len(index), _sum(index)))
        body = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.put(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


@dataclass(frozen=True)
class Document:
    doc_id: int | None
    start: int
    ids: np.ndarray


class Reader:
    """``get(offset, size)`` returns bytes of the file, which has ``size`` bytes in all."""

    def __init__(self, get: Callable[[int, int], bytes], size: int):
        self.get = get
        tail = get(size - 9, 9)
        n, flags, magic = struct.unpack("<IBI", tail)
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise CorruptFile("no seek table at the end")
        body = get(size - 9 - 12 * n, 12 * n)
        table = np.frombuffer(body, "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.raw_sizes, self.sums = table[:, 1], table[:, 2]
        index = self._unpack(n - 1, get(int(self.offsets[n - 1]) + 8, int(table[n - 1, 0]) - 8))
        (docs,) = struct.unpack_from("<q", index)
        self.ids = np.frombuffer(index, "<i8", docs, 8)
        self.null = np.frombuffer(index, np.uint8, docs, 8 + 8 * docs).astype(bool)
        self.counts = np.frombuffer(index, "<i8", docs, 8 + 9 * docs)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.frame_starts = np.concatenate(([0], np.cumsum(self.raw_sizes[:-1]))) // 4

    def _unpack(self, frame: int, packed: bytes) -> bytes:
        size = int(self.raw_sizes[frame])
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size) if size else b""
        if len(raw) != size or _sum(raw) != self.sums[frame]:
            raise CorruptFile(f"frame {frame} fails its checksum")
        return raw

    def frame(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self._unpack(k, self.get(a, b - a)), "<u4")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[Document]:
        """All documents in file order, or those whose ids are ``wanted``; only their frames are read."""
        places = range(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)) & ~self.null).tolist()
        held, ids = -1, None
        for i in places:
            start, n = int(self.starts[i]), int(self.counts[i])
            k = int(np.searchsorted(self.frame_starts, start, side="right")) - 1 if n else held
            if n and k != held:
                held, ids = k, self.frame(k)
            first = start - int(self.frame_starts[k]) if n else 0
            yield Document(None if self.null[i] else int(self.ids[i]), start, ids[first : first + n] if n else np.zeros(0, "<u4"))
