"""A set of hashes as a bitmap of fixed size, small enough for every task whatever the corpus.

What it holds may be more than what was put in: two hashes can share a bit. Operators use it to leave work
out that certainly is not needed, and decide by the data itself afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of the pieces in which a bitmap is put together.
PIECE = 1 << 18


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits of hashes in a bitmap; ``bits`` is a power of two."""
    return (hashes & np.uint64(bits - 1)).astype(np.int64)


class Bitmap:
    """``bits`` bits over hashes. Made of packed pieces, it stays packed, also when it is pickled, until its
    bits are looked at: the driver, which only passes it on, never holds it whole unless it is full."""

    def __init__(self, bits: int, pieces: Sequence[tuple[int, bytes]] = ()):
        self.bits, self.pieces = bits, list(pieces)

    def __reduce__(self):
        return Bitmap, (self.bits, self.pieces)

    @cached_property
    def data(self) -> np.ndarray:
        made = np.zeros(self.bits // 8, dtype=np.uint8)
        for at, packed in self.pieces:
            piece = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            made[at : at + len(piece)] |= piece
        return made

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def put(self, hashes: np.ndarray) -> None:
        """Set bits, in this process only."""
        at = places(hashes, self.bits)
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def with_all(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.bits, self.pieces + other.pieces)


def bitmap_of(hashes: DataFrame, bits: int) -> Bitmap:
    """The bitmap of the one column of ``hashes``. A task puts its hashes into a bitmap of its own and sends
    the pieces that have bits; pieces are put together before the driver gets them, each once."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bitmap(bits)
        for batch in batches:
            held.put(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        size = min(PIECE, len(held.data)) or 1
        for at in range(0, len(held.data), size):
            piece = held.data[at : at + size]
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([zlib.compress(piece, 1)], pa.binary())], names=["at", "piece"]
                )

    def together(table: pa.Table) -> pa.Table:
        out = None
        for packed in table["piece"].to_pylist():
            piece = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            out = piece.copy() if out is None else out | piece
        return pa.table({"at": table["at"][:1], "piece": pa.array([zlib.compress(out, 1)], pa.binary())})

    pieces = hashes.mapInArrow(own, "at long, piece binary").groupBy("at").applyInArrow(together, "at long, piece binary")
    found = pieces.toArrow()
    return Bitmap(bits, list(zip(found["at"].to_pylist(), found["piece"].to_pylist())))
