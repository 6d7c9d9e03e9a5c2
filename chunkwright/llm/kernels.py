"""numpy kernels shared by the operators: rolling hashes over slabs of texts, and count-min sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Odd multipliers of the polynomial hashes and of the finaliser (fixed values).
BASE, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SLAB_CHARS = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that equal inputs stay equal and all bits depend on all bits."""
    h = (h ^ (h >> U(33))) * U(MIX_1)
    h = (h ^ (h >> U(33))) * U(MIX_2)
    return h ^ (h >> U(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    held = _powers.get(0)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, SLAB_CHARS + 1)
        inverse = pow(BASE, -1, 1 << 64)
        both = []
        for b in (BASE, inverse):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[0] = held = (both[0], both[1])
    return held


def slabs(texts: list[str], limit: int = SLAB_CHARS) -> Iterator[range]:
    """Ranges of consecutive texts of about ``limit`` characters together; one longer text is a range alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield range(begin, i)
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield range(begin, len(texts))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` in a row, and the offsets at which each text begins (one more than texts)."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), at


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of ``values``; differences give the hash of any run."""
    p = np.zeros(len(values) + 1, dtype=U)
    np.cumsum((values.astype(U) + U(1)) * powers(len(values))[0][: len(values)], out=p[1:])
    return p


def run_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [begin, end); equal runs have equal hashes wherever they lie."""
    return mixed((prefix[end] - prefix[begin]) * powers(len(prefix))[1][begin])


def window_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` values."""
    n = len(prefix) - k
    return mixed((prefix[k:] - prefix[:n]) * powers(len(prefix))[1][:n]) if n > 0 else np.zeros(0, dtype=U)


def sliding(values: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``w`` values, by doubling."""
    out, span = values, 1
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(out) - (w - span)], out[w - span :]) if w > span else out


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column with null as the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


# --- count-min sketches ----------------------------------------------------------------------------------------
# A sketch has ``depth`` rows of ``1 << bits`` one-byte counters that saturate. Each task fills its own and sends
# it in slices; slices are merged by sum on the executors, and what reaches the driver is the merged sketch, whose
# size is fixed by ``bits`` and ``depth`` whatever the size of the corpus.

SLICE = 1 << 16


class CountMin:
    """Counters by hash; estimates never fall below the true count, up to ``limit``."""

    def __init__(self, bits: int, depth: int, cells: np.ndarray | None = None, limit: int = 255):
        self.bits, self.depth, self.limit = bits, depth, limit
        self.cells = np.zeros(depth << bits, dtype=np.uint8) if cells is None else cells

    def _at(self, h: np.ndarray, row: int) -> np.ndarray:
        # Disjoint bits of one 64-bit hash serve as the independent hashes of the rows.
        spun = h if row == 0 else mixed(h + U(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (spun >> U(64 - self.bits)).astype(np.int64) + (row << self.bits)

    def add(self, h: np.ndarray) -> None:
        for row in range(self.depth):
            at, n = np.unique(self._at(h, row), return_counts=True)
            self.cells[at] = np.minimum(self.cells[at].astype(np.int64) + n, self.limit)

    def estimate(self, h: np.ndarray) -> np.ndarray:
        out = self.cells[self._at(h, 0)]
        for row in range(1, self.depth):
            out = np.minimum(out, self.cells[self._at(h, row)])
        return out

    def slices(self) -> Iterator[tuple[int, bytes]]:
        for i in range(0, len(self.cells), SLICE):
            part = self.cells[i : i + SLICE]
            if part.any():
                yield i // SLICE, part.tobytes()


def sketch_bits(expected: int, per: int = 8, least: int = 16, most: int = 25) -> int:
    """Bits of a sketch with about ``per`` cells for each of ``expected`` hashes; 32 MB at most, whatever is expected."""
    return max(least, min(most, (max(1, expected) * per - 1).bit_length()))


def merged_sketch(slices: DataFrame, bits: int, depth: int, limit: int = 255) -> CountMin:
    """The sum of the partition sketches in ``slices`` (slice INT, cells BINARY)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(cells, dtype=np.uint8)
                total[i] = np.minimum(total[i].astype(np.uint16) + own, limit).astype(np.uint8) if i in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["slice", "cells"])

    # Each partition sketch is merged with its neighbours of the task before the exchange, then by slice.
    one = slices.repartition(min(64, max(1, (depth << bits) // SLICE)), "slice").mapInArrow(merge, "slice INT, cells BINARY")
    cells = np.zeros(depth << bits, dtype=np.uint8)
    for r in one.collect():  # bounded: depth << bits bytes
        part = np.frombuffer(r["cells"], dtype=np.uint8)
        cells[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return CountMin(bits, depth, cells, limit)


def sketch_of(hashed: DataFrame, bits: int, depth: int, limit: int = 255) -> CountMin:
    """Count-min sketch of the arrays of hashes in the column ``hashes`` of ``hashed``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = CountMin(bits, depth, limit=limit)
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            sketch.add(flat.view(U))
        rows = list(sketch.slices())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["slice", "cells"])

    return merged_sketch(hashed.select(F.col("hashes")).mapInArrow(fill, "slice INT, cells BINARY"), bits, depth, limit)
