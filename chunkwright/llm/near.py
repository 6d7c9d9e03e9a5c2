"""Near-duplicate records with small edits, insertions or reordering: an exact similarity join on token shingles.

Similarity is that of the sets of distinct runs of ``SHINGLE`` consecutive tokens (lower-case ``[A-Za-z0-9_]+``): size
of the intersection by size of the union. Records with fewer than ``LEAST`` runs are left out.

No pair of different records at or over the threshold is lost:

* Records with the same set form a class (128 bits of hash of the set); one record stands for it.
* Blocks: with runs ordered from rare to frequent (by a merged count-min sketch, ties by hash), two sets with
  similarity t or more must share a run among the first ``n - ceil(t * n) + 1`` of each. Those of them that the
  sketch doesn't prove to be of one record only are the block keys of a class. The order only has to be the same
  everywhere and estimates are never too low, so any size of sketch will do; it is taken from the measured length of the
  texts, up to 32 MB. From about a million runs per MB of it on, fewer keys are dropped and more rows are exchanged.
* Tiles: within a block the classes are compared by numpy exclusive-or and bit counts of parity sketches (bit
  ``h mod BITS`` flips with each run), whose distance never exceeds the symmetric difference of the sets. At
  similarity t or more that difference is at most ``(1 - t) / (1 + t) * (|A| + |B|)``, the radius. Rows are sorted by set
  size and tile pairs whose sizes differ by more than the radius are skipped. A block with more rows than
  ``TILE`` is split over many units, so none is held by one task.
* The few pairs within the radius are confirmed on the whole sets.

:func:`near_groups` needs no pairs. In a large unit only a forest is compared first: a row takes all rows within the radius of it that
no row before has taken, so a group of near copies costs one comparison a row. Those links are confirmed and united; then units are
compared for pairs between different groups only.

Defined results: null and empty texts have no runs and are left out; a null key is left out; repeated rows
count once (a key has one text); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .kernels import CountMin, U, mixed, powers, prefix_hash, sketch_bits, sketch_of, slabs, text_column

SHINGLE = 3
LEAST = 20
THRESHOLD = 0.6
#: Characters of text for each run that a sketch has to hold, at least.
RUN_CHARS = 4
BITS = 512
TILE = 4096
SMALL = 24
BROADCAST_ROWS = 500_000

_byte = np.zeros(256, dtype=bool)
_byte[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``size`` tokens of each text, sorted within it, and the offsets of the texts."""
    parts, counts = [], []
    for part in slabs(texts):
        raw = [texts[i].lower().encode("utf-8", "surrogatepass") for i in part]
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        word = _byte[data]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        begin, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        prefix = prefix_hash(data)
        tokens = mixed((prefix[stop] - prefix[begin]) * powers(len(prefix))[1][begin] + (stop - begin).astype(U))
        doc = np.searchsorted(ends, begin, "right")
        n = len(tokens) - size + 1
        if n <= 0:
            parts.append(np.zeros(0, dtype=U))
            counts.append(np.zeros(len(raw), dtype=np.int64))
            continue
        h = tokens[:n].copy()
        for j in range(1, size):
            h = mixed(h) * U(0x9E3779B97F4A7C15) + tokens[j : j + n]
        inside = doc[:n] == doc[size - 1 :]
        h, d = mixed(h[inside]), doc[:n][inside]
        by = np.lexsort((h, d))
        h, d = h[by], d[by]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, dtype=bool)
        parts.append(h[fresh])
        counts.append(np.bincount(d[fresh], minlength=len(raw)))
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.concatenate(counts) if counts else [], out=at[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U)), at


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(at.astype(np.int32), pa.array(flat.view(np.int64)))


def sets_of(rows: DataFrame, size: int, least: int) -> DataFrame:
    """key, hashes of the rows (key, t) with at least ``least`` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = shingle_sets(text_column(b, "t"), size)
            n = np.diff(at)
            keep = n >= least
            yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(keep)), _lists(flat[np.repeat(keep, n)], np.r_[0, np.cumsum(n[keep])])], ["key", "hashes"])

    return rows.select("key", "t").mapInArrow(run, "key BIGINT, hashes ARRAY<BIGINT>")


def parity_sketch(flat: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """One row of ``bits / 64`` words per set; bit ``h mod bits`` is the parity of the members on it."""
    count = np.bincount((np.repeat(np.arange(len(at) - 1), np.diff(at)) * bits + (flat % U(bits)).astype(np.int64)), minlength=(len(at) - 1) * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(at) - 1, bits), axis=1).view(U)


def block_keys(rows: DataFrame, size: int, least: int, threshold: float, sketch: CountMin) -> DataFrame:
    """key, cls BINARY, n, sketch BINARY, hashes: of each row its class (a hash of the set), size, parity sketch and block keys."""
    held, bits, depth = rows.sparkSession.sparkContext.broadcast(sketch.cells), sketch.bits, sketch.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = CountMin(bits, depth, held.value)
        for b in batches:
            flat, at = shingle_sets(text_column(b, "t"), size)
            n = np.diff(at)
            keep = n >= least
            flat, n = flat[np.repeat(keep, n)], n[keep]
            at = np.r_[0, np.cumsum(n)]
            if not len(n):
                continue
            doc, met = np.repeat(np.arange(len(n)), n), seen.estimate(flat)
            by = np.lexsort((flat, met, doc))
            first = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(flat)) - np.repeat(at[:-1], n)
            chosen = by[(place < np.repeat(first, n)) & (met[by] > 1)]
            cls = np.stack([np.add.reduceat(mixed(flat), at[:-1]), np.add.reduceat(mixed(flat + U(0x9E3779B97F4A7C15)), at[:-1])], axis=1)
            bitmap = [r.tobytes() for r in parity_sketch(flat, at, BITS)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key").filter(pa.array(keep)), pa.array([r.tobytes() for r in cls], pa.binary()), pa.array(n.astype(np.int32)), pa.array(bitmap, pa.binary()), _lists(flat[chosen], np.r_[0, np.cumsum(np.bincount(doc[chosen], minlength=len(n)))])],
                ["key", "cls", "n", "sketch", "hashes"],
            )

    return rows.select("key", "t").mapInArrow(run, "key BIGINT, cls BINARY, n INT, sketch BINARY, hashes ARRAY<BIGINT>")


def within_radius(sk: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a, b) of rows have sketches within the radius of the threshold."""
    radius = (1 - threshold) / (1 + threshold) * (n[a] + n[b]) + 1e-9
    return (np.abs(n[a] - n[b]) <= radius) & (np.bitwise_count(sk[a] ^ sk[b]).sum(axis=1) <= radius)


def compare_tiles(ids: np.ndarray, n: np.ndarray, sk: np.ndarray, side: np.ndarray, crossed: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids within the radius, tile by tile; if ``crossed``, only those of different ``side``."""
    by = np.argsort(n, kind="stable")
    ids, n, sk, side = ids[by], n[by], sk[by], side[by]
    rate, step = (1 - threshold) / (1 + threshold), 256
    for p in range(0, len(ids), step):
        for q in range(p, len(ids), step):
            a, b = slice(p, p + step), slice(q, q + step)
            if n[q] - n[min(p + step, len(n)) - 1] > rate * (n[q] + n[min(p + step, len(n)) - 1]):
                break  # sizes rise, so every later tile is beyond the radius as well
            far = np.zeros((len(ids[a]), len(ids[b])), dtype=np.int64)
            for w in range(sk.shape[1]):
                far += np.bitwise_count(sk[a, w][:, None] ^ sk[b, w][None, :])
            ok = far <= rate * (n[a][:, None] + n[b][None, :]) + 1e-9
            if crossed:
                ok &= side[a][:, None] != side[b][None, :]
            if p == q:
                ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
            x, y = np.nonzero(ok)
            if len(x):
                yield ids[a][x], ids[b][y]


def forest(ids: np.ndarray, n: np.ndarray, sk: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids within the radius: each row, by size, with those of the rows after it that no row before has taken."""
    rest, rate = np.argsort(n, kind="stable"), (1 - threshold) / (1 + threshold)
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        reach = int(np.searchsorted(n[rest], n[first] * (1 + rate) / (1 - rate) + 1e-6, "right"))
        near = np.zeros(len(rest), dtype=bool)
        near[:reach] = within_radius(sk, n, np.full(reach, first), rest[:reach], threshold)
        if near.any():
            yield np.full(near.sum(), ids[first]), ids[rest[near]]
            rest = rest[~near]


def compare_units(threshold: float, grouped: bool | None = None):
    """mapInArrow function over rows (unit, side, crossed, key, n, sketch) sorted by unit: pairs within the radius.

    With ``grouped`` False, large units give a forest only; with True, rows have a ``label`` and pairs of one label are left out.
    """

    def unit(rows: list[np.ndarray], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if grouped is None:
            yield from compare_tiles(rows[3][lo:hi], rows[4][lo:hi], rows[5][lo:hi], rows[1][lo:hi], bool(rows[2][lo]), threshold)
        elif not grouped:
            yield from forest(rows[3][lo:hi], rows[4][lo:hi], rows[5][lo:hi], threshold)
        elif (rows[6][lo:hi] != rows[6][lo]).any():
            yield from compare_tiles(rows[3][lo:hi], rows[4][lo:hi], rows[5][lo:hi], rows[6][lo:hi], True, threshold)

    def solve(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, side, crossed, ids, n, sk = rows[:6]
        begin = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        size = np.diff(np.r_[begin, len(key)])
        found = []
        # Small units all at once: each row against the row d places on.
        small = np.repeat(size <= SMALL, size)
        for d in range(1, min(SMALL, int(size[size <= SMALL].max(initial=0)))):
            a = np.nonzero(small[:-d] & (key[d:] == key[:-d]))[0]
            a = a[(crossed[a] == 0) | (side[a] != side[a + d])]
            if grouped:
                a = a[rows[6][a] != rows[6][a + d]]
            ok = within_radius(sk, n, a, a + d, threshold)
            found.append((ids[a[ok]], ids[a[ok] + d]))
        for lo, s in zip(begin[size > SMALL], size[size > SMALL], strict=True):
            found.extend(unit(rows, lo, lo + s))
        x, y = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        pairs = np.unique(np.stack([lo[lo != hi], hi[lo != hi]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=U).reshape(b.num_rows, -1)
            cols = [b.column(c).to_numpy() for c in ("unit", "side", "crossed", "key", "n")] + [sk] + ([b.column("label").to_numpy()] if grouped else [])
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last unit may go on; it has at most 2 * TILE rows
            done, rest = [c[:last] for c in cols], [c[last:] for c in cols]
            if last:
                a, z = solve(done)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])
        if rest is not None:
            a, z = solve(rest)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["a", "b"])

    return run


class _Near:
    """The classes of equal sets of some records, and the units in which they are compared."""

    def __init__(self, records: DataFrame, key: str, text: str, threshold: float, size: int, least: int):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        self.threshold, self.size, self.least = threshold, size, least
        self.rows = rows = records.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"))
        chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
        sketch = sketch_of(sets_of(rows, size, least), sketch_bits(chars // RUN_CHARS), 1)
        keyed = written(block_keys(rows, size, least, threshold, sketch), "blocks")
        # Of each class one row stands for all; the facts about it are small and joined only where a block has two classes.
        facts = keyed.groupBy("cls").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.members = keyed.select("key", "cls").distinct().join(facts.select("cls", "rep"), "cls").select("key", "rep")

        keys = keyed.select("cls", F.explode("hashes").alias("h")).repartition("h").distinct()
        shared = keys.join(keys.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "h").withColumn("tiles", F.ceil(F.col("c") / TILE).cast("int"))
        own = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
        placed = shared.select("cls", "h", "c", own.alias("side"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        units = placed.select("cls", "c", F.xxhash64("h", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), "side", (F.col("side") != F.col("other")).cast("int").alias("crossed"))
        self.tiles = units.join(facts, "cls").select("unit", "side", "crossed", F.col("rep").alias("key"), "n", "sketch", "c")

    def near(self, tiles: DataFrame, grouped: bool | None = None) -> DataFrame:
        """a < b: the pairs within the radius."""
        names = ["unit", "side", "crossed", "key", "n", "sketch", *(["label"] if grouped else [])]
        return written(tiles.select(*names).repartition("unit").sortWithinPartitions("unit").mapInArrow(compare_units(self.threshold, grouped), "a BIGINT, b BIGINT").distinct(), "near")

    def confirmed(self, near: DataFrame) -> DataFrame:
        """a < b, common, n_a, n_b, similarity: those of the pairs that are similar by their whole sets."""
        wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = self.rows.join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
        sets = written(sets_of(texts, self.size, self.least).dropDuplicates(["key"]), "sets")
        a, b = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
        common = near.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("n_a"), F.size("y").alias("n_b"))
        return common.withColumn("similarity", F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).filter(F.col("similarity") >= self.threshold - 1e-12)


def near_classes(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD, size: int = SHINGLE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members: key, rep), (links: a < b, common, n_a, n_b, similarity): classes of equal sets and the exact links of their reps."""
    found = _Near(records, key, text, threshold, size, least)
    return found.members, found.confirmed(found.near(found.tiles))


def near_pairs(records: DataFrame, key: str, file: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """chunk_a < chunk_b: the pairs of records of different files with similarity ``threshold`` or more.

    A null file counts as different from every other record's.
    """
    members, links = near_classes(records, key, text, threshold)
    links = written(links.select("a", "b"), "links")
    several = members.groupBy("rep").agg(F.count("*").alias("c")).filter("c > 1")
    links = links.unionByName(several.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    files = records.select(F.col(key).cast("bigint").alias("key"), F.col(file).alias("file")).dropDuplicates(["key"])
    placed = members.join(files, "key")
    ma = placed.select(F.col("rep").alias("a"), F.col("key").alias("ka"), F.col("file").alias("fa"))
    mb = placed.select(F.col("rep").alias("b"), F.col("key").alias("kb"), F.col("file").alias("fb"))
    out = links.join(ma, "a").join(mb, "b").filter("(fa <> fb OR fa IS NULL OR fb IS NULL) AND (a <> b OR ka < kb)")
    return out.select(F.least("ka", "kb").alias("chunk_a"), F.greatest("ka", "kb").alias("chunk_b"))


def connected(links: DataFrame) -> DataFrame:
    """v, l: each node of ``links`` (a, b) with the least node that it is connected with."""
    links = written(links.select("a", "b"), "links")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(edges.select(F.col("a").alias("v"), F.col("a").alias("l")).distinct(), "label")
    while True:  # ends: labels only fall, and each round at least halves the way to the least one
        least = edges.join(label, edges.b == label.v).groupBy("a").agg(F.min("l").alias("m"))
        lower = label.join(least, label.v == least.a).select("v", "l", F.least("l", "m").alias("m"))
        # Pointer jumping: also take the label of the label.
        up = label.select(F.col("v").alias("m"), F.col("l").alias("up"))
        step = written(lower.join(up, "m", "left").select("v", "l", F.least("m", F.coalesce("up", "m")).alias("n")), "step")
        changed = step.filter("n < l").limit(1).count()
        label = step.select("v", F.col("n").alias("l"))
        if not changed:
            return label


def near_groups(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """chunk_id, class_id: one row per record with enough runs; class_id is the least key of the records connected through
    links at or over the threshold.
    """
    found = _Near(records, key, text, threshold, SHINGLE, LEAST)
    tiles = written(found.tiles, "tiles")
    label = connected(found.confirmed(found.near(tiles, False)))
    # What the forests left open: pairs of different groups in large units.
    large = tiles.filter(F.col("c") > SMALL).join(label, F.col("key") == F.col("v"), "left").withColumn("label", F.coalesce("l", "key"))
    more = found.confirmed(found.near(large, True)).select("a", "b")
    label = connected(more.unionByName(label.filter("v <> l").select(F.col("l").alias("a"), F.col("v").alias("b"))))
    return found.members.join(label, F.col("rep") == F.col("v"), "left").select(F.col("key").alias("chunk_id"), F.coalesce("l", "rep").alias("class_id"))


def near_links(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """chunk_id, set_id, links: of each record with enough runs the least key of those with the same set, and with how many other sets that one is linked."""
    members, links = near_classes(records, key, text, threshold)
    links = written(links.select("a", "b"), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select(F.col("key").alias("chunk_id"), F.col("rep").alias("set_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
