"""What changed between full snapshots of a table of files.

A snapshot delivers every file of a buffer. The operator keeps an index of the last snapshot, bucketed by key
``(buffer_id, path)``, that maps a hash of the key to a hash of the contents. The rows of the next snapshot probe it;
old values are fetched for the changes only; then the new snapshot's index takes the place of the old one.

* :func:`snapshot_changes` takes a table with many snapshots of many buffers: the rows of a bucket pass one task in the
  order of snapshots, one exchange in all, and the index of a bucket is probed and swapped in memory. There are as many buckets
  as keep ``BUCKET_ROWS`` rows each on average, so no buffer is held by one task, however large it is.
* :class:`SnapshotIndex` keeps the bucketed index as a table between runs and takes one delivery at a time.

Defined results: rows whose path is null, blank or the root itself, or whose snapshot_seq is null, name no file
and are left out; a null buffer_id is a buffer of its own; a null loaded_at loses against any other; of rows that tie
in loaded_at the greatest (mtime, hash, size) counts, so repeated rows change nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

KEY = ["buffer_id", "path"]
CHANGES = "buffer_id STRING, path STRING, snapshot_seq INT, change STRING"
#: Rows of a bucket on average, over all its snapshots; a task holds two snapshots of one buffer's part of a bucket.
BUCKET_ROWS = 1_000_000


def normal_path(path: Column, root: Column) -> Column:
    """``path`` below ``root`` with single forward slashes and without ``./`` steps; letter case is kept."""

    def slashed(c: Column) -> Column:
        plain = F.trim(c)
        odd = plain.contains("\\") | plain.contains("//") | plain.contains("./")  # most paths need no pattern
        return F.when(odd, F.regexp_replace(F.regexp_replace(F.translate(plain, "\\", "/"), "/+", "/"), "(?<=/)(?:\\./)+", "")).otherwise(plain)

    p, r = slashed(path), F.rtrim(slashed(root), F.lit("/"))
    below = F.when(F.length(r) > 0, F.when(p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p)))).otherwise(None)
    return F.regexp_replace(F.coalesce(below, p), "^(?:\\./)+", "")


def normal_hash(digest: Column) -> Column:
    """``digest`` in lower case without the ``sha256:`` mark; blank counts as null."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), "^sha256:", "")
    return F.when(F.length(bare) > 0, bare)


def snapshot_rows(files: DataFrame) -> DataFrame:
    """buffer_id, path, snapshot_seq, loaded_at, mtime, hash, size with normal paths and hashes; rows that name no file are left out."""
    return files.select(
        F.col("buffer_id"),
        normal_path(F.col("path"), F.coalesce(F.col("root_path"), F.lit(""))).alias("path"),
        F.col("snapshot_seq").cast("int").alias("snapshot_seq"),
        F.col("loaded_at"),
        F.col("mtime"),
        normal_hash(F.col("hash")).alias("hash"),
        F.col("size").cast("bigint").alias("size"),
    ).filter("snapshot_seq IS NOT NULL AND length(path) > 0")


def nth_last(files: DataFrame, n: int = 1) -> DataFrame:
    """buffer_id, path, hash: the last delivered rows of the n-th last existing snapshot of each buffer."""
    w = Window.partitionBy("buffer_id").orderBy(F.desc("snapshot_seq"))
    seqs = files.select("buffer_id", F.col("snapshot_seq").cast("int").alias("snapshot_seq")).filter("snapshot_seq IS NOT NULL").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") == n)
    rows = snapshot_rows(files).join(seqs.select(F.col("buffer_id").alias("sb"), F.col("snapshot_seq").alias("ss")), F.col("buffer_id").eqNullSafe(F.col("sb")) & (F.col("snapshot_seq") == F.col("ss")))
    return rows.groupBy(*KEY).agg(F.max(F.struct("loaded_at", "mtime", "hash", "size")).alias("e")).select(*KEY, "e.hash")


def plain_hash() -> Column:
    """Hash of size and mtime, which decide where a digest is missing; nulls are values of their own."""
    return F.xxhash64(F.coalesce("size", F.lit(-1)), F.col("mtime").isNull(), F.col("mtime"))


def snapshot_order(files: DataFrame) -> DataFrame:
    """The existing snapshots of each buffer with their neighbours: buffer_id, snapshot_seq, before, after."""
    seqs = files.select("buffer_id", F.col("snapshot_seq").cast("int").alias("snapshot_seq")).filter("snapshot_seq IS NOT NULL").distinct()
    w = Window.partitionBy("buffer_id").orderBy("snapshot_seq")
    return seqs.select("buffer_id", "snapshot_seq", F.lag("snapshot_seq").over(w).alias("before"), F.lead("snapshot_seq").over(w).alias("after"))


class _Bucket:
    """The index of one buffer's last snapshot in one bucket: key hashes in order, content hashes, and the rows they stand for."""

    def __init__(self, rows: pa.RecordBatch):
        # Rows come sorted by path and delivery; the last row of each path counts.
        path = rows.column("path")
        last = np.r_[pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False), True] if len(path) else np.zeros(0, dtype=bool)
        self.rows = rows.filter(pa.array(last))
        self.paths = self.rows.column("path")
        self.seq, self.after = rows.column("snapshot_seq")[0].as_py(), rows.column("after")[0].as_py()
        key = self.rows.column("key").to_numpy()
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.twins = bool((self.keys[1:] == self.keys[:-1]).any())  # two paths of one hash: the paths themselves are the keys
        self.known = pc.is_valid(self.rows.column("digest")).to_numpy(zero_copy_only=False)
        self.digest = self.rows.column("digest").fill_null(0).to_numpy()
        self.plain = self.rows.column("plain").to_numpy()

    def probe(self, old: _Bucket) -> Iterator[tuple[str, pa.Array]]:
        """(change, paths) of this snapshot against the ``old`` index."""
        if not self.twins and not old.twins and len(old.keys):
            key = self.rows.column("key").to_numpy()
            at = np.minimum(np.searchsorted(old.keys, key), len(old.keys) - 1)
            hit, place = old.keys[at] == key, old.order[at]
        else:
            place = pc.index_in(self.paths, value_set=old.paths).fill_null(-1).to_numpy()
            hit = place >= 0
        if hit.any() and not pc.all(pc.equal(self.paths.filter(pa.array(hit)), old.paths.take(pa.array(place[hit])))).as_py():
            place = pc.index_in(self.paths, value_set=old.paths).fill_null(-1).to_numpy()
            hit = place >= 0
        here, there = np.nonzero(hit)[0], place[hit]
        both = self.known[here] & old.known[there]
        differs = np.where(both, self.digest[here] != old.digest[there], self.plain[here] != old.plain[there])
        gone = np.ones(len(old.paths), dtype=bool)
        gone[there] = False
        yield "added", self.paths.filter(pa.array(~hit))
        yield "changed", self.paths.take(pa.array(here[differs]))
        yield "removed", old.paths.filter(pa.array(gone))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of rows sorted by buffer, snapshot, path and delivery: each snapshot probes the index of the one before and takes its place."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    index: _Bucket | None = None
    owner = None

    def out(seq: int, found: Iterator[tuple[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for change, paths in found:
            n = len(paths)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([owner] * n, pa.string()), paths, pa.array(np.full(n, seq, dtype=np.int32)), pa.array([change] * n, pa.string())], ["buffer_id", "path", "snapshot_seq", "change"])

    def gone(old: _Bucket | None) -> Iterator[pa.RecordBatch]:
        """A bucket without rows in the next snapshot has lost all it had."""
        if old is not None and old.after is not None:
            yield from out(old.after, iter([("removed", old.paths)]))

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal index, owner
        new = _Bucket(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        before = held[0].column("before")[0].as_py()
        if index is not None and owner != at[0]:
            yield from gone(index)
            index = None
        owner = at[0]
        if index is not None and index.seq == before:
            yield from out(new.seq, new.probe(index))
        else:
            yield from gone(index)
            if before is not None:
                yield from out(new.seq, iter([("added", new.paths)]))
        index = new

    for b in batches:
        if not b.num_rows:
            continue
        seq, buffer = b.column("snapshot_seq").to_numpy(), b.column("buffer_id")
        same = pc.equal(buffer.slice(1), buffer.slice(0, b.num_rows - 1)).fill_null(False).to_numpy(zero_copy_only=False) | (pc.is_null(buffer.slice(1)).to_numpy(zero_copy_only=False) & pc.is_null(buffer.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False))
        cut = np.nonzero((seq[1:] != seq[:-1]) | ~same)[0] + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
            now = (buffer[int(lo)].as_py(), int(seq[lo]))
            if held and now != at:
                yield from close()
                held = []
            at = now
            held.append(b.slice(int(lo), int(hi - lo)))
    if held:
        yield from close()
        yield from gone(index)


def snapshot_changes(files: DataFrame) -> DataFrame:
    """Changes between all consecutive snapshots of each buffer: ``buffer_id, path, snapshot_seq, change``.

    ``files`` needs buffer_id, root_path, snapshot_seq, loaded_at, path, mtime, size and hash.
    """
    spark = files.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-files.select("snapshot_seq").count() // BUCKET_ROWS))
    # One row per snapshot; written, so that its size is known when the join is planned and a small one is broadcast.
    order = written(snapshot_order(files).select(F.col("buffer_id").alias("o_buffer"), F.col("snapshot_seq").alias("o_seq"), "before", "after"), "order")
    rows = snapshot_rows(files)
    rows = rows.join(order, rows.buffer_id.eqNullSafe(order.o_buffer) & (rows.snapshot_seq == order.o_seq))
    sorted_ = rows.repartition(buckets, *KEY).sortWithinPartitions("buffer_id", "snapshot_seq", "path", "loaded_at", "mtime", "hash", "size")
    return sorted_.select("buffer_id", "snapshot_seq", "before", "after", "path", F.xxhash64("path").alias("key"), F.when(F.col("hash").isNotNull(), F.xxhash64("hash")).alias("digest"), plain_hash().alias("plain")).mapInArrow(_sweep, CHANGES)


class SnapshotIndex:
    """A bucketed index of the last snapshot of each buffer, kept in a folder between runs.

    ``index`` maps 128 bits of hash of the key to a hash of the digest and one of size and mtime; ``values`` has the rows
    themselves. Both lie in folders by buffer and bucket. ``probe`` compares a delivery (full snapshots of some buffers, one
    each) with the index, reading the buffers delivered only, and fetches old values for changes only, from the buckets that
    have any. ``swap`` makes the delivery the index of its buffers; the folders of all others stay as they are.
    """

    PARTS = ["b", "bucket"]

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, listed: int = 10_000):
        self.spark, self.folder, self.buckets, self.listed = spark, folder.rstrip("/"), buckets, listed

    def _keyed(self, delivery: DataFrame) -> DataFrame:
        """The last delivered row of each key, with the folder and key of the index."""
        last = snapshot_rows(delivery).groupBy(*KEY, "snapshot_seq").agg(F.max(F.struct("loaded_at", "mtime", "hash", "size")).alias("e")).select(*KEY, "snapshot_seq", "e.mtime", "e.hash", "e.size")
        h1, h2 = F.xxhash64("path"), F.xxhash64(F.lit(1), F.col("path"))
        return last.select(
            F.sha1(F.concat(F.when(F.col("buffer_id").isNull(), "n").otherwise("b"), F.coalesce("buffer_id", F.lit("")))).alias("b"), F.pmod(h1, F.lit(self.buckets)).cast("int").alias("bucket"), h1.alias("h1"), h2.alias("h2"),
            F.when(F.col("hash").isNotNull(), F.xxhash64("hash")).alias("digest"), plain_hash().alias("plain"), "buffer_id", "path", "snapshot_seq", "mtime", "hash", "size",
        )

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # before the first swap
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The index: b, bucket, h1, h2, digest, plain; empty before the first swap."""
        return self._table("index", "h1 BIGINT, h2 BIGINT, digest BIGINT, plain BIGINT, b STRING, bucket INT")

    def values(self) -> DataFrame:
        """The rows that the index stands for."""
        return self._table("values", "h1 BIGINT, h2 BIGINT, buffer_id STRING, path STRING, snapshot_seq INT, mtime TIMESTAMP, hash STRING, size BIGINT, b STRING, bucket INT")

    def _only(self, rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
        """``rows`` of the folders in ``keys``: up to ``listed`` of them are named in the filter, so that others aren't even listed."""
        few = keys.select(*by).distinct().limit(self.listed + 1).collect()
        if len(few) > self.listed:
            return rows.join(keys.select(*by).distinct(), by, "left_semi")
        for name in by:
            rows = rows.filter(F.col(name).isin(sorted({r[name] for r in few})))
        return rows

    def probe(self, delivery: DataFrame) -> DataFrame:
        """Changes of ``delivery`` against the index with old and new values; buffers that the index doesn't know give no rows.

        buffer_id, path, snapshot_seq, change, old_hash, old_size, new_hash, new_size.
        """
        new = written(self._keyed(delivery), "delivery")
        keys = [*self.PARTS, "h1", "h2"]
        old = self._only(self.entries(), new, ["b"]).select(*keys, F.col("digest").alias("was"), F.col("plain").alias("was_plain"), F.lit(True).alias("there"))
        seqs = new.groupBy("b").agg(F.max("snapshot_seq").alias("seq"))
        known = old.select("b").distinct()
        both = new.select(*keys, "digest", "plain", F.lit(True).alias("here")).join(old, keys, "full_outer")
        differs = F.when(F.col("digest").isNotNull() & F.col("was").isNotNull(), F.col("digest") != F.col("was")).otherwise(F.col("plain") != F.col("was_plain"))
        change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(differs, "changed")
        changes = written(both.select(*keys, change.alias("change")).filter("change IS NOT NULL").join(known, "b", "left_semi"), "changes")
        before = self._only(self.values(), changes.filter("change <> 'added'"), self.PARTS).select(*keys, F.col("buffer_id").alias("ob"), F.col("path").alias("op"), F.col("hash").alias("old_hash"), F.col("size").alias("old_size"))
        now = new.select(*keys, "buffer_id", "path", F.col("hash").alias("new_hash"), F.col("size").alias("new_size"))
        out = changes.join(before, keys, "left").join(now, keys, "left").join(seqs, "b")
        return out.select(F.when(F.col("op").isNull(), F.col("buffer_id")).otherwise(F.col("ob")).alias("buffer_id"), F.coalesce("path", "op").alias("path"), F.col("seq").alias("snapshot_seq"), "change", "old_hash", "old_size", "new_hash", "new_size")

    def swap(self, delivery: DataFrame) -> None:
        """Make ``delivery`` the last snapshot of its buffers: their folders are written anew, all others stay."""
        new = written(self._keyed(delivery), "delivery")
        buffers = [r[0] for r in new.select("b").distinct().collect()]  # names of the buffers delivered
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for name, columns in (("values", self.values().columns), ("index", self.entries().columns)):
            # Buckets that the new snapshot doesn't fill must not keep rows of the old one.
            staged = f"{self.folder}/staged-{name}"
            new.select(*columns).repartition(*self.PARTS).write.mode("overwrite").partitionBy(*self.PARTS).parquet(staged)
            fs = jvm.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.mkdirs(jvm.Path(f"{self.folder}/{name}"))
            for b in buffers:
                fs.delete(jvm.Path(f"{self.folder}/{name}/b={b}"), True)
                fs.rename(jvm.Path(f"{staged}/b={b}"), jvm.Path(f"{self.folder}/{name}/b={b}"))
            fs.delete(jvm.Path(staged), True)
