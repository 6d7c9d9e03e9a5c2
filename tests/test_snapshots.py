"""Changes between snapshots: rules, edge cases and the index kept between runs."""

import datetime as dt

from chunkwright.operators.snapshots import SnapshotIndex, snapshot_changes

SCHEMA = "buffer_id STRING, root_path STRING, snapshot_seq INT, created_at TIMESTAMP, loaded_at TIMESTAMP, path STRING, mtime TIMESTAMP, size BIGINT, hash STRING, lines INT"
T0 = dt.datetime(2025, 1, 1)


def row(seq, path, digest="aa", at=0, buf="b", size=1, mtime=T0, root="/srv/r"):
    return (buf, root, seq, T0, T0 + dt.timedelta(seconds=at) if at is not None else None, path, mtime, size, digest, 1)


def changes(spark, rows):
    return sorted((r.buffer_id or "", r.path, r.snapshot_seq, r.change) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect())


def test_rules(spark):
    rows = [
        row(1, "a"), row(1, "./b"), row(1, "c//d", "SHA256:FF"), row(1, "e", None), row(1, "x\\y"),
        row(4, "/srv/r/a", "AA", mtime=T0 + dt.timedelta(days=1)), row(4, "c/d", "ff"), row(4, "e", None, size=2), row(4, "x/./y", "bb"), row(4, "B"),
    ]
    assert changes(spark, rows) == [("b", "B", 4, "added"), ("b", "b", 4, "removed"), ("b", "e", 4, "changed"), ("b", "x/y", 4, "changed")]


def test_last_delivery_counts_and_ties(spark):
    rows = [row(1, "a"), row(2, "a", "zz", 1), row(2, "a", "aa", 5), row(2, "a", "aa", 5), row(2, "a", "qq", None)]
    assert changes(spark, rows) == []


def test_nulls_and_empty(spark):
    assert changes(spark, []) == []
    rows = [row(1, None), row(1, ""), row(None, "a"), row(1, "a", buf=None), row(2, "a", "bb", buf=None), row(1, "k", None), row(2, "k", "cc")]
    assert changes(spark, rows) == [("", "a", 2, "changed")]  # k has no hash on one side but equal size and time
    twice = [row(1, "a"), row(2, "b")] * 3
    assert changes(spark, twice) == [("b", "a", 2, "removed"), ("b", "b", 2, "added")]


def test_extra_columns(spark):
    df = spark.createDataFrame([row(1, "a"), row(2, "b")], SCHEMA).selectExpr("*", "'x' AS entry", "'y' AS change", "1 AS before", "2 AS o_seq")
    assert snapshot_changes(df).count() == 2


def test_index_between_runs(spark, tmp_path):
    index = SnapshotIndex(spark, f"file://{tmp_path}/index", 4)
    first = spark.createDataFrame([row(1, "a"), row(1, "b"), row(7, "q", buf="other")], SCHEMA)
    assert index.probe(first).count() == 0
    index.swap(first)
    second = spark.createDataFrame([row(3, "a", "bb"), row(3, "c")], SCHEMA)
    assert sorted((r.path, r.snapshot_seq, r.change) for r in index.probe(second).collect()) == [("a", 3, "changed"), ("b", 3, "removed"), ("c", 3, "added")]
    index.swap(second)
    assert index.probe(second).count() == 0
    assert index.values().filter("buffer_id = 'other'").count() == 1 and index.entries().count() == 3


def test_index_reads_delivered_buffers_only(spark, tmp_path):
    index = SnapshotIndex(spark, f"file://{tmp_path}/index", 2)
    index.swap(spark.createDataFrame([row(1, f"f{i}", buf=b) for b in ("x", "y", None) for i in range(5)], SCHEMA))
    found = index.probe(spark.createDataFrame([row(2, f"f{i}", "zz" if i == 3 else "aa", buf=None) for i in range(4)], SCHEMA))
    assert sorted((r.buffer_id, r.path, r.change, r.old_hash, r.new_hash) for r in found.collect()) == [(None, "f3", "changed", "aa", "zz"), (None, "f4", "removed", "aa", None)]
    entries = index._only(index.entries(), index._keyed(spark.createDataFrame([row(2, "f1", buf="x")], SCHEMA)), ["b"])
    assert len(entries.inputFiles()) > len({r.b for r in entries.select("b").distinct().collect()}) == 1 and entries.count() == 5


def test_buckets_without_rows_and_equal_hashes(spark, monkeypatch):
    import pyarrow as pa

    from chunkwright.operators import snapshots

    # Every path in its own bucket at most: snapshot 2 has no row in most of them.
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 1)
    rows = [row(1, f"f{i}") for i in range(20)] + [row(2, "f0")] + [row(5, f"f{i}") for i in range(10)]
    wanted = [("b", f"f{i}", 2, "removed") for i in range(1, 20)] + [("b", f"f{i}", 5, "added") for i in range(1, 10)]
    assert changes(spark, rows) == sorted(wanted, key=lambda r: (r[0], r[1], r[2], r[3]))
    # Paths whose key hashes are equal are told apart by themselves.
    batch = lambda seq, paths, digest: pa.RecordBatch.from_pydict({"buffer_id": ["b"] * len(paths), "snapshot_seq": pa.array([seq] * len(paths), pa.int32()), "before": pa.array([seq - 1 or None] * len(paths), pa.int32()), "after": pa.array([2 if seq == 1 else None] * len(paths), pa.int32()), "path": paths, "key": pa.array([7] * len(paths), pa.int64()), "digest": pa.array(digest, pa.int64()), "plain": pa.array([0] * len(paths), pa.int64())})
    got = [r for b in snapshots._sweep(iter([batch(1, ["a", "b"], [1, 2]), batch(2, ["b", "c"], [3, 4])])) for r in b.to_pylist()]
    assert sorted((r["path"], r["change"]) for r in got) == [("a", "removed"), ("b", "changed"), ("c", "added")]
    one = [r for b in snapshots._sweep(iter([batch(1, ["a"], [1]), batch(2, ["c"], [1])])) for r in b.to_pylist()]
    assert sorted((r["path"], r["change"]) for r in one) == [("a", "removed"), ("c", "added")]
