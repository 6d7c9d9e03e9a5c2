"""Long exact spans shared between records.

Any common span of at least ``length`` code points holds a whole window of ``length - ANCHOR + 1`` consecutive
``ANCHOR``-grams, and both records pick the same smallest of them (winnowing), so comparing the picked anchors
loses no span. Anchors are written once and then handled in two passes:

1. each partition fills a count-min sketch of its anchors (one count per record), and the sketches are merged;
   estimates are never too low, so an anchor estimated at one occurs in one record only;
2. only anchors estimated as repeated are exchanged and grouped exactly.

Records with equal text form a class (128 bits of hash), of which one stands for all in both passes.

* :func:`span_pairs` names pairs: classes that share an anchor are confirmed on their texts. Groups of one anchor are never
  gathered: they are an equi-join of class ids that is split where an anchor is hot.
* :func:`shared_share` needs no pairs, so a text that n records share costs n rows: the windows of ``length`` around repeated
  anchors go through a second sketch, and those estimated as repeated are grouped exactly by hash; a window met
  in two files is shared, and what such windows cover is the share of their record.

A sketch's size is taken from the number of hashes it has to hold, up to 32 MB; from about a million of them per MB on,
fewer are dropped and more are exchanged, with the same result.

Defined results: null and empty texts share nothing; repeated rows of one id count once; ids without a file
(null file_id) each count as a file of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .kernels import CountMin, U, code_points, prefix_hash, sketch_bits, sketch_of, slabs, sliding, text_column, window_hash

LENGTH = 160
ANCHOR = 96
#: A side is broadcast only after a count shows that it has no more rows than this (16 bytes each).
BROADCAST_ROWS = 500_000


def anchor_places(texts: list[str], length: int, anchor: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the hashes of the anchors that winnowing picks, their places, and the hashes of all windows of ``length``; none for texts under ``length``."""
    none = np.zeros(0, dtype=U)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, np.zeros(0, dtype=np.int64), none)] * len(texts)
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    w = length - anchor + 1
    for part in slabs([texts[i] for i in long]):
        ids = [long[j] for j in part]
        points, at = code_points([texts[i] for i in ids])
        prefix = prefix_hash(points)
        h, whole = window_hash(prefix, anchor), window_hash(prefix, length)
        # Windows over a border between texts are switched off by the greatest value; no real window lies in them alone.
        top = U(0xFFFFFFFFFFFFFFFF)
        for b in at[1:-1]:
            h[max(0, b - anchor + 1) : b] = top
        low = sliding(h, w, np.minimum)
        padded = np.concatenate([np.zeros(w - 1, dtype=U), low, np.zeros(w - 1, dtype=U)])
        # Minima of windows over a border would only add picks; they belong to no common span, so they are left out.
        starts = np.zeros(len(low), dtype=bool)
        for a, b in zip(at[:-1], at[1:], strict=True):
            starts[a : max(a, b - length + 1)] = True
        padded[w - 1 : w - 1 + len(low)][~starts] = 0
        picked = np.nonzero(sliding(padded, w, np.maximum) == h)[0]
        cut = np.searchsorted(picked, at)
        for j, i in enumerate(ids):
            own = picked[cut[j] : cut[j + 1]]
            out[i] = (h[own], own - at[j], whole[at[j] : at[j + 1] - length + 1])
    return out


def picked_anchors(texts: list[str], length: int, anchor: int) -> list[np.ndarray]:
    """For each text the distinct hashes of the anchors that winnowing picks; none for texts under ``length``."""
    return [np.unique(h) for h, _, _ in anchor_places(texts, length, anchor)]


def _records(records: DataFrame, key: str, file: str, text: str, length: int) -> DataFrame:
    """key, file, cls, t of the records of at least ``length`` code points; equal texts have equal ``cls``."""
    own = F.coalesce(F.col(file).cast("string"), F.concat(F.lit("?"), F.col(key).cast("string")))
    return records.filter((F.length(text) >= length) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.xxhash64(own).alias("file"), F.unhex(F.md5(F.col(text))).alias("cls"), F.col(text).alias("t")
    )


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    at = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(f) for f in found], out=at[1:])
    return pa.ListArray.from_arrays(at, pa.array((np.concatenate(found) if found else np.zeros(0, dtype=U)).view(np.int64)))


def _anchor_rows(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """file, cls, hashes: the distinct anchors of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("cls"), _lists(picked_anchors(text_column(b, "t"), length, anchor))], ["file", "cls", "hashes"])

    return rows.select("file", "cls", "t").mapInArrow(run, "file BIGINT, cls BINARY, hashes ARRAY<BIGINT>")


def _once_per_run(rows: DataFrame) -> DataFrame:
    """hashes: those of runs of records of one file, each hash once per run; records of a file lie together and overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            file, lists = b.column("file").to_numpy(), b.column("hashes")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            begin = np.nonzero(np.r_[True, file[1:] != file[:-1]])[0] if len(file) else np.zeros(0, dtype=np.int64)
            found = [np.unique(flat[at[a] : at[z]]).view(U) for a, z in zip(begin, [*begin[1:], len(file)], strict=True)]
            yield pa.RecordBatch.from_arrays([_lists(found)], ["hashes"])

    return rows.select("file", "hashes").mapInArrow(run, "hashes ARRAY<BIGINT>")


def _met(rows: DataFrame, sketch: CountMin, least: int) -> DataFrame:
    """``rows`` (with hashes) with those of their hashes only that are estimated as met ``least`` times."""
    held, bits = rows.sparkSession.sparkContext.broadcast(sketch.cells), sketch.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = CountMin(bits, 1, held.value)
        for b in batches:
            lists = b.column("hashes")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()[: lists.offsets[-1].as_py()]
            keep = seen.estimate(flat.view(U)) >= least
            upto = np.r_[0, np.cumsum(keep)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "hashes"), pa.ListArray.from_arrays(upto[at], pa.array(flat[keep]))], [*(c for c in b.schema.names if c != "hashes"), "hashes"])

    rest = [c for c in rows.columns if c != "hashes"]
    return rows.select(*rest, "hashes").mapInArrow(run, rows.select(*rest, "hashes").schema)


def _anchors(rows: DataFrame, length: int, anchor: int) -> tuple[DataFrame, CountMin]:
    """The anchors of all records, written once, and their sketch of the size they need."""
    anchors = written(_anchor_rows(rows, length, anchor), "anchors")
    n = anchors.agg(F.sum(F.size("hashes"))).first()[0] or 0
    return anchors, sketch_of(_once_per_run(anchors), sketch_bits(n), 1, 2)


def shared_spans(a: str, b: str, length: int) -> list[tuple[int, int, int]]:
    """The maximal common runs of at least ``length`` as (begin in a, begin in b, size); empty if there are none."""
    pa_, pb = code_points([a])[0], code_points([b])[0]
    ha, hb = window_hash(prefix_hash(pa_), length), window_hash(prefix_hash(pb), length)
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    hit = np.nonzero(hi > lo)[0]
    if not len(hit):
        return []
    n = (hi - lo)[hit]
    x = np.repeat(hit, n)
    y = order[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    # Windows on one diagonal that follow each other make one run.
    by = np.lexsort((x, x - y))
    x, y = x[by], y[by]
    first = np.r_[True, (np.diff(x - y) != 0) | (np.diff(x) != 1)]
    begin = np.nonzero(first)[0]
    end = np.r_[begin[1:], len(x)] - 1
    runs = [(int(x[i]), int(y[i]), int(x[j] - x[i] + length)) for i, j in zip(begin, end, strict=True)]
    return [r for r in runs if a[r[0] : r[0] + r[2]] == b[r[1] : r[1] + r[2]]]


def class_spans(records: DataFrame, key: str, file: str, text: str, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Members (key, file, cls) and links (cls_a < cls_b, spans ARRAY<STRUCT<a, b, size>>) of the classes of equal text."""
    if not 0 < anchor <= length:
        raise ValueError("anchor must lie between 1 and length")
    rows = _records(records, key, file, text, length)
    anchors, sketch = _anchors(rows, length, anchor)
    # Exact grouping of what the sketch let through: anchors of two or more files. Only those are then exchanged with their classes.
    by_file = _met(anchors.select("file", "hashes"), sketch, 2).select("file", F.explode("hashes").alias("h"))
    shared = written(by_file.groupBy("h").agg(F.min("file").alias("f1"), F.max("file").alias("f2")).filter("f1 <> f2").select("h"), "shared")
    known = sketch_of(shared.select(F.array("h").alias("hashes")), sketch_bits(shared.count(), 16), 1, 1)
    kept = written(_met(anchors.select("cls", "hashes"), known, 1).select("cls", F.explode("hashes").alias("h")).join(shared, "h", "left_semi").select("h", "cls").distinct(), "kept")
    a, b = kept.select("h", F.col("cls").alias("cls_a")), kept.select("h", F.col("cls").alias("cls_b"))
    pairs = written(a.join(b, "h").filter("cls_a < cls_b").select("cls_a", "cls_b").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "cls", "left_semi").select("cls", "t").dropDuplicates(["cls"])
    both = pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("t").alias("ta")), "cls_a").join(texts.select(F.col("cls").alias("cls_b"), F.col("t").alias("tb")), "cls_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("size", pa.int32())]))
        for x in batches:
            found = [shared_spans(ta, tb, length) for ta, tb in zip(x.column("ta").to_pylist(), x.column("tb").to_pylist(), strict=True)]
            keep = [i for i, f in enumerate(found) if f]
            if keep:
                spans = pa.array([[{"a": p, "b": q, "size": n} for p, q, n in found[i]] for i in keep], kind)
                yield pa.RecordBatch.from_arrays([x.column("cls_a").take(pa.array(keep)), x.column("cls_b").take(pa.array(keep)), spans], ["cls_a", "cls_b", "spans"])

    links = both.select("cls_a", "cls_b", "ta", "tb").mapInArrow(confirm, "cls_a BINARY, cls_b BINARY, spans ARRAY<STRUCT<a: INT, b: INT, size: INT>>")
    return rows.select("key", "file", "cls").distinct(), links


def span_pairs(records: DataFrame, key: str, file: str, text: str, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """chunk_a < chunk_b: every pair of records of different files that share a span of at least ``length``."""
    members, links = class_spans(records, key, file, text, length, anchor)
    links = links.select("cls_a", "cls_b")
    several = members.groupBy("cls").agg(F.min("file").alias("f1"), F.max("file").alias("f2")).filter("f1 <> f2")
    # A class of several files is linked with itself: its texts are equal.
    links = written(links.unionByName(several.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))), "links")
    ma = members.select(F.col("cls").alias("cls_a"), F.col("key").alias("ka"), F.col("file").alias("fa"))
    mb = members.select(F.col("cls").alias("cls_b"), F.col("key").alias("kb"), F.col("file").alias("fb"))
    out = links.join(ma, "cls_a").join(mb, "cls_b").filter("fa <> fb AND (cls_a <> cls_b OR ka < kb)")
    return out.select(F.least("ka", "kb").alias("chunk_a"), F.greatest("ka", "kb").alias("chunk_b"))


def _window_rows(rows: DataFrame, length: int, anchor: int, anchors: CountMin, windows: CountMin | None) -> DataFrame:
    """The windows of each record that hold an anchor estimated as repeated.

    Without ``windows`` as (file, hashes); with it, those that it estimates as repeated, as (key, f1, f2, at, h).
    """
    sc = rows.sparkSession.sparkContext
    held = [(sc.broadcast(c.cells), c.bits) for c in (anchors, windows) if c is not None]
    w = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [CountMin(bits, 1, cells.value) for cells, bits in held]
        for b in batches:
            found, places = [], []
            for h, at, whole in anchor_places(text_column(b, "t"), length, anchor):
                at = at[seen[0].estimate(h) > 1]
                # An anchor at p lies in the windows that begin from p - w to p.
                edge = np.zeros(len(whole) + 1, dtype=np.int64)
                np.add.at(edge, np.clip(at - w, 0, len(whole)), 1)
                np.add.at(edge, np.clip(at + 1, 0, len(whole)), -1)
                place = np.nonzero(np.cumsum(edge[:-1]))[0]
                if len(seen) > 1:
                    place = place[seen[1].estimate(whole[place]) > 1]
                places.append(place)
                found.append(whole[place])
            if len(seen) == 1:
                yield pa.RecordBatch.from_arrays([b.column("file"), _lists([np.unique(f) for f in found])], ["file", "hashes"])
                continue
            some = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = np.concatenate(found) if found else np.zeros(0, dtype=U)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(some) for c in ("key", "f1", "f2")), pa.array((np.concatenate(places) if places else np.zeros(0)).astype(np.int32)), pa.array(flat.view(np.int64))], ["key", "f1", "f2", "at", "h"])

    if windows is None:
        return rows.select("file", "t").mapInArrow(run, "file BIGINT, hashes ARRAY<BIGINT>")
    return rows.select("key", "f1", "f2", "t").mapInArrow(run, "key BIGINT, f1 BIGINT, f2 BIGINT, at INT, h BIGINT")


def shared_share(records: DataFrame, key: str, file: str, text: str, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """chunk_id, n_chars, shared_chars, share: how much of each record lies in spans shared with other files.

    One row per record with a key. Of a class of equal texts one record stands for all. null texts have n_chars 0 and share 0.
    """
    if not 0 < anchor <= length:
        raise ValueError("anchor must lie between 1 and length")
    rows = _records(records, key, file, text, length)
    members = written(rows.select("key", "file", "cls").distinct(), "members")
    classes = members.groupBy("cls").agg(F.min("key").alias("rep"), F.min("file").alias("f1"), F.max("file").alias("f2"), F.count("*").alias("c"))
    # Most records are alone with their text; what has to be joined with the texts are the others.
    several = written(members.join(classes.filter("c > 1"), "cls").select("key", "rep", "f1", "f2"), "several")
    anchors = _anchors(rows, length, anchor)[1]
    own = rows.join(several.select("key", "rep", F.col("f1").alias("g1"), F.col("f2").alias("g2")), "key", "left").filter("rep IS NULL OR rep = key")
    own = own.select("key", "t", F.coalesce("g1", "file").alias("f1"), F.coalesce("g2", "file").alias("f2"))
    files = _window_rows(rows, length, anchor, anchors, None)
    n = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    windows = sketch_of(_once_per_run(files), sketch_bits(n // 2), 1, 2)
    met = written(_window_rows(own, length, anchor, anchors, windows).dropDuplicates(["key", "at"]), "windows")
    shared = met.groupBy("h").agg(F.min("f1").alias("f1"), F.max("f2").alias("f2")).filter("f1 <> f2").select("h")
    begins = met.join(shared, "h", "left_semi").select("key", "at")
    # A window adds its last character, and the first of a run the others.
    covered = begins.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("at"))  # places in one text
    total = covered.select("key", F.aggregate("at", F.struct(F.lit(-length).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(x - s["last"], F.lit(length))).alias("n")), lambda s: s["n"]).alias("shared_chars"))
    every = several.filter("f1 <> f2").select("key", F.lit(True).alias("whole"))
    rep = several.select("key", "rep")
    size = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    out = size.join(rep.dropDuplicates(["key"]), "key", "left").withColumn("rep", F.coalesce("rep", "key")).join(total.withColumnRenamed("key", "rep"), "rep", "left").join(every.dropDuplicates(["key"]), "key", "left")
    shared_chars = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0))).cast("bigint")
    return out.select(F.col("key").alias("chunk_id"), "n_chars", shared_chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared_chars / F.col("n_chars")).otherwise(0.0).alias("share"))
