"""Streams: files that change, incremental chunk tables, rate limits and nearest-cluster assignment."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..sources.code import definition_chunks


def watched_files(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """A stream of the files that come into ``folder`` or change there: path, mtime, size, content."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    raw = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def keep_chunks(files: DataFrame, target: str, checkpoint: str, pause: str | None = None, encode=None):
    """Write the chunks of a stream of files into ``target``, replacing those of files that come again.

    With ``encode`` (rows, key, text), which gives key and embedding, chunks are embedded as they come; those that stay keep their embeddings.

    Chunks lie in partitions by a hash of the path; of those only the touched ones are read and written again. ``pause``
    is the time between batches, which gathers quick changes; without it what is there is taken once.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content", "mtime").alias("content"))
        new = definition_chunks(last, "path", "path", "content").withColumn("part", F.pmod(F.xxhash64("path"), F.lit(64)).cast("int"))
        if encode is not None:
            new = new.withColumn("chunk", F.xxhash64("path", "start_line", "end_line", "type", F.coalesce("name", F.lit(""))))
            new = new.join(encode(new, "chunk", "text"), "chunk", "left").drop("chunk")
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(target)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        if old is not None:
            touched = last.select(F.pmod(F.xxhash64("path"), F.lit(64)).cast("int").alias("part")).distinct()
            kept = old.join(touched, "part", "left_semi").join(last.select("path"), "path", "left_anti")
            new = new.unionByName(kept.select(*new.columns))
        staged = f"{target}-staged/{number}"
        new.write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)

    out = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=pause) if pause else out.trigger(availableNow=True)).start()


def drop_deleted(spark: SparkSession, target: str, present: DataFrame) -> int:
    """Take the chunks of files that aren't among ``present`` (path) any more out of ``target``; gives how many files went.

    Only the partitions that hold chunks of such files are written again.
    """
    old = spark.read.parquet(target)
    gone = old.select("path", "part").distinct().join(present.select("path").distinct(), "path", "left_anti")
    parts = [r[0] for r in gone.select("part").distinct().collect()]  # 64 at most
    n = gone.count()
    if n:
        staged = f"{target}-staged/deleted"
        kept = old.filter(F.col("part").isin(parts)).join(gone.select("path"), "path", "left_anti").select(*old.columns)
        kept.write.mode("overwrite").parquet(staged)
        kept = spark.read.schema(old.schema).parquet(staged)
        left = {r[0] for r in kept.select("part").distinct().collect()}
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)
        jvm = spark._jvm.org.apache.hadoop.fs
        for part in set(parts) - left:  # a partition that lost all its rows isn't overwritten by none
            path = jvm.Path(f"{target}/part={part}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


class Progress(StreamingQueryListener):
    """Tells ``told`` (phase, query, batch, rows) when a query begins, after each of its batches and when it ends."""

    def __init__(self, told):
        self.told = told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.told("started", str(event.id), -1, 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.told("batch", str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.told("idle", str(event.id), -1, 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.told("failed" if event.exception else "ended", str(event.id), -1, 0)


class TokenBucket(StatefulProcessor):
    """Per key a bucket of ``capacity`` tokens, refilled at ``rate`` a second of event time; a request takes one."""

    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate = capacity, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens DOUBLE, at DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        held = self.state.get() if self.state.exists() else None
        tokens, at = (held[0], held[1]) if held else (self.capacity, None)
        for b in rows:
            out = []
            for t in sorted(b["ts"]):
                if at is not None:
                    tokens = min(self.capacity, tokens + max(0.0, t - at) * self.rate)
                at = t if at is None else max(at, t)
                ok = tokens >= 1
                tokens -= ok
                out.append((key[0], t, bool(ok)))
            yield pd.DataFrame(out, columns=["user_id", "ts", "allowed"])
        if at is not None:
            self.state.update((tokens, at))

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """user_id, ts, allowed: each request of a stream (user_id, ts) and whether its user's bucket had a token."""
    return requests.groupBy("user_id").transformWithStateInPandas(TokenBucket(capacity, rate), "user_id STRING, ts DOUBLE, allowed BOOLEAN", "Append", "none")


def assigned_clusters(vectors: DataFrame, threshold: float = 0.88, most: int = 200) -> DataFrame:
    """part, id, cluster: in the order of ids each vector joins the nearest cluster of its part if the cosine to its first
    member is at least ``threshold``, else it opens one; of more than ``most`` clusters the one not used longest goes."""
    import numpy as np
    import pandas as pd

    def sweep(batches):
        part, held = None, {}
        for b in batches:
            out = []
            for p, i, v in zip(b["part"], b["id"], b["v"], strict=True):
                if p != part:
                    part, held = p, {}
                v = np.asarray(v, dtype=float)
                v = v / (np.linalg.norm(v) + 1e-10)
                best, near = None, -2.0
                for c, w in held.items():
                    s = float(v @ w)
                    if s > near:
                        best, near = c, s
                if best is None or near < threshold:
                    best = i
                    held[i] = v
                    if len(held) > most:
                        held.pop(next(iter(held)))
                else:
                    held[best] = held.pop(best)  # used last
                out.append((p, i, best))
            yield pd.DataFrame(out, columns=["part", "id", "cluster"])

    return vectors.filter("v IS NOT NULL").repartition("part").sortWithinPartitions("part", "id").mapInPandas(sweep, "part STRING, id BIGINT, cluster BIGINT")
