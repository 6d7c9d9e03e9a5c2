"""Tables kept between runs: a catalog of buffers, chunk, vector and lexical tables, file summaries, and exported git output.

Tables of many buffers lie in folders by buffer, so writing some buffers leaves all others as they are. Small tables are replaced as a
whole: written beside the old one and then renamed, so that a lost run leaves the old one in force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import TRANSITIONS
from ..operators.search import B, K1, best, postings
from ..functions.text import tokens

BUFFER = "buffer_id STRING, root_path STRING, state STRING, file_count INT, chunk_count INT"


def replaced(df: DataFrame, path: str, tries: int = 5) -> None:
    """``df`` as the table at ``path``, in place of what is there; the rename is tried again a few times."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    staged = f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for left in range(tries - 1, -1, -1):
        fs.delete(jvm.Path(path), True)
        if fs.rename(jvm.Path(staged), jvm.Path(path)):
            return
        if not left:
            raise OSError(f"{path} can't be replaced; the new table is at {staged}")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def saved_by_buffer(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written by buffer_id; buffers that are written again are replaced, others stay. Gives the table back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buffer_id").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "buffer_id") + ", buffer_id STRING"
    return rows.sparkSession.read.schema(schema).parquet(path)


class Catalog:
    """The buffers of a folder: registered, listed, deleted and taken from state to state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/buffers"

    def buffers(self) -> DataFrame:
        """buffer_id, root_path, state, file_count, chunk_count."""
        return read_or_empty(self.spark, self.path, BUFFER)

    def register(self, rows: DataFrame) -> None:
        """Add ``rows``, in place of those of the same buffers."""
        new = rows.select("buffer_id", "root_path", F.coalesce("state", F.lit("ready")).alias("state"), F.col("file_count").cast("int"), F.col("chunk_count").cast("int"))
        replaced(self.buffers().join(new.select("buffer_id"), "buffer_id", "left_anti").unionByName(new), self.path)

    def delete(self, ids: DataFrame) -> None:
        """Take the buffers of ``ids`` (buffer_id) away."""
        replaced(self.buffers().join(ids.select("buffer_id").distinct(), "buffer_id", "left_anti"), self.path)

    def move(self, ids: DataFrame, state: str) -> DataFrame:
        """Take the buffers of ``ids`` (buffer_id) to ``state`` where the state machine allows it; gives those (buffer_id, state) that it doesn't."""
        if state not in TRANSITIONS:
            raise ValueError(f"no state {state}")
        asked = ids.select("buffer_id").distinct().withColumn("asked", F.lit(True))
        rows = self.buffers().join(asked, "buffer_id", "left")
        may = F.col("state").isin([a for a, to in TRANSITIONS.items() if state in to] + [state])
        refused = rows.filter(F.col("asked") & ~may).select("buffer_id", "state")
        kept = self.spark.createDataFrame(refused.collect(), "buffer_id STRING, state STRING")  # buffers, before their table is replaced
        replaced(rows.withColumn("state", F.when(F.col("asked") & may, state).otherwise(F.col("state"))).drop("asked"), self.path)
        return kept


def save_lexical(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Postings of ``docs`` by a hash of the term, and their number and mean length, as tables below ``path``."""
    rows = postings(docs, key, text).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64)).cast("int"))
    rows.repartition("part").sortWithinPartitions("term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")


def search_lexical(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 50) -> DataFrame:
    """qid, id, score, rank: BM25 for ``queries`` (qid, query) from saved postings, of which only the parts of terms asked for are read."""
    asked = queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64)).cast("int"))
    parts = [r[0] for r in asked.select("part").distinct().collect()]  # 64 at most
    tf = spark.read.parquet(f"{path}/postings").filter(F.col("part").isin(parts)).join(asked.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    idf = asked.join(df, "term").crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats"))).select("qid", "term", "avgdl", (F.col("times") * weight).alias("w"))  # stats has one row
    return best(tf.join(idf, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * gain), 6).alias("score")), top_k)


def save_vector_index(index: DataFrame, centres, path: str) -> None:
    """An inverted file (id, v, list) by list, and its centres, below ``path``."""
    spark = index.sparkSession
    index.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list INT, centre ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/centres")


def load_vector_index(spark: SparkSession, path: str):
    """The inverted file and its centres; a search reads the folders of the lists that it looks into."""
    import numpy as np

    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # one row per list
    return spark.read.schema("id BIGINT, v ARRAY<FLOAT>, list INT").parquet(f"{path}/lists"), np.array([r["centre"] for r in rows])


def read_git_status(spark: SparkSession, path: str) -> DataFrame:
    """staged, changed, file, was: the lines of ``git status --porcelain``; was is the old name of a renamed file."""
    line = spark.read.text(path).filter("length(value) > 3")
    name = F.substring("value", 4, 1 << 30)
    pair = F.split(name, " -> ")
    return line.select(F.substring("value", 1, 1).alias("staged"), F.substring("value", 2, 1).alias("changed"), F.element_at(pair, -1).alias("file"), F.when(F.size(pair) > 1, pair[0]).alias("was"))


def read_git_diff(spark: SparkSession, path: str) -> DataFrame:
    """file, begin, stop, patch: the new lines' range of each hunk of ``git diff`` output, one row per hunk."""
    whole = spark.read.text(path, lineSep="\ndiff --git ").select(F.regexp_extract("value", r"(?m)^\+\+\+ (?:b/)?(\S.*)$", 1).alias("file"), F.col("value").alias("v")).filter("file <> ''")
    each = whole.select("file", F.explode(F.slice(F.split("v", r"(?m)^(?=@@ )"), 2, 1 << 30)).alias("patch"))
    p = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    begin, n = F.regexp_extract("patch", p, 1).cast("int"), F.regexp_extract("patch", p, 2)
    return each.select("file", begin.alias("begin"), (begin + F.when(n == "", 1).otherwise(n.cast("int")) - 1).alias("stop"), "patch")


def read_git_blame(spark: SparkSession, path: str) -> DataFrame:
    """commit, line: the header lines of ``git blame --porcelain``: which commit wrote which line of the file."""
    p = r"^([0-9a-f]{40}) \d+ (\d+)"
    return spark.read.text(path).filter(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("commit"), F.regexp_extract("value", p, 2).cast("int").alias("line"))


def edited_files(files: DataFrame, edits: DataFrame) -> DataFrame:
    """buffer_id, path, content, edits: files (buffer_id, path, content) after a log of edits (buffer_id, path, seq, start_line, end_line, text), in the order of seq.

    An edit replaces the lines start_line to end_line (from 1, inclusive) by its text; one that begins after the end is appended. Files without
    edits aren't given.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for buffer, path, content, log in zip(b["buffer_id"], b["path"], b["content"], b["log"], strict=True):
                lines = (content or "").split("\n")
                for e in log:
                    lines[max(0, e["start_line"] - 1) : max(0, e["end_line"])] = e["text"].split("\n")
                out.append((buffer, path, "\n".join(lines), len(log)))
            yield pd.DataFrame(out, columns=["buffer_id", "path", "content", "edits"])

    log = edits.filter("text IS NOT NULL").groupBy("buffer_id", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "start_line", "end_line", "text"))).alias("log"))  # the edits of one file
    return files.join(log, ["buffer_id", "path"]).select("buffer_id", "path", "content", "log").mapInPandas(run, "buffer_id STRING, path STRING, content STRING, edits INT")


def commit_allowed(files: DataFrame, risks: DataFrame, force: bool = False) -> DataFrame:
    """buffer_id, files, risk, allowed: whether the edited files (buffer_id, path) of each buffer may be committed: not where a symbol of theirs is of high risk
    (``risks`` buffer_id, file, level), unless forced."""
    by = files.select("buffer_id", F.col("path").alias("file")).distinct().join(risks.groupBy("buffer_id", "file").agg(F.max((F.col("level") == "high").cast("int")).alias("high")), ["buffer_id", "file"], "left")
    return by.groupBy("buffer_id").agg(F.count("*").alias("files"), F.coalesce(F.max("high"), F.lit(0)).alias("h")).select("buffer_id", "files", F.when(F.col("h") == 1, "high").otherwise("low").alias("risk"), ((F.col("h") == 0) | F.lit(force)).alias("allowed"))
