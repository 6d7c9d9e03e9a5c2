"""Queries that go through kept tables, with the SQL of what must come out of them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyzers as A
from ..operators import graph as G
from ..operators import search as S
from ..sources import code as C
from ..sources import store as D
from ..sources.tables import shared_folder, table
from ..streaming.windows import sessions
from .graph_queries import chunks_of
from .registry import ORACLES, query
from .search_queries import NEAREST, named_queries, top


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CUT = "SELECT file_id FROM chunks WHERE type IN ('function', 'nested_function', 'method', 'class')"


@query("s2_definitions", f"SELECT file_id, start_line, end_line, type, name, text FROM chunks WHERE type <> 'sliding' AND file_id IN ({CUT})")
def s2_definitions(spark: SparkSession, folder: str) -> DataFrame:
    # The chunk table tells which files were cut by definition; the others are minified or data.
    by = chunks_of(spark, folder).filter("type IN ('function', 'nested_function', 'method', 'class')").select("file_id").distinct()
    return C.definition_chunks(table(spark, folder, "source_files").join(by, "file_id", "left_semi"), "file_id", "path", "content")


@query("s7_chunk_table", "SELECT chunk_id, buffer_id, file, text FROM chunks")
def s7_chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    c, path = chunks_of(spark, folder), place(spark, "chunks")
    D.saved_by_buffer(c.filter("chunk_id % 2 = 0").withColumn("text", F.lit("old")), path)
    some = c.select("buffer_id").distinct()
    return D.saved_by_buffer(c.join(some, "buffer_id", "left_semi"), path).select("chunk_id", "buffer_id", "file", "text")


@query("s8_vectors", "SELECT vec_id, len(embedding)::INT AS size, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def s8_vectors(spark: SparkSession, folder: str) -> DataFrame:
    path = place(spark, "vectors")
    D.replaced(table(spark, folder, "embeddings"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("s9_vector_index", f"WITH {NEAREST} SELECT * FROM {top('near', 10)}")
def s9_vector_index(spark: SparkSession, folder: str) -> DataFrame:
    # All lists are looked into, so the saved index gives the exact result.
    v, path = table(spark, folder, "embeddings"), place(spark, "index")
    D.save_vector_index(*S.inverted_file(v, "vec_id", "embedding", 16), path)
    index, centres = D.load_vector_index(spark, path)
    return S.inverted_file_search(index, centres, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 10, len(centres))


@query("s10_lexical_index", ORACLES["q3_bm25"])
def s10_lexical_index(spark: SparkSession, folder: str) -> DataFrame:
    c, path = chunks_of(spark, folder), place(spark, "lexical")
    D.save_lexical(c, "chunk_id", "text", path)
    return D.search_lexical(spark, path, named_queries(c), 10)


@query("s13_k1_catalog", "SELECT buffer_id, CASE WHEN coalesce(state, 'ready') IN ('ready', 'rebuilding', 'dirty') AND length(buffer_id) % 2 = 0 AND coalesce(state, 'ready') <> 'rebuilding' THEN 'rebuilding' WHEN length(buffer_id) % 2 = 0 THEN 'rebuilding' ELSE coalesce(state, 'ready') END AS state FROM buffers WHERE buffer_id <> (SELECT min(buffer_id) FROM buffers)")
def s13_k1_catalog(spark: SparkSession, folder: str) -> DataFrame:
    b, catalog = table(spark, folder, "buffers"), D.Catalog(spark, place(spark, "catalog"))
    catalog.register(b)
    catalog.delete(b.agg(F.min("buffer_id").alias("buffer_id")))
    catalog.move(b.filter("length(buffer_id) % 2 = 0"), "rebuilding")
    return catalog.buffers().select("buffer_id", "state")


@query("s18_git_status", "SELECT CASE WHEN lines IS NULL THEN 'M' ELSE ' ' END AS staged, CASE WHEN size IS NULL THEN 'M' ELSE ' ' END AS changed, path AS file, NULL::VARCHAR AS was FROM source_files WHERE lines IS NULL OR size IS NULL")
def s18_git_status(spark: SparkSession, folder: str) -> DataFrame:
    path = place(spark, "status")
    mark = lambda c: F.when(F.col(c).isNull(), "M").otherwise(" ")
    table(spark, folder, "source_files").filter("lines IS NULL OR size IS NULL").select(F.concat(mark("lines"), mark("size"), F.lit(" "), "path").alias("value")).write.text(path)
    return D.read_git_status(spark, path)


@query("s20_summaries", ORACLES["a5_summary"])
def s20_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return D.saved_by_buffer(A.file_summary(chunks_of(spark, folder)), place(spark, "summaries"))


@query("k2_edited", "SELECT buffer_id, path, array_to_string(list_concat(list_concat(string_split(content, chr(10))[1:1], ['second', 'third']), string_split(content, chr(10))[4:]), chr(10)) AS content, 2 AS edits FROM source_files WHERE content IS NOT NULL AND len(string_split(content, chr(10))) >= 3")
def k2_edited(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files").filter("content IS NOT NULL AND size(split(content, '\\n')) >= 3")
    log = f.select("buffer_id", "path", F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"), F.lit("second\nthird").alias("text")), F.struct(F.lit(1).alias("seq"), F.lit(3).alias("start_line"), F.lit(3).alias("end_line"), F.lit("gone").alias("text")))).alias("e")).select("buffer_id", "path", "e.*")
    return D.edited_files(f, log)


@query("k2_commit_gate", ORACLES["g12_impact"].rsplit("SELECT *, CASE WHEN risk", 1)[0] + ", lv AS (SELECT buffer_id, symbol, risk >= 0.3 AS high FROM b), d AS (SELECT DISTINCT buffer_id, path AS file FROM source_files WHERE lines IS NULL), s AS (SELECT d.buffer_id, d.file, coalesce(max(lv.high::INT), 0) AS h FROM d LEFT JOIN chunks c ON c.buffer_id = d.buffer_id AND c.file = d.file AND c.name IS NOT NULL LEFT JOIN lv ON lv.buffer_id = c.buffer_id AND lv.symbol = c.name GROUP BY ALL) SELECT buffer_id, count(*) AS files, CASE WHEN max(h) = 1 THEN 'high' ELSE 'low' END AS risk, max(h) = 0 AS allowed FROM s GROUP BY buffer_id")
def k2_commit_gate(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder)
    d = G.definitions(c)
    levels = G.impact(c, d.select("buffer_id", "symbol")).withColumn("level", F.when(F.col("risk") >= 0.3, "high").otherwise("low"))
    risks = d.select("buffer_id", "file", "symbol").distinct().join(levels.select("buffer_id", "symbol", "level"), ["buffer_id", "symbol"])
    return D.commit_allowed(table(spark, folder, "source_files").filter("lines IS NULL"), risks)


@query("x10_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def x10_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "events"))
