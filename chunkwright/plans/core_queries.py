"""Queries of the core operators over the test tables, with the SQL that must agree with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshots import snapshot_changes
from ..sources.tables import table
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

@query(
    "p1_found",
    r"""
    WITH raw AS (
      SELECT buffer_id, snapshot_seq, loaded_at, mtime, size, CASE WHEN trim(hash) = '' THEN NULL ELSE regexp_replace(lower(trim(hash)), '^sha256:', '') END AS hash,
             regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '/+', '/', 'g'), '^(\./)+', '') AS p, rtrim(regexp_replace(replace(trim(coalesce(root_path, '')), '\', '/'), '/+', '/', 'g'), '/') AS r
      FROM snapshot_files WHERE snapshot_seq IS NOT NULL),
    named AS (SELECT *, regexp_replace(CASE WHEN r <> '' AND starts_with(p, r || '/') THEN substr(p, length(r) + 2) ELSE p END, '^(\./)+', '') AS path FROM raw),
    last AS (SELECT * FROM named WHERE length(path) > 0 QUALIFY row_number() OVER (PARTITION BY buffer_id, path, snapshot_seq ORDER BY loaded_at DESC NULLS LAST, mtime DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST) = 1),
    snaps AS (SELECT buffer_id, snapshot_seq, lag(snapshot_seq) OVER (PARTITION BY buffer_id ORDER BY snapshot_seq) AS before FROM (SELECT DISTINCT buffer_id, snapshot_seq FROM snapshot_files WHERE snapshot_seq IS NOT NULL)),
    pairs AS (SELECT * FROM snaps WHERE before IS NOT NULL),
    later AS (SELECT l.buffer_id, l.path, p.snapshot_seq, p.before, l.hash, l.size, l.mtime FROM last l JOIN pairs p ON l.buffer_id = p.buffer_id AND l.snapshot_seq = p.snapshot_seq),
    earlier AS (SELECT l.buffer_id, l.path, p.snapshot_seq, l.hash, l.size, l.mtime FROM last l JOIN pairs p ON l.buffer_id = p.buffer_id AND l.snapshot_seq = p.before)
    SELECT * FROM (
      SELECT coalesce(n.buffer_id, o.buffer_id) AS buffer_id, coalesce(n.path, o.path) AS path, coalesce(n.snapshot_seq, o.snapshot_seq) AS snapshot_seq,
             CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.hash IS NOT NULL AND o.hash IS NOT NULL THEN CASE WHEN n.hash <> o.hash THEN 'changed' END
                  WHEN n.size IS DISTINCT FROM o.size OR n.mtime IS DISTINCT FROM o.mtime THEN 'changed' END AS change
      FROM later n FULL JOIN earlier o ON n.buffer_id = o.buffer_id AND n.path = o.path AND n.snapshot_seq = o.snapshot_seq) WHERE change IS NOT NULL
    """,
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "snapshot_files"))


from . import analysis_queries, edit_queries, graph_queries, history_queries, interface_queries, search_queries, store_queries  # noqa: E402, F401
