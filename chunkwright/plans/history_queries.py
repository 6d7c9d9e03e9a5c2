"""Queries of audit, metric, state and difference operators, of sources and of streaming windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import history as H
from ..operators.snapshots import normal_hash, nth_last, snapshot_changes
from ..sources import code as C
from ..sources.tables import table
from .graph_queries import IMPORTS
from .registry import ORACLES, query


@query("a1_audit_stats", "SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM audit_log UNION ALL SELECT 'status', status, count(*) FROM audit_log GROUP BY status UNION ALL SELECT 'operation', operation, count(*) FROM audit_log GROUP BY operation UNION ALL SELECT 'user', user_id, count(*) FROM audit_log GROUP BY user_id")
def a1_audit_stats(spark: SparkSession, folder: str) -> DataFrame:
    return H.audit_stats(table(spark, folder, "audit_log"))


@query("a2_histogram", """WITH v AS (SELECT operation, duration_ms AS v FROM audit_log WHERE duration_ms IS NOT NULL), s AS (SELECT operation, list_sort(list(v)) AS l, count(*) AS n, sum(v)::BIGINT AS s, min(v) AS mn, max(v) AS mx FROM v GROUP BY operation)
    SELECT operation, n AS count, s AS sum, mn AS min, mx AS max, round(s::DOUBLE / n, 6) AS mean, CASE WHEN n >= 2 THEN l[floor(n * 0.5)::INT + 1] ELSE 0 END AS p50, CASE WHEN n >= 2 THEN l[floor(n * 0.95)::INT + 1] ELSE 0 END AS p95, CASE WHEN n >= 2 THEN l[floor(n * 0.99)::INT + 1] ELSE 0 END AS p99 FROM s""")
def a2_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return H.histogram(table(spark, folder, "audit_log"), "operation", "duration_ms")


@query("a3_hit_rate", "SELECT operation, count(*) FILTER (status = 'success') AS hits, round(count(*) FILTER (status = 'success')::DOUBLE / count(*), 6) AS rate FROM audit_log GROUP BY operation")
def a3_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return H.hit_rate(table(spark, folder, "audit_log"), "operation", F.col("status") == "success")


@query("a4_buckets", " UNION ALL ".join(f"SELECT operation, '{b}' AS le, count(*) FILTER (duration_ms <= {b}) AS n FROM audit_log GROUP BY operation" for b in H.BUCKETS) + " UNION ALL SELECT operation, '+Inf', count(duration_ms) FROM audit_log GROUP BY operation")
def a4_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return H.cumulative_buckets(table(spark, folder, "audit_log"), "operation", "duration_ms")


@query("a12_distinct", "SELECT count(DISTINCT file) AS files, count(DISTINCT name) AS names, count(DISTINCT buffer_id) AS buffers FROM chunks")
def a12_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").agg(F.countDistinct("file").alias("files"), F.countDistinct("name").alias("names"), F.countDistinct("buffer_id").alias("buffers"))


@query("a13_changelog", "WITH m AS (SELECT lower(text) AS t FROM documents WHERE lower(trim(source)) = 'commit' AND text IS NOT NULL) SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'feat') OR contains(t, 'feature') OR contains(t, 'add') OR contains(t, 'new') THEN 'features' WHEN contains(t, 'fix') OR contains(t, 'bug') OR contains(t, 'patch') OR contains(t, 'hotfix') THEN 'fixes' WHEN contains(t, 'breaking') OR contains(t, 'remove') OR contains(t, 'delete') OR contains(t, 'deprecate') THEN 'breaking' ELSE 'other' END AS category FROM m) GROUP BY category")
def a13_changelog(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("lower(trim(source)) = 'commit' AND text IS NOT NULL")
    return d.groupBy(H.category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query("a14_health", "WITH d AS (SELECT buffer_id, count(*) AS n FROM source_files WHERE lines IS NULL GROUP BY buffer_id), r AS (SELECT b.buffer_id, coalesce(d.n, 0) AS dirty, datediff('day', modified_at::DATE, DATE '2025-04-15')::INT AS age_days FROM buffers b LEFT JOIN d USING (buffer_id)) SELECT *, CASE WHEN dirty >= 20 THEN 'degraded' WHEN dirty >= 5 THEN 'warning' WHEN age_days >= 30 THEN 'degraded' WHEN age_days >= 7 THEN 'warning' ELSE 'ok' END AS level FROM r")
def a14_health(spark: SparkSession, folder: str) -> DataFrame:
    return H.health(table(spark, folder, "buffers"), table(spark, folder, "source_files").filter("lines IS NULL"), F.lit("2025-04-15").cast("date"))


@query("a15_usage", "WITH u AS (SELECT buffer_id, count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) / (SELECT sum(size) FROM source_files)::DOUBLE, 6) AS share FROM source_files GROUP BY buffer_id) SELECT *, CASE WHEN share >= 0.9 THEN 'critical' WHEN share >= 0.75 THEN 'high' ELSE 'ok' END AS level FROM u")
def a15_usage(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files")
    return f.groupBy("buffer_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).crossJoin(F.broadcast(f.agg(F.sum("size").alias("t")))).select("buffer_id", "files", "bytes", F.round(F.col("bytes") / F.col("t"), 6).alias("share")).withColumn("level", H.utilisation(F.col("share")))


@query("pred7_audit", "SELECT ts, operation, user_id FROM audit_log WHERE status = 'success' AND operation IN ('write_code', 'commit') ORDER BY ts DESC, operation, user_id LIMIT 50")
def pred7_audit(spark: SparkSession, folder: str) -> DataFrame:
    return H.audit_filter(table(spark, folder, "audit_log"), operations=["write_code", "commit"], status="success", limit=50).select("ts", "operation", "user_id")


@query("x7_transitions", "WITH s AS (SELECT user_id AS buffer_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'dirty' WHEN 'purchase' THEN 'rebuilding' ELSE 'ready' END AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY buffer_id ORDER BY seq) AS before FROM s) SELECT buffer_id, seq, before, state FROM l WHERE before <> state AND NOT ((before = 'ready' AND state IN ('dirty', 'rebuilding')) OR (before = 'dirty' AND state IN ('ready', 'rebuilding')) OR (before = 'rebuilding' AND state = 'ready'))")
def x7_transitions(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "dirty").when(F.col("event_type") == "purchase", "rebuilding").otherwise("ready")
    return H.invalid_transitions(table(spark, folder, "events").select(F.col("user_id").alias("buffer_id"), F.col("event_id").alias("seq"), state.alias("state")))


@query("s12_pending", "SELECT user_id AS txid, 'pending' AS status FROM (SELECT user_id, arg_max(CASE event_type WHEN 'click' THEN 'pending' ELSE 'committed' END, event_id) AS s FROM events GROUP BY user_id) WHERE s = 'pending'")
def s12_pending(spark: SparkSession, folder: str) -> DataFrame:
    return H.pending_transactions(table(spark, folder, "events").select(F.col("user_id").alias("txid"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "pending").otherwise("committed").alias("status")))


OLD = "o AS (SELECT file, start_line, end_line, type, min(text) AS text FROM chunks WHERE chunk_id % 7 <> 0 GROUP BY ALL), n AS (SELECT file, start_line, end_line, type, min(CASE WHEN chunk_id % 5 = 0 THEN text || ' ' ELSE text END) AS text FROM chunks WHERE chunk_id % 11 <> 0 GROUP BY file, start_line, end_line, type)"


@query("j13_x2_chunk_changes", f"WITH {OLD} SELECT file, start_line, end_line, type, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'kept' END AS change FROM (SELECT * EXCLUDE text, sha256(coalesce(text, '')) AS h FROM o) o FULL JOIN (SELECT * EXCLUDE text, sha256(coalesce(text, '')) AS h FROM n) n USING (file, start_line, end_line, type)")
def j13_x2_chunk_changes(spark: SparkSession, folder: str) -> DataFrame:
    c, keys = table(spark, folder, "chunks"), ["file", "start_line", "end_line", "type"]
    old = c.filter("chunk_id % 7 <> 0").groupBy(*keys).agg(F.min("text").alias("text"))
    new = c.filter("chunk_id % 11 <> 0").groupBy(*keys).agg(F.min(F.when(F.col("chunk_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("text"))
    return H.chunk_changes(old, new, keys)


@query("j14_changed_lines", r"""WITH n AS (SELECT file_id, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM source_files WHERE content IS NOT NULL)
    SELECT file_id, line::INT AS line FROM n WHERE regexp_replace(string_split(content, chr(10))[line], 'return', 'yield', 'g') <> string_split(content, chr(10))[line]""")
def j14_changed_lines(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files")
    return H.changed_lines(f, f.withColumn("content", F.regexp_replace("content", "return", "yield")), "file_id", "content")


#: Common SQL: rows of snapshots with normal paths and hashes, the last delivered ones, and the snapshots of each buffer from the last.
LAST = r"""raw AS (SELECT buffer_id, snapshot_seq, loaded_at, mtime, size, CASE WHEN trim(hash) = '' THEN NULL ELSE regexp_replace(lower(trim(hash)), '^sha256:', '') END AS hash,
      regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '/+', '/', 'g'), '^(\./)+', '') AS p, rtrim(regexp_replace(replace(trim(coalesce(root_path, '')), '\', '/'), '/+', '/', 'g'), '/') AS r FROM snapshot_files WHERE snapshot_seq IS NOT NULL),
    named AS (SELECT *, regexp_replace(CASE WHEN r <> '' AND starts_with(p, r || '/') THEN substr(p, length(r) + 2) ELSE p END, '^(\./)+', '') AS path FROM raw),
    last AS (SELECT * FROM named WHERE length(path) > 0 QUALIFY row_number() OVER (PARTITION BY buffer_id, path, snapshot_seq ORDER BY loaded_at DESC NULLS LAST, mtime DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST) = 1),
    nth AS (SELECT buffer_id, snapshot_seq, row_number() OVER (PARTITION BY buffer_id ORDER BY snapshot_seq DESC) AS n FROM (SELECT DISTINCT buffer_id, snapshot_seq FROM snapshot_files WHERE snapshot_seq IS NOT NULL)),
    disk AS (SELECT buffer_id, path, CASE WHEN trim(hash) = '' THEN NULL ELSE regexp_replace(lower(trim(hash)), '^sha256:', '') END AS hash FROM source_files)"""


def on_disk(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files").select("buffer_id", "path", normal_hash(F.col("hash")).alias("hash"))


@query("j12_conflicts", f"""WITH {LAST}, d AS (SELECT buffer_id, path, hash AS d FROM disk), s AS (SELECT buffer_id, path, hash AS s FROM last JOIN nth USING (buffer_id, snapshot_seq) WHERE n = 2), b AS (SELECT buffer_id, path, hash AS b FROM last JOIN nth USING (buffer_id, snapshot_seq) WHERE n = 1)
    SELECT buffer_id, path, CASE WHEN d IS DISTINCT FROM s AND b IS DISTINCT FROM s THEN CASE WHEN d IS NOT DISTINCT FROM b THEN 'both' ELSE 'conflict' END WHEN d IS DISTINCT FROM s THEN 'disk' WHEN b IS DISTINCT FROM s THEN 'buffer' ELSE 'same' END AS state FROM d FULL JOIN s USING (buffer_id, path) FULL JOIN b USING (buffer_id, path)""")
def j12_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "snapshot_files")
    return H.conflicts(on_disk(spark, folder), nth_last(f, 2), nth_last(f, 1))


@query("t14_diffs")
def t14_diffs(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files")
    return H.unified_diffs(f, f.withColumn("content", F.regexp_replace("content", r"\breturn\b", "yield")), "file_id", "content")


@query("t15_merge", r"""SELECT concat_ws('/', buffer_id, path) AS path, coalesce(regexp_replace(content, '\breturn\b', 'yield', 'g') || chr(10) || '# end', '') AS merged, false AS conflict FROM source_files""")
def t15_merge(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files").select(F.concat_ws("/", "buffer_id", "path").alias("path"), "content")
    return H.merged_lines(f, f.withColumn("content", F.regexp_replace("content", r"\breturn\b", "yield")), f.withColumn("content", F.concat("content", F.lit("\n# end"))))


@query("w7_undo", "SELECT branch, seq, depth FROM (SELECT user_id AS branch, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS depth FROM events) WHERE depth <= 100")
def w7_undo(spark: SparkSession, folder: str) -> DataFrame:
    return H.undo_stack(table(spark, folder, "events").select(F.col("user_id").alias("branch"), F.col("event_id").alias("seq")))


@query("t24_recall", "SELECT buffer_id AS key, round((CASE WHEN contains(lower(buffer_id), 'beacon') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(root_path), 'beacon') THEN 0.3 ELSE 0 END + 0.2 * contains('beacon', lower(coalesce(state, '-')))::INT)::DOUBLE, 3) AS score FROM buffers WHERE contains(lower(root_path), 'beacon') ORDER BY score DESC, key LIMIT 5")
def t24_recall(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "buffers").select(F.col("buffer_id").alias("key"), F.col("root_path").alias("value"), F.array(F.coalesce("state", F.lit("-"))).alias("tags"))
    return H.recalled(b, "beacon")


@query("x4_rate_limits", "WITH m AS (SELECT user_id, role, floor(ts / 60)::BIGINT AS minute, count(*) AS n FROM audit_log GROUP BY ALL) SELECT user_id, minute, n, greatest(0, n - CASE lower(role) WHEN 'admin' THEN 300 WHEN 'developer' THEN 60 WHEN 'agent' THEN 60 WHEN 'viewer' THEN 30 ELSE 10 END) AS over FROM m")
def x4_rate_limits(spark: SparkSession, folder: str) -> DataFrame:
    return H.allowed_requests(table(spark, folder, "audit_log"))


@query("g20_conflict_risk", f"""WITH {IMPORTS}, d AS (SELECT DISTINCT buffer_id, path AS file FROM source_files WHERE lines IS NULL), c AS (SELECT buffer_id, path AS file, count(*) AS commits FROM ({ORACLES["p1_found"]}) GROUP BY ALL), p AS (SELECT buffer_id, target AS file, count(*) AS dependents FROM targets GROUP BY ALL),
    r AS (SELECT d.buffer_id, d.file, coalesce(commits, 0) AS commits, coalesce(dependents, 0) AS dependents FROM d LEFT JOIN c USING (buffer_id, file) LEFT JOIN p USING (buffer_id, file)) SELECT *, CASE WHEN commits >= 3 THEN 'high' WHEN commits = 2 OR dependents >= 2 THEN 'medium' ELSE 'low' END AS risk FROM r""")
def g20_conflict_risk(spark: SparkSession, folder: str) -> DataFrame:
    commits = snapshot_changes(table(spark, folder, "snapshot_files")).select("buffer_id", F.col("path").alias("file"))
    dependents = G.import_targets(table(spark, folder, "chunks")).select("buffer_id", F.col("target").alias("file"))
    return H.conflict_risk(table(spark, folder, "source_files").filter("lines IS NULL").select("buffer_id", F.col("path").alias("file")), commits, dependents)


@query("s3_sliding", """WITH s AS (SELECT file_id, string_split(content, chr(10)) AS l FROM source_files WHERE content IS NOT NULL), w AS (SELECT file_id, l, unnest(range(0, greatest(1, ((len(l) - 30 + 24) // 25) + 1), 1)) AS k FROM s)
    SELECT file_id, (k * 25 + 1)::INT AS start_line, least(k * 25 + 30, len(l))::INT AS end_line, array_to_string(l[k * 25 + 1:k * 25 + 30], chr(10)) AS text FROM w WHERE k = 0 OR (k - 1) * 25 + 30 < len(l)""")
def s3_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return C.sliding_chunks(table(spark, folder, "source_files"), "file_id", "content")


@query("s2_python_chunks")
def s2_python_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.definition_chunks(table(spark, folder, "source_files"), "file_id", "path", "content")


@query("s14_folder_hash", "SELECT buffer_id, sha256(string_agg(path || '::' || epoch(mtime)::BIGINT || '::' || coalesce(size, 0), '' ORDER BY path, mtime, size)) AS hash FROM source_files GROUP BY buffer_id")
def s14_folder_hash(spark: SparkSession, folder: str) -> DataFrame:
    return C.folder_hashes(table(spark, folder, "source_files"))


@query("s16_s17_budget", "SELECT buffer_id, count(*) AS files, sum(coalesce(lines, 0))::BIGINT AS n_lines, (sum(coalesce(lines, 0)) * 8)::BIGINT AS tokens, (sum(coalesce(lines, 0)) * 8 * (384 * 4 + 8 + 256))::BIGINT AS bytes, sum(coalesce(lines, 0)) * 8 * (384 * 4 + 8 + 256) <= 500 * 1024 * 1024 AS fits FROM source_files GROUP BY buffer_id")
def s16_s17_budget(spark: SparkSession, folder: str) -> DataFrame:
    return C.size_budget(table(spark, folder, "source_files"))


@query("s17_resources", "WITH g AS (SELECT buffer_id, count(*) AS files, sum(coalesce(lines, 0))::BIGINT AS n_lines, greatest(1, sum(coalesce(lines, 0)) // 25)::BIGINT AS chunks, sum(coalesce(size, 0)) AS bytes FROM source_files GROUP BY buffer_id), r AS (SELECT *, round(chunks * 384 * 4 * 1.5::DOUBLE / 1048576 + bytes * 0.2::DOUBLE / 1048576, 2) AS ram_mb FROM g) SELECT buffer_id, files, n_lines, chunks, ram_mb, round(chunks * 0.05::DOUBLE, 2) AS embed_s, 20.0::DOUBLE AS search_ms, CASE WHEN chunks > 50000 THEN 'many chunks' WHEN ram_mb > 4096 THEN 'much memory' END AS warning FROM r")
def s17_resources(spark: SparkSession, folder: str) -> DataFrame:
    return C.resource_estimate(table(spark, folder, "source_files"))


@query("s4_blocks", """WITH l AS (SELECT file_id, unnest(range(0, len(string_split(content, chr(10))))) AS n, content FROM source_files WHERE content IS NOT NULL), b AS (SELECT file_id, n, string_split(content, chr(10))[n + 1] AS body FROM l), p AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 AS block FROM b)
    SELECT file_id, block::BIGINT AS block, (min(n) + 1)::INT AS start_line, (max(n) + 1)::INT AS end_line, string_agg(body, chr(10) ORDER BY n) AS content FROM p GROUP BY file_id, block""")
def s4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return C.blocks(table(spark, folder, "source_files"), "file_id", "content", 1000)


@query("s5_break_points", r"""WITH t AS (SELECT file_id, content, greatest(0, 900 - 500) AS b, substr(content, greatest(0, 900 - 500) + 1, 500) AS region FROM source_files WHERE content IS NOT NULL AND length(content) > 900)
    SELECT file_id, CASE WHEN length(regexp_extract(region, '(?s)^(.*\n)(?:def |class |@)', 1)) > 0 THEN b + length(regexp_extract(region, '(?s)^(.*\n)(?:def |class |@)', 1)) WHEN regexp_matches(region, '^(def |class |@)') THEN b ELSE greatest(1, length(regexp_extract(substr(content, 1, 901), '(?s)^(.*\n)', 1))) END::INT AS at FROM t""")
def s5_break_points(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files").filter("content IS NOT NULL AND length(content) > 900")
    return f.select("file_id", C.break_point(F.col("content"), F.lit(900), 500).alias("at"))


@query("s19_external_changes", f"""WITH {LAST}, o AS (SELECT buffer_id, path, hash AS was, true AS o FROM last JOIN nth USING (buffer_id, snapshot_seq) WHERE n = 1), n AS (SELECT buffer_id, path, hash AS now, true AS n FROM disk) SELECT buffer_id, path, CASE WHEN o.o IS NULL THEN 'new' WHEN n.n IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n USING (buffer_id, path) WHERE o.o IS NULL OR n.n IS NULL OR was IS DISTINCT FROM now""")
def s19_external_changes(spark: SparkSession, folder: str) -> DataFrame:
    return C.external_changes(nth_last(table(spark, folder, "snapshot_files"), 1), on_disk(spark, folder))


@query("t23_line_range", "SELECT file_id, array_to_string(string_split(content, chr(10))[3:9], chr(10)) AS text FROM source_files WHERE content IS NOT NULL")
def t23_line_range(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files").filter("content IS NOT NULL").select("file_id", C.line_range(F.col("content"), 3, 10).alias("text"))


@query("t25_properties", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS pages FROM events GROUP BY event_type")
def t25_properties(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.page")).alias("pages"))


@query("x10_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x10_windows(spark: SparkSession, folder: str) -> DataFrame:
    from ..streaming.windows import hourly

    return hourly(table(spark, folder, "events"))


@query("u1_virtual_buffer", "SELECT buffer_id, count(*) AS chunks FROM chunks WHERE buffer_id IN (SELECT buffer_id FROM buffers WHERE state = 'ready') GROUP BY buffer_id")
def u1_virtual_buffer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").join(table(spark, folder, "buffers").filter("state = 'ready'").select("buffer_id"), "buffer_id", "left_semi").groupBy("buffer_id").agg(F.count("*").alias("chunks"))


@query("u4_uncovered", "SELECT file_id FROM source_files EXCEPT SELECT file_id FROM file_summaries")
def u4_uncovered(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files").select("file_id").distinct().join(table(spark, folder, "file_summaries").select("file_id"), "file_id", "left_anti")


@query("a10_test_runs", "SELECT user_id || '-' || event_type AS run, count(*) AS passed, count(*) FILTER (value > 50) AS failed, count(*) FILTER (value < 5) AS skipped, count(*) + count(*) FILTER (value > 50) + count(*) FILTER (value < 5) AS total, 'tests/test_' || event_type || '.py::test_' || user_id AS failures FROM events GROUP BY user_id, event_type")
def a10_test_runs(spark: SparkSession, folder: str) -> DataFrame:
    # Outputs as a test runner prints them, one for each user and kind of event.
    by = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("f"), F.count_if(F.col("value") < 5).alias("s"))
    output = F.concat(F.lit("=== "), F.col("n"), F.lit(" passed, "), F.col("f"), F.lit(" failed, "), F.col("s"), F.lit(" skipped in 0.5s\nFAILED tests/test_"), F.col("event_type"), F.lit(".py::test_"), F.col("user_id"))
    return H.test_run_summary(by.select(F.concat_ws("-", "user_id", "event_type").alias("run"), output.alias("output")))


@query("k3_redo")
def k3_redo(spark: SparkSession, folder: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "undo").when(F.col("event_type") == "error", "redo").otherwise("edit")
    return H.redo_stacks(table(spark, folder, "events").select(F.col("user_id").alias("branch"), F.col("event_id").alias("seq"), action.alias("action")))
