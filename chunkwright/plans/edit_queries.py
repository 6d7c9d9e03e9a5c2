"""Queries of embeddings, edits, profiles, gaps and compositions of other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import edits as E
from ..operators import graph as G
from ..operators import history as H
from ..operators import search as S
from ..operators.embedding import embedded, encoding_stats
from ..sources.code import existing_buffers, folder_hashes
from ..sources.tables import table
from .graph_queries import CALL
from .registry import query
from .search_queries import DOT, NEAREST, nearest, top


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


#: SQL of the embeddings: signed counts of the terms by the digits of their MD5.
EMBED = r"""tk AS (SELECT chunk_id, text, list_transform(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM chunks WHERE text IS NOT NULL), ex AS (SELECT chunk_id, md5(unnest(w)) AS m FROM tk),
    pl AS (SELECT chunk_id, ('0x' || substr(m, 1, 8))::BIGINT % 64 AS at, sum(CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END) AS s FROM ex GROUP BY ALL), nm AS (SELECT chunk_id, sqrt(sum(s * s)::DOUBLE) AS z FROM pl GROUP BY chunk_id),
    emb AS (SELECT tk.chunk_id, list((coalesce(pl.s, 0) / CASE WHEN nm.z > 0 THEN nm.z ELSE 1.0 END)::FLOAT ORDER BY i) AS embedding FROM tk CROSS JOIN range(64) r(i) LEFT JOIN pl ON pl.chunk_id = tk.chunk_id AND pl.at = r.i LEFT JOIN nm ON nm.chunk_id = tk.chunk_id GROUP BY tk.chunk_id)"""


@query("e2_e3_embedded", f"WITH {EMBED} SELECT * FROM emb")
def e2_e3_embedded(spark: SparkSession, folder: str) -> DataFrame:
    return embedded(chunks_of(spark, folder), "chunk_id", "text")


@query("e3_cache_stats", "SELECT count(*) AS texts, count(DISTINCT text) AS encoded, count(*) - count(DISTINCT text) AS hits, round((count(*) - count(DISTINCT text))::DOUBLE / greatest(count(*), 1), 6) AS rate FROM chunks WHERE text IS NOT NULL")
def e3_cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_stats(chunks_of(spark, folder), "text")


@query("q16_text_search", f"WITH {EMBED}, near AS (SELECT a.chunk_id AS qid, b.chunk_id AS id, round({DOT.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM (SELECT * FROM emb WHERE chunk_id % 100 = 0) a CROSS JOIN emb b) SELECT * FROM {top('near', 5)}")
def q16_text_search(spark: SparkSession, folder: str) -> DataFrame:
    v = embedded(chunks_of(spark, folder), "chunk_id", "text")
    return S.vector_search(v, "chunk_id", "embedding", v.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("q")), 5)


@query("j8_similar_vectors", f"WITH {NEAREST} SELECT qid, id, score FROM near WHERE score >= 0.3")
def j8_similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return S.vector_links(v, "vec_id", "embedding", v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 0.3)


@query("w4_top_two_gap", f"WITH {NEAREST} SELECT qid, round(score - next, 6) AS gap FROM (SELECT qid, rank, score, lead(score) OVER (PARTITION BY qid ORDER BY rank) AS next FROM {top('near', 5)}) WHERE rank = 1")
def w4_top_two_gap(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("rank")
    return nearest(spark, folder, 5).withColumn("next", F.lead("score").over(w)).filter("rank = 1").select("qid", F.round(F.col("score") - F.col("next"), 6).alias("gap"))


@query("q23_equal_buckets", f"WITH {NEAREST} SELECT qid, id, score, ntile(4) OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS bucket FROM {top('near', 20)}")
def q23_equal_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return S.score_buckets(nearest(spark, folder, 20), expected=4)


BUCKETS = f"""{NEAREST}, r AS (SELECT * FROM {top('near', 20)}), walk AS (SELECT qid, 0::BIGINT AS step, []::STRUCT(n DOUBLE, total DOUBLE)[] AS b, 0 AS place FROM r GROUP BY qid
    UNION ALL SELECT qid, step + 1, CASE WHEN k > 0 THEN list_transform(b, lambda x, i: CASE WHEN i = k THEN {{'n': x.n + 1, 'total': x.total + score}} ELSE x END) ELSE list_append(b, {{'n': 1.0::DOUBLE, 'total': score}}) END, CASE WHEN k > 0 THEN k ELSE len(b) + 1 END
    FROM (SELECT w.qid, w.step, w.b, r.score, coalesce(list_position(list_transform(w.b, lambda x: abs(r.score - x.total / x.n) <= 0.05), true), 0) AS k FROM walk w JOIN r ON r.qid = w.qid AND r.rank = w.step + 1)),
    bk AS (SELECT r.qid, r.id, r.score, w.place::INT AS bucket FROM walk w JOIN r ON r.qid = w.qid AND r.rank = w.step)"""


@query("q23_score_buckets", f"WITH RECURSIVE {BUCKETS} SELECT * FROM bk")
def q23_score_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return S.score_buckets(nearest(spark, folder, 20), 0.95)


@query("q23_bucket_facts", f"WITH RECURSIVE {BUCKETS}, m AS (SELECT *, round(avg(score) OVER (PARTITION BY qid, bucket), 4) AS mean FROM bk), g AS (SELECT qid, bucket, count(*) AS size, any_value(mean) AS mean, max(abs(score - mean)) AS far FROM m GROUP BY ALL) SELECT qid, bucket, size, mean, round(greatest(0.0, 1 - CASE WHEN size > 1 THEN far ELSE 0.0 END / 0.05), 3)::DOUBLE AS compactness, CASE WHEN size >= 3 THEN 'extract_method' WHEN size = 2 THEN 'create_helper' ELSE 'review_individually' END AS advice FROM g")
def q23_bucket_facts(spark: SparkSession, folder: str) -> DataFrame:
    return S.bucket_facts(S.score_buckets(nearest(spark, folder, 20), 0.95), 0.95)


@query("w2_gaps", "SELECT file, before + 1 AS begin, start_line - 1 AS stop FROM (SELECT file, start_line, coalesce(lag(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line, chunk_id), 0) AS before FROM chunks WHERE type NOT IN ('orphan', 'sliding')) WHERE start_line > before + 1")
def w2_gaps(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("file").orderBy("start_line", "end_line", "chunk_id")
    rows = chunks_of(spark, folder).filter("type NOT IN ('orphan', 'sliding')").select("file", "start_line", F.coalesce(F.lag("end_line").over(w), F.lit(0)).alias("before"))
    return rows.filter("start_line > before + 1").select("file", (F.col("before") + 1).alias("begin"), (F.col("start_line") - 1).alias("stop"))


@query("pred6_profiles", " UNION ALL ".join(f"SELECT '{p}' AS profile, chunk_id, round((length(text) % 100) * CASE WHEN type IN ({', '.join(map(repr, first)) or 'NULL'}) THEN 1.5 ELSE 1.0 END * CASE WHEN type IN ({', '.join(map(repr, last)) or 'NULL'}) THEN 0.2 ELSE 1.0 END, 6)::DOUBLE AS priority, row_number() OVER (ORDER BY round((length(text) % 100) * CASE WHEN type IN ({', '.join(map(repr, first)) or 'NULL'}) THEN 1.5 ELSE 1.0 END * CASE WHEN type IN ({', '.join(map(repr, last)) or 'NULL'}) THEN 0.2 ELSE 1.0 END, 6) DESC, chunk_id)::INT AS rank FROM c WHERE end_line - start_line + 1 BETWEEN {a} AND {z}" + ("" if t else " AND NOT contains(lower(file), 'test')") for p, (a, z, t, first, last) in E.PROFILES.items()).replace("SELECT 'reviewer'", "WITH c AS (SELECT * REPLACE (CASE WHEN contains(text, 'assert') THEN 'assertion' WHEN contains(file, 'vendor') THEN 'vendor' ELSE type END AS type) FROM chunks WHERE text IS NOT NULL) SELECT 'reviewer'", 1))
def pred6_profiles(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("text").contains("assert"), "assertion").when(F.col("file").contains("vendor"), "vendor").otherwise(F.col("type"))
    return E.profiled(chunks_of(spark, folder).filter("text IS NOT NULL").withColumn("type", kind).withColumn("score", (F.length("text") % 100).cast("double")))


@query("t18_import_added", "SELECT chunk_id, array_to_string(CASE WHEN list_contains(l, 'import tracing') THEN l ELSE list_concat(list_concat(l[1:k], ['import tracing']), l[k + 1:]) END, chr(10)) AS text FROM (SELECT chunk_id, l, coalesce(list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(l[i], '^\\s*(?:import\\b|from\\s+\\S+\\s+import\\b|use\\s+\\S+|const\\s+\\w+\\s*=\\s*require\\s*\\()') THEN i ELSE 0 END)), 0) AS k FROM (SELECT chunk_id, string_split(text, chr(10)) AS l FROM chunks WHERE lower(trim(language)) = 'python' AND text IS NOT NULL))")
def t18_import_added(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("lower(trim(language)) = 'python' AND text IS NOT NULL").select("chunk_id", E.import_added(F.col("text"), "tracing").alias("text"))


@query("t21_mended", r"""SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bexcept\s*:', 'except Exception:', 'g'), '==\s*None\b', 'is None', 'g'), '!=\s*None\b', 'is not None', 'g'), '(?m)[ \t]+$', '', 'g') AS text FROM chunks WHERE text IS NOT NULL""")
def t21_mended(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", E.mended(F.col("text")).alias("text"))


@query("k8_denied", """WITH o AS (SELECT buffer_id, min(user_id) AS owner FROM audit_log WHERE buffer_id IS NOT NULL AND user_id IS NOT NULL GROUP BY buffer_id), n AS (SELECT a.*, CASE a.operation WHEN 'search' THEN 'search' WHEN 'read_code' THEN 'read_code' WHEN 'write_code' THEN 'write_code' WHEN 'commit' THEN 'commit' WHEN 'embed_codebase' THEN 'embed_codebase' WHEN 'discard' THEN 'discard' WHEN 'create_buffer' THEN 'create_buffer' WHEN 'delete_buffer' THEN 'delete_buffer' WHEN 'reload_codebase' THEN 'reload_codebase' WHEN 'view_audit_log' THEN 'view_audit_log' END AS need, o.owner FROM audit_log a LEFT JOIN o USING (buffer_id)),
    j AS (SELECT *, CASE WHEN lower(role) = 'admin' THEN true WHEN lower(role) IN ('agent', 'analyst') THEN need <> 'view_audit_log' WHEN lower(role) IN ('reader', 'guest') THEN need IN ('search', 'read_code') ELSE false END AS may FROM n WHERE need IS NOT NULL)
    SELECT operation, role, count(*) AS n FROM j WHERE NOT may OR (need IN ('delete_buffer', 'write_code', 'commit', 'discard', 'reload_codebase', 'embed_codebase') AND lower(role) <> 'admin' AND owner IS NOT NULL AND user_id IS DISTINCT FROM owner) GROUP BY operation, role""")
def k8_denied(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "audit_log")
    owners = a.filter("buffer_id IS NOT NULL AND user_id IS NOT NULL").groupBy("buffer_id").agg(F.min("user_id").alias("owner"))
    return E.denied(a, owners=owners).groupBy("operation", "role").agg(F.count("*").alias("n"))


@query("k8_permissions", "SELECT role, permission, role <> 'admin' AND permission IN ('delete_buffer', 'write_code', 'commit', 'discard', 'reload_codebase', 'embed_codebase') AS own_only FROM (SELECT unnest(['admin', 'agent', 'analyst', 'reader', 'guest']) AS role) CROSS JOIN (SELECT unnest(['create_buffer', 'delete_buffer', 'write_code', 'commit', 'discard', 'reload_codebase', 'search', 'read_code', 'embed_codebase', 'view_audit_log']) AS permission) WHERE (role = 'admin' OR permission <> 'view_audit_log') AND (role NOT IN ('reader', 'guest') OR permission IN ('search', 'read_code'))")
def k8_permissions(spark: SparkSession, folder: str) -> DataFrame:
    return E.permission_table(spark)


@query("s15_existing", "WITH h AS (SELECT buffer_id, sha256(string_agg(path || '::' || epoch(mtime)::BIGINT || '::' || coalesce(size, 0), '' ORDER BY path, mtime, size)) AS hash FROM source_files GROUP BY buffer_id) SELECT 'copy of ' || buffer_id AS asked, buffer_id FROM h WHERE length(buffer_id) > 12")
def s15_existing(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files")
    asked = f.filter("length(buffer_id) > 12").withColumn("buffer_id", F.concat(F.lit("copy of "), F.col("buffer_id")))
    return existing_buffers(folder_hashes(f), folder_hashes(asked))


@query("t18_import_removed", r"""SELECT chunk_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:import\s+tracing(?:\s+as\s+\w+)?\s*;?\s*$|from\s+tracing\s+import\b|import\s.*from\s+[''"]tracing[''"]|use\s+tracing\b|.*require\s*\(\s*[''"]tracing[''"]\s*\))')), chr(10)) AS text FROM (SELECT chunk_id, 'import tracing' || chr(10) || text || chr(10) || 'from tracing import span' AS text FROM chunks WHERE text IS NOT NULL)""")
def t18_import_removed(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", E.import_removed(F.concat(F.lit("import tracing\n"), "text", F.lit("\nfrom tracing import span")), "tracing").alias("text"))


@query("t19_patched", r"""SELECT file_id::BIGINT AS file_id, sha256(regexp_replace(content, '\breturn\b', 'yield', 'g')) AS sha, true AS applied FROM source_files WHERE regexp_matches(content, '\breturn\b')""")
def t19_patched(spark: SparkSession, folder: str) -> DataFrame:
    # A round trip: differences between two versions, applied to the first, give the second.
    f = table(spark, folder, "source_files").filter("content IS NOT NULL")
    patches = H.unified_diffs(f, f.withColumn("content", F.regexp_replace("content", r"\breturn\b", "yield")), "file_id", "content").withColumnRenamed("diff", "patch")
    return E.patched(f, patches, "file_id").select("file_id", F.sha2("patched", 256).alias("sha"), "applied")


@query("t20_parameter_added", r"""SELECT chunk_id, regexp_replace(regexp_replace(text, '(\bdef\s+load\s*\()\s*\)', '\1tracer)', 'g'), '(\bdef\s+load\s*\([^()]*[^()\s,])\s*,?\s*\)', '\1, tracer)', 'g') AS text FROM (SELECT chunk_id, text || chr(10) || 'def load(a, b):' || chr(10) || '    pass' AS text FROM chunks WHERE lower(trim(language)) = 'python' AND text IS NOT NULL)""")
def t20_parameter_added(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks_of(spark, folder).filter("lower(trim(language)) = 'python' AND text IS NOT NULL")
    return c.select("chunk_id", E.parameter_added(F.concat("text", F.lit("\ndef load(a, b):\n    pass")), "load", "tracer").alias("text"))


@query("t20_symbol_edited", "SELECT chunk_id, '# top' || chr(10) || 'def swap(x):' || chr(10) || '    return 0' || chr(10) || chr(10) || 'y = ' || length(text) AS text FROM chunks WHERE text IS NOT NULL")
def t20_symbol_edited(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("# top\ndef swap(a,\n         b):\n    if a:\n\n        return b\n    return a\n\ny = "), F.length("text"))
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", E.symbol_edited(text, "swap", "def swap(x):\n    return 0").alias("text"))


@query("t20_extracted", "SELECT chunk_id, 'def f():' || chr(10) || '    part()' || chr(10) || '    return ' || length(text) || chr(10) || chr(10) || chr(10) || 'def part():' || chr(10) || '    a = 1' || chr(10) || '    if a:' || chr(10) || '        b = 2' AS text FROM chunks WHERE text IS NOT NULL")
def t20_extracted(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("def f():\n    a = 1\n    if a:\n        b = 2\n    return "), F.length("text"))
    return chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", E.method_extracted(text, 2, 4, "part").alias("text"))


@query("t21_rule_findings", r"""WITH l AS (SELECT chunk_id, start_line, lower(trim(language)) AS lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM chunks WHERE text IS NOT NULL), e AS (SELECT *, l[n] AS body, trim(CASE WHEN n > 1 THEN l[n - 1] END, ' ') AS above, trim(l[n + 1], ' ') AS below FROM l),
    f AS (SELECT chunk_id, (start_line + n - 1)::INT AS line, lang, body, coalesce(CASE lang WHEN 'python' THEN regexp_matches(body, '^\s*(?:async\s+)?def\s+\w+.*:\s*$') WHEN 'java' THEN regexp_matches(body, '^\s*(?:public|private|protected)\s+[\w<>\[\]., ]+\(.*\{\s*$') WHEN 'go' THEN regexp_matches(body, '^func\s') WHEN 'javascript' THEN regexp_matches(body, '^\s*(?:export\s+)?(?:async\s+)?function\s+\w+') END, false) AS d,
      coalesce(CASE WHEN lang = 'python' THEN regexp_matches(below, '^[rRuU]?(?:"|'')') ELSE regexp_matches(above, '^(?://|/\*|\*|@)|\*/$') END, false) AS doc FROM e)
    SELECT chunk_id, line, 'resource_open' AS rule FROM f WHERE lang = 'python' AND regexp_matches(body, '^\s*\w+\s*=\s*open\s*\(') UNION ALL SELECT chunk_id, line, 'add_visibility' FROM f WHERE lang = 'java' AND regexp_matches(body, '^\s+(?:static\s+|final\s+)*(?:void|int|long|boolean|double|String|[A-Z]\w*(?:<[^>]*>)?)\s+\w+\s*\([^;]*\)\s*\{\s*$')
    UNION ALL SELECT chunk_id, line, 'add_documentation' FROM f WHERE d AND NOT doc""")
def t21_rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    return E.rule_findings(chunks_of(spark, folder))


@query("k4_rename_preview", r"""WITH l AS (SELECT buffer_id, chunk_id, file, start_line, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM chunks WHERE contains(text, 'return')) SELECT buffer_id, chunk_id, file, (start_line + n - 1)::INT AS line, l[n] AS before, regexp_replace(l[n], '\breturn\b', 'give', 'g') AS after FROM l WHERE regexp_matches(l[n], '\breturn\b')""")
def k4_rename_preview(spark: SparkSession, folder: str) -> DataFrame:
    return E.renames_previewed(chunks_of(spark, folder), "return", "give")


NEW = r"^\s*(?:async\s+)?(?:def|class|func|function)\s+(\w+)"


@query("g15_new_symbols", rf"""WITH n AS (SELECT DISTINCT file_id, unnest(string_split(content, chr(10))) AS body FROM source_files WHERE content IS NOT NULL), o AS (SELECT DISTINCT file_id, unnest(string_split(CASE WHEN file_id % 2 = 0 THEN regexp_replace(content, '\bdef ', 'def old_', 'g') ELSE content END, chr(10))) AS body FROM source_files WHERE content IS NOT NULL)
    SELECT n.file_id, regexp_extract(n.body, '{NEW}', 1) AS symbol, count(*) AS n FROM n WHERE regexp_matches(n.body, '{NEW}') AND NOT EXISTS (SELECT 1 FROM o WHERE o.file_id = n.file_id AND o.body = n.body) GROUP BY ALL""")
def g15_new_symbols(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "source_files")
    old = f.withColumn("content", F.when(F.col("file_id") % 2 == 0, F.regexp_replace("content", r"\bdef ", "def old_")).otherwise(F.col("content")))
    return G.new_symbols(old, f, "file_id", "content").groupBy("file_id", "symbol").agg(F.count("*").alias("n"))


@query("x11_invalidated", f"""WITH {CALL}, d AS (SELECT DISTINCT buffer_id, path AS file FROM source_files WHERE lines IS NULL), own AS (SELECT DISTINCT c.buffer_id, c.name AS symbol FROM chunks c JOIN d ON c.buffer_id = d.buffer_id AND c.file = d.file WHERE c.name IS NOT NULL),
    used AS (SELECT DISTINCT k.buffer_id, k.callee AS symbol FROM calls k JOIN d ON k.buffer_id = d.buffer_id AND k.file = d.file JOIN (SELECT DISTINCT buffer_id, symbol FROM defs) f ON f.buffer_id = k.buffer_id AND f.symbol = k.callee) SELECT buffer_id, symbol FROM own UNION SELECT buffer_id, symbol FROM used""")
def x11_invalidated(spark: SparkSession, folder: str) -> DataFrame:
    dirty = table(spark, folder, "source_files").filter("lines IS NULL").select("buffer_id", F.col("path").alias("file"))
    return G.invalidated_symbols(chunks_of(spark, folder), dirty)


@query("a11_similarity", f"WITH {NEAREST} SELECT count(*) FILTER (score >= 0.3) AS hits, count(*) AS n, round(avg(score), 6) AS mean FROM {top('near', 10)} WHERE qid <> id")
def a11_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark, folder, 10).filter("qid <> id").agg(F.count_if(F.col("score") >= 0.3).alias("hits"), F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("t12_names", "SELECT lower(trim(name)) AS name, count(*) AS n FROM chunks WHERE trim(name) <> '' GROUP BY 1")
def t12_names(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_of(spark, folder).filter("trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count("*").alias("n"))


@query("t7_shingles", r"""SELECT chunk_id, CASE WHEN len(w) < 4 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END::INT AS n FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE text IS NOT NULL)""")
def t7_shingles(spark: SparkSession, folder: str) -> DataFrame:
    words = chunks_of(spark, folder).filter("text IS NOT NULL").select("chunk_id", T.words(F.col("text")).alias("w"))
    return words.select("chunk_id", F.size(T.shingles(F.col("w"))).alias("n"))
