"""Queries of the search, ranking and packing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import graph as G
from ..operators import packing as P
from ..operators import search as S
from ..sources.tables import table, written
from .analysis_queries import over_planted, planted
from .graph_queries import CALL, IMPORTS
from .registry import query

#: Common SQL: the lexical tokens of the chunks, and BM25 over them.
TOKENS = r"""
    tok AS (SELECT chunk_id AS id, list_transform(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM chunks WHERE text IS NOT NULL),
    post AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
ASKED = r"""
    asked AS (SELECT qid, lower(term) AS term, count(*) AS times FROM (SELECT chunk_id AS qid, unnest(regexp_extract_all(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+')) AS term FROM chunks WHERE chunk_id % 100 = 0 AND name IS NOT NULL) GROUP BY ALL)"""
SCORED = """
    scored AS (SELECT a.qid, p.id, round(sum(a.times * ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)))), 6) AS score
      FROM asked a JOIN df d USING (term) JOIN post p USING (term) CROSS JOIN stats s GROUP BY a.qid, p.id)"""


def top(source: str, k: int) -> str:
    return f"(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {k})"


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
NEAREST = f"near AS (SELECT q.vec_id AS qid, v.vec_id AS id, round({DOT.format(a='q.embedding', b='v.embedding')}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN embeddings v)"


def named_queries(chunks: DataFrame) -> DataFrame:
    return chunks.filter("chunk_id % 100 = 0 AND name IS NOT NULL").select(F.col("chunk_id").alias("qid"), F.col("name").alias("query"))


def bm25_chunks(spark: SparkSession, folder: str, k: int) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return S.bm25(chunks, "chunk_id", "text", named_queries(chunks), k)


def nearest(spark: SparkSession, folder: str, k: int) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return S.vector_search(v, "vec_id", "embedding", v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), k)


@query("q3_bm25", f"WITH {TOKENS}, {ASKED}, {SCORED} SELECT * FROM {top('scored', 10)}")
def q3_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return bm25_chunks(spark, folder, 10)


@query("q4_tokens", f"WITH {TOKENS} SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS uses FROM post GROUP BY term")
def q4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return S.postings(table(spark, folder, "chunks"), "chunk_id", "text").groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"))


@query("a7_corpus_stats", f"WITH {TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def a7_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return S.corpus_stats(table(spark, folder, "chunks"), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


@query("q1_nearest", f"WITH {NEAREST} SELECT * FROM {top('near', 10)}")
def q1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark, folder, 10)


@query("q2_semantic_page", f"WITH {NEAREST} SELECT * FROM {top('near', 15)} WHERE rank > 5")
def q2_semantic_page(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark, folder, 15).filter("rank > 5")


@query(
    "q5_fused",
    f"""WITH {NEAREST}, {TOKENS}, {ASKED}, {SCORED}, a AS (SELECT * FROM {top('scored', 50)}), b AS (SELECT * FROM {top('near', 50)}),
    f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id) SELECT * FROM {top('f', 10)}""",
)
def q5_fused(spark: SparkSession, folder: str) -> DataFrame:
    return S.fused(bm25_chunks(spark, folder, 50), nearest(spark, folder, 50), 10)


@query(
    "q6_hybrid",
    f"""WITH {NEAREST}, {TOKENS}, {ASKED}, {SCORED}, a AS (SELECT * FROM {top('scored', 50)}), b AS (SELECT * FROM {top('near', 50)}),
    f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(coalesce(0.5::DOUBLE / (60 + b.rank), 0) + coalesce(2.0::DOUBLE / (60 + a.rank), 0), 6) AS score FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id) SELECT * FROM {top('f', 5)}""",
)
def q6_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return S.fused(nearest(spark, folder, 50), bm25_chunks(spark, folder, 50), 5, 0.5, 2.0)


@query("q7_search_for", r"""
    WITH hit AS (SELECT chunk_id, file, start_line, text, regexp_extract_all(text, '(?is)(.*?return\s+\w+)') AS pieces FROM chunks WHERE regexp_matches(text, '(?i)return\s+\w+')),
    one AS (SELECT chunk_id, file, start_line, text, pieces, unnest(range(0, len(pieces))) AS n FROM hit),
    spots AS (SELECT *, regexp_extract(pieces[n + 1], '(?is)^.*?(return\s+\w+)$', 1) AS m, length(array_to_string(pieces[1:n + 1], '')) AS upto FROM one)
    SELECT chunk_id, file, (start_line + length(substr(text, 1, upto - length(m))) - length(replace(substr(text, 1, upto - length(m)), chr(10), '')))::INT AS line,
      substr(text, greatest(upto - length(m) - 30, 0) + 1, (upto - length(m) - greatest(upto - length(m) - 30, 0)) + length(m) + 30) AS snippet, n::INT AS n FROM spots""")
def q7_search_for(spark: SparkSession, folder: str) -> DataFrame:
    return S.matches(table(spark, folder, "chunks"), r"return\s+\w+")


@query("q8_files", "SELECT DISTINCT file FROM chunks WHERE regexp_matches(file, '(config|settings).*\\.(yaml|py)$')")
def q8_files(spark: SparkSession, folder: str) -> DataFrame:
    return S.files_like(table(spark, folder, "chunks"), r"(config|settings).*\.(yaml|py)$")


@query("q9_symbols", f"""WITH {NEAREST}, v AS (SELECT id, score FROM near WHERE qid = 100), a AS (SELECT chunk_id, name, CASE WHEN lower(name) = 'load_config' THEN 1.0::DOUBLE ELSE 0.8 END AS score, 1 AS way FROM chunks WHERE contains(lower(name), 'load_config')),
    b AS (SELECT chunk_id, name, v.score, 2 AS way FROM chunks JOIN v ON v.id = chunk_id WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM a)) SELECT chunk_id, name, score, row_number() OVER (ORDER BY way, score DESC, chunk_id)::INT AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY rank <= 10""")
def q9_symbols(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    one = v.filter("vec_id = 100").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return S.symbols_named(table(spark, folder, "chunks"), "load_config", S.vector_links(v, "vec_id", "embedding", one, -2.0).select("id", "score"))


@query("q10_symbol_search", """
    SELECT name, file, start_line, CASE WHEN lower(name) = 'token' THEN 'exact' WHEN starts_with(lower(name), 'token') THEN 'prefix' ELSE 'fuzzy' END AS kind
    FROM chunks WHERE name IS NOT NULL AND (contains(lower(name), 'token') OR levenshtein(lower(name), 'token') <= 2)""")
def q10_symbol_search(spark: SparkSession, folder: str) -> DataFrame:
    return S.symbol_search(table(spark, folder, "chunks"), "token")


@query("q15_confidence", f"""WITH {NEAREST}, r AS (SELECT * FROM {top('near', 20)}),
    s AS (SELECT *, max(score) OVER q - max(CASE WHEN rank = 2 THEN score END) OVER q AS gap, avg(score) OVER q AS m, stddev_pop(score) OVER q AS d FROM r WINDOW q AS (PARTITION BY qid))
    SELECT qid, id, score, CASE WHEN score < 0.3 THEN 'low' WHEN score > 0.9 THEN 'high' WHEN gap > 0.2 AND rank = 1 THEN 'high' WHEN gap < 0.03 THEN 'low' WHEN score >= m + 0.5 * d THEN 'high' WHEN score <= m - 2 * d THEN 'low' ELSE 'medium' END AS confidence FROM s""")
def q15_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return S.result_confidence(nearest(spark, folder, 20))


FACET = f"""{NEAREST}, c AS (SELECT chunk_id AS id, type, lower(coalesce(name, '')) AS n, lower(text) AS t FROM chunks WHERE lower(trim(language)) = 'python' AND end_line - start_line + 1 >= 3),
    p AS (SELECT id, coalesce((contains(t, 'load')::INT + contains(t, 'token')::INT), 0) / 2.0::DOUBLE AS lexical, CASE WHEN n = 'load token' THEN 1.0 WHEN contains(n, 'load token') THEN 0.7 WHEN contains(n, 'load') OR contains(n, 'token') THEN 0.5 ELSE 0.0 END::DOUBLE AS symbol, CASE WHEN type = 'function' THEN 0.05 ELSE 0.0 END::DOUBLE AS bonus FROM c),
    s AS (SELECT near.qid, p.id, near.score AS semantic, floor((0.7::DOUBLE * near.score + (0.15::DOUBLE * lexical + 0.15::DOUBLE * symbol + bonus)) * 1000 + 0.5::DOUBLE + 1e-9) / 1000 AS score, lexical, symbol FROM p JOIN near ON near.id = p.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10)"""


@query("q12_score_parts", f"WITH {FACET} SELECT id AS chunk_id, round(lexical, 3) AS lexical, symbol, bonus FROM p")
def q12_score_parts(spark: SparkSession, folder: str) -> DataFrame:
    p = S.score_parts(S.facet_filter(table(spark, folder, "chunks"), language="python", min_lines=3), "load token", "function")
    return p.select(F.col("id").alias("chunk_id"), F.round("lexical", 3).alias("lexical"), "symbol", "bonus")


@query("q11_faceted", f"""WITH {FACET}, g AS (SELECT *, max(score) OVER q - max(CASE WHEN rank = 2 THEN score END) OVER q AS gap, avg(score) OVER q AS mean FROM r WINDOW q AS (PARTITION BY qid))
    SELECT qid, id AS chunk_id, score, round(lexical, 3) AS lexical, round(symbol, 3) AS symbol, CASE WHEN score < 0.3 THEN 'low' WHEN score > 0.85 THEN 'high' WHEN gap > 0.2 AND rank = 1 THEN 'high' WHEN gap < 0.05 THEN 'low' WHEN score > mean + 0.1 THEN 'high' WHEN score < mean - 0.3 THEN 'low' ELSE 'medium' END AS confidence,
      concat_ws(' ', CASE WHEN semantic > 0.7 THEN 'Strong semantic match.' WHEN semantic > 0.4 THEN 'Moderate semantic match.' END, CASE WHEN lexical > 0.5 THEN 'Query terms found in the text.' END, CASE WHEN symbol > 0 THEN 'Symbol name matches.' END) AS why, rank FROM g""")
def q11_faceted(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    queries = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return S.faceted(S.facet_filter(table(spark, folder, "chunks"), language="python", min_lines=3), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), queries, "load token", 10, "function")


def ivf(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors, the queries, and the approximate 10 nearest by an inverted file of about the root of the number of vectors, probed as calibrated."""
    v = table(spark, folder, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    index, centres = S.inverted_file(v, "vec_id", "embedding", max(1, int(v.count() ** 0.5)))
    index = written(index, "ivf")
    return v, asked, S.inverted_file_search(index, centres, asked, 10, S.calibrated_probe(index, centres, v, "vec_id", "embedding", asked, 10, 0.95))


@query("q29_ivf")
def q29_ivf(spark: SparkSession, folder: str) -> DataFrame:
    return ivf(spark, folder)[2]


@query("q29_recall", "SELECT true AS enough")
def q29_recall(spark: SparkSession, folder: str) -> DataFrame:
    v, asked, found = ivf(spark, folder)
    exact = S.vector_search(v, "vec_id", "embedding", asked, 10)
    hit = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


@query("j16_most_similar", f"""WITH n AS (SELECT a.vec_id AS id, b.vec_id AS best, round({DOT.format(a='a.embedding', b='b.embedding')}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 <> 0) b)
    SELECT id, best, score FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, best) = 1""")
def j16_most_similar(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.most_similar(v.filter("id % 100 = 0"), v.filter("id % 100 <> 0"), 1)


@query("e1_normalized", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def e1_normalized(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", S.l2_normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.sqrt(S.dot(F.col("v"), F.col("v"))), 4).alias("norm"))


@query("pred1_facets", """SELECT chunk_id FROM chunks WHERE lower(trim(language)) = 'python' AND regexp_matches(file, '^(src|lib)/') AND type IN ('function', 'class') AND end_line - start_line + 1 BETWEEN 5 AND 80 AND regexp_matches(file, '.*\\.py')""")
def pred1_facets(spark: SparkSession, folder: str) -> DataFrame:
    return S.facet_filter(table(spark, folder, "chunks"), "python", "^(src|lib)/", ["function", "class"], 5, 80, "*.py").select("chunk_id")


@query("u5_unique_texts", r"""SELECT chunk_id FROM chunks WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256(regexp_replace(lower(text), '\s+', '', 'g')) ORDER BY chunk_id) = 1""")
def u5_unique_texts(spark: SparkSession, folder: str) -> DataFrame:
    return P.unique_texts(table(spark, folder, "chunks")).select("chunk_id")


@query("pred8_packing", r"""SELECT reason, count(*) AS chunks FROM (SELECT CASE WHEN type IN ('sliding', 'orphan') THEN 'type' WHEN regexp_matches(regexp_extract(file, '[^/]*$'), '^(test_.*\.py|.*_test\.py|.*\.(test|spec)\.(js|ts|jsx|tsx)|.*_test\.rs|.*_test\.go|.*Test\.java)$') THEN 'test'
    WHEN end_line - start_line + 1 < 3 THEN 'short' WHEN end_line - start_line + 1 > 60 THEN 'long' ELSE 'kept' END AS reason FROM chunks) GROUP BY reason""")
def pred8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return P.packing_reason(table(spark, folder, "chunks"), ["sliding", "orphan"], 3, 60).groupBy("reason").agg(F.count("*").alias("chunks"))


PACK = f"""WITH {TOKENS}, {ASKED}, {SCORED}, r AS (SELECT * FROM {top('scored', 50)}),
    c AS (SELECT r.qid, r.id, r.rank, greatest(1, length(c.text) // 4) AS cost FROM r JOIN chunks c ON c.chunk_id = r.id)
    SELECT qid, id, rank, cost::INT AS cost, sum(cost) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS used FROM c QUALIFY used <= 2000"""


@query("c1_pack_context", PACK)
def c1_pack_context(spark: SparkSession, folder: str) -> DataFrame:
    return P.packed(bm25_chunks(spark, folder, 50), table(spark, folder, "chunks"), 2000)


STRIP = f"array_to_string(list_filter(string_split({{t}}, chr(10)), lambda x: NOT (trim(x) = '' OR starts_with(trim(x), '#!/') OR contains(trim(x), 'coding:') OR contains(trim(x), '-*-') OR contains(trim(x), '__all__') OR regexp_matches(trim(x), '{T.LICENSE_LINE}'))), chr(10))"
TESTED = r"regexp_matches(regexp_extract(file, '[^/]*$'), '^(test_.*\.py|.*_test\.py|.*\.(test|spec)\.(js|ts|jsx|tsx)|.*_test\.rs|.*_test\.go|.*Test\.java)$')"


@query("c2_pack_smart", f"""WITH {TOKENS}, {ASKED}, {SCORED}, r AS (SELECT * FROM {top('scored', 50)}), k AS (SELECT chunk_id, file, start_line, text FROM chunks WHERE text IS NOT NULL AND type NOT IN ('sliding', 'orphan') AND NOT {TESTED} AND end_line - start_line + 1 BETWEEN 1 AND 400 QUALIFY row_number() OVER (PARTITION BY sha256(regexp_replace(lower(text), '\\s+', '', 'g')) ORDER BY chunk_id) = 1),
    p AS (SELECT r.qid, k.file, k.start_line, r.id, r.rank, k.text, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS place FROM r JOIN k ON k.chunk_id = r.id), b AS (SELECT *, {STRIP.format(t="CASE WHEN place <= 3 THEN text ELSE split_part(text, chr(10), 1) END")} AS body FROM p), c AS (SELECT *, greatest(1, length(body) // 4)::INT AS cost FROM b)
    SELECT qid, file, start_line, id, rank, cost, sum(cost) OVER (PARTITION BY qid ORDER BY place)::BIGINT AS used, body, (greatest(1, length(text) // 4) - cost)::INT AS saved FROM c QUALIFY used <= 2000""")
def c2_pack_smart(spark: SparkSession, folder: str) -> DataFrame:
    return P.packed_smart(bm25_chunks(spark, folder, 50), table(spark, folder, "chunks"), 2000)


@query("c3_signatures", "SELECT chunk_id, split_part(text, chr(10), 1) AS signature, greatest(1, length(text) // 4)::INT AS tokens FROM chunks WHERE text IS NOT NULL")
def c3_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").filter("text IS NOT NULL").select("chunk_id", T.signature(F.col("text")).alias("signature"), T.estimated_tokens(F.col("text")).alias("tokens"))


HAS = "(contains(lower({c}), 'load')::INT + contains(lower({c}), 'token')::INT + contains(lower({c}), 'cluster')::INT)"


@query("c4_pack_hierarchy", f"""WITH s AS (SELECT *, 8 * {HAS.format(c="coalesce(name, '')")} + 3 * {HAS.format(c='text')} AS s FROM chunks WHERE text IS NOT NULL), f0 AS (SELECT buffer_id, file, sum(s) + 5 * {HAS.format(c='file')} AS fs, coalesce(array_to_string(list_sort(list_distinct(list(name))), ', '), '') AS names FROM s GROUP BY buffer_id, file),
    f AS (SELECT *, row_number() OVER (ORDER BY fs DESC, buffer_id, file) AS fr FROM f0 WHERE fs > 0 QUALIFY fr <= 5), i AS (SELECT s.buffer_id, s.file, s.chunk_id, s.text, f.fr, row_number() OVER (PARTITION BY s.buffer_id, s.file ORDER BY s.s DESC, s.chunk_id) AS cr FROM s JOIN f USING (buffer_id, file) WHERE s.s > 0 QUALIFY cr <= 10),
    p AS (SELECT 1 AS level, file, fr, 0 AS cr, NULL::BIGINT AS chunk_id, concat_ws(': ', file, names) AS body FROM f UNION ALL SELECT 2, file, fr, cr, chunk_id, split_part(text, chr(10), 1) FROM i UNION ALL SELECT 3, file, fr, cr, chunk_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: {HAS.format(c='x')} > 0)[1:3], chr(10)) FROM i)
    SELECT level::INT AS level, file, chunk_id, body, sum(greatest(1, length(body) // 4)) OVER (ORDER BY level, fr, cr)::BIGINT AS used FROM p QUALIFY used <= 4000""")
def c4_pack_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return P.packed_hierarchy(table(spark, folder, "chunks"), "load token cluster", 4000)


@query("c5_related", None)
def c5_related(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return P.related_code(table(spark, folder, "chunks"), v, named_queries(table(spark, folder, "chunks")).select(F.col("qid").alias("chunk_id")), 4000)


@query("q17_disclosure", "SELECT chunk_id, file, name, split_part(text, chr(10), 1) AS body, length(split_part(text, chr(10), 1)) // 4 AS tokens FROM chunks WHERE text IS NOT NULL AND name IS NOT NULL")
def q17_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return P.disclosed(table(spark, folder, "chunks").filter("text IS NOT NULL AND name IS NOT NULL"), "signatures").select("chunk_id", "file", "name", "body", "tokens")


@query("w1_rank_in_file", "SELECT chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY end_line - start_line DESC, chunk_id)::INT AS rank FROM chunks QUALIFY rank <= 3")
def w1_rank_in_file(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy(F.desc(F.col("end_line") - F.col("start_line")), "chunk_id")
    return table(spark, folder, "chunks").select("chunk_id", F.row_number().over(w).alias("rank")).filter("rank <= 3")


SHINGLE = """sh AS (SELECT DISTINCT chunk_id AS id, s FROM (SELECT chunk_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
    FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE text IS NOT NULL))),
    n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)"""


@query("c7_duplicates", f"""WITH {SHINGLE} SELECT a.id AS chunk_a, b.id AS chunk_b, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 4) AS similarity FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
    GROUP BY a.id, b.id, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.85""")
def c7_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return P.duplicates(table(spark, folder, "chunks"), 0.85)


@query("q22_similar_patterns", r"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE text IS NOT NULL),
    sh AS (SELECT DISTINCT chunk_id AS id, s FROM (SELECT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) >= 3)), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)
    SELECT q.id AS qid, b.id AS id, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 6) AS score FROM sh q JOIN sh b ON q.s = b.s AND q.id <> b.id AND q.id % 100 = 0 JOIN n x ON x.id = q.id JOIN n y ON y.id = b.id
    GROUP BY q.id, b.id, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.3""")
def q22_similar_patterns(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks")
    return P.similar_snippets(c, c.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("text").alias("snippet")), 0.3).filter("qid <> id")


@query("c6_clusters")
def c6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return P.greedy_clusters(v.select(F.col("label").cast("string").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.3)


@query("q21_implementations", over_planted(r"""WITH c AS (SELECT DISTINCT buffer_id, regexp_extract(h, 'class\s+(\w+)', 1) AS cls, trim(unnest(string_split(regexp_extract(h, '\(([^)]*)\)', 1), ','))) AS base FROM (SELECT buffer_id, unnest(regexp_extract_all(text, 'class\s+\w+\s*\([^)]+\)')) AS h FROM chunks WHERE type = 'class'))
    SELECT buffer_id, cls, base, 'direct' AS via FROM c WHERE base <> '' UNION SELECT a.buffer_id, a.cls, b.base, 'transitive' FROM c a JOIN c b ON a.base = b.cls AND a.buffer_id = b.buffer_id WHERE b.base <> ''"""))
def q21_implementations(spark: SparkSession, folder: str) -> DataFrame:
    return P.implementations(planted(spark, folder))


#: Groups of the vectors by label: the mean of each, at unit length, is the centre of an intent.
INTENTS = f"""m AS (SELECT label AS cluster, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL GROUP BY ALL), z AS (SELECT cluster, sqrt(sum(x * x)) AS z FROM m GROUP BY cluster),
    near AS (SELECT q.vec_id AS qid, m.cluster::BIGINT AS id, round(sum(q.embedding[m.i]::DOUBLE * (m.x / z.z)::FLOAT::DOUBLE), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN m JOIN z USING (cluster) GROUP BY ALL)"""


@query("q24_intents", f"WITH {INTENTS} SELECT * FROM {top('near', 3)}")
def q24_intents(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    centres = S.intent_centres(v.select(F.col("label").cast("bigint").alias("cluster"), F.col("embedding").alias("v")))
    return S.vector_search(centres, "cluster", "v", v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 3)


DIRTY = "dirty AS (SELECT DISTINCT buffer_id, path AS file FROM source_files WHERE file_id % 3 = 0)"


def dirty_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_files").filter("file_id % 3 = 0").select("buffer_id", F.col("path").alias("file")).distinct()


@query("q18_modified_only", f"""WITH {NEAREST}, {IMPORTS}, {DIRTY}, r AS (SELECT * FROM {top('near', 50)}), sc AS (SELECT buffer_id, file, max(e) AS is_edited FROM (SELECT buffer_id, file, true AS e FROM dirty UNION ALL SELECT t.buffer_id, t.target, false FROM targets t JOIN dirty d ON t.buffer_id = d.buffer_id AND t.file = d.file) GROUP BY ALL),
    k AS (SELECT r.qid, r.id, r.score, sc.is_edited FROM r JOIN chunks c ON c.chunk_id = r.id JOIN sc ON sc.buffer_id = c.buffer_id AND sc.file = c.file QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r.score DESC, r.id) <= 10) SELECT qid, id, score, is_edited, row_number() OVER (PARTITION BY qid ORDER BY is_edited DESC, score DESC, id)::INT AS rank FROM k""")
def q18_modified_only(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks")
    return S.modified_only(nearest(spark, folder, 50).drop("rank"), c, dirty_files(spark, folder), G.import_targets(c))


@query("q19_scope_estimate", f"WITH {DIRTY}, a AS (SELECT buffer_id, count(DISTINCT file) AS files FROM chunks GROUP BY ALL), d AS (SELECT buffer_id, count(*) AS n FROM dirty GROUP BY ALL) SELECT a.buffer_id, coalesce(n, 0) * 10 AS searched, greatest(0, (files - coalesce(n, 0)) * 10) AS skipped, round(greatest(1.0, files * 10 / greatest(coalesce(n, 0) * 10, 1)), 1)::DOUBLE AS speedup FROM a LEFT JOIN d USING (buffer_id)")
def q19_scope_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return S.scope_estimate(table(spark, folder, "chunks"), dirty_files(spark, folder))


@query("q26_why", f"""WITH {CALL}, {NEAREST}, {IMPORTS}, {DIRTY}, r AS (SELECT r.qid, r.id, r.score, c.buffer_id, c.file, 0.3 * (contains(lower(c.file), 'config')::INT + contains(lower(c.file), 'core')::INT) AS kw FROM {top('near', 20)} r JOIN chunks c ON c.chunk_id = r.id),
    bc AS (SELECT DISTINCT t.buffer_id, t.file FROM edges e JOIN chunks s ON s.chunk_id = e.src JOIN dirty d ON d.buffer_id = s.buffer_id AND d.file = s.file JOIN chunks t ON t.chunk_id = e.dst), bi AS (SELECT DISTINCT t.buffer_id, t.target AS file FROM targets t JOIN dirty d ON t.buffer_id = d.buffer_id AND t.file = d.file),
    w AS (SELECT r.qid, r.id, list_filter([CASE WHEN d.file IS NOT NULL THEN {{'c': 1.0::DOUBLE, 'n': 'edited'}} END, CASE WHEN bc.file IS NOT NULL THEN {{'c': 0.95::DOUBLE, 'n': 'called'}} END, CASE WHEN bi.file IS NOT NULL THEN {{'c': 0.9::DOUBLE, 'n': 'imported'}} END, CASE WHEN r.score > 0.5 THEN {{'c': 0.85::DOUBLE, 'n': 'semantic'}} END, CASE WHEN kw > 0 THEN {{'c': least(0.9, kw)::DOUBLE, 'n': 'keyword'}} END], lambda x: x IS NOT NULL) AS l
      FROM r LEFT JOIN dirty d ON d.buffer_id = r.buffer_id AND d.file = r.file LEFT JOIN bc ON bc.buffer_id = r.buffer_id AND bc.file = r.file LEFT JOIN bi ON bi.buffer_id = r.buffer_id AND bi.file = r.file)
    SELECT qid, id, coalesce(l[1].n, 'none') AS reason, round(coalesce(l[1].c, 0), 4)::DOUBLE AS confidence, coalesce(array_to_string(list_transform(l, lambda x: x.n), ','), '') AS reasons FROM w""")
def q26_why(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks")
    return P.annotated_results(nearest(spark, folder, 20), c, "the config of core", dirty_files(spark, folder), G.call_edges(c), G.import_targets(c))


@query("q27_adapted", "SELECT user_id, count(*) AS n, min(operation || CASE lower(role) WHEN 'reviewer' THEN ' review refactor improve' WHEN 'debugger' THEN ' error bug exception fail' WHEN 'architect' THEN ' interface api design public' WHEN 'documenter' THEN ' documentation example guide' ELSE '' END) AS query FROM (SELECT user_id, operation, CASE length(operation) % 5 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'debugger' WHEN 2 THEN 'architect' WHEN 3 THEN 'documenter' END AS role FROM audit_log) GROUP BY user_id")
def q27_adapted(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("operation") % 5
    profile = F.when(n == 0, "reviewer").when(n == 1, "debugger").when(n == 2, "architect").when(n == 3, "documenter")
    return table(spark, folder, "audit_log").groupBy("user_id").agg(F.count("*").alias("n"), F.min(S.adapted(F.col("operation"), profile)).alias("query"))


@query("x6_query_cache", f"""WITH a AS (SELECT vec_id AS id, label AS buffer_id, 'Query ' || (vec_id // 3) AS query, embedding AS v FROM embeddings WHERE vec_id % 2 = 0), c AS (SELECT vec_id AS cached, label AS buffer_id, lower(trim(' QUERY ' || (vec_id // 3) || ' ')) AS key, embedding AS cv FROM embeddings WHERE vec_id % 2 = 1),
    e AS (SELECT a.id, min(cached) AS ex FROM a JOIN c ON a.buffer_id = c.buffer_id AND lower(trim(a.query)) = c.key GROUP BY a.id), s AS (SELECT a.id, min(cached) AS si FROM a JOIN c ON a.buffer_id = c.buffer_id WHERE a.id NOT IN (SELECT id FROM e) AND round({DOT.format(a='a.v', b='c.cv')}, 6) >= 0.3 GROUP BY a.id)
    SELECT a.id, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN si IS NOT NULL THEN 'similar' ELSE 'miss' END AS kind, coalesce(ex, si) AS hit FROM a LEFT JOIN e USING (id) LEFT JOIN s USING (id)""")
def x6_query_cache(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("buffer_id"), F.floor(F.col("vec_id") / 3).alias("n"), F.col("embedding").alias("v"))
    cache = v.filter("id % 2 = 1").select(F.col("id").alias("cached"), "buffer_id", F.concat(F.lit(" QUERY "), F.col("n"), F.lit(" ")).alias("query"), "v")
    return S.cached_queries(cache, v.filter("id % 2 = 0").select("id", "buffer_id", F.concat(F.lit("Query "), F.col("n")).alias("query"), "v"), 0.3)
