"""Edits, embeddings and permissions in small cases."""

from pyspark.sql import functions as F

from chunkwright.operators import edits as E
from chunkwright.operators import graph as G
from chunkwright.operators import packing as P
from chunkwright.operators.embedding import embedded


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t STRING").select(expr.alias("x")).first().x


def test_imports(spark):
    t = "import os\nfrom a import b\n\nx = 1"
    assert one(spark, E.import_added(F.col("t"), "sys"), t) == "import os\nfrom a import b\nimport sys\n\nx = 1"
    assert one(spark, E.import_added(F.col("t"), "os"), t) == t
    assert one(spark, E.import_added(F.col("t"), "os"), "x = 1") == "import os\nx = 1"
    assert one(spark, E.import_removed(F.col("t"), "a"), t) == "import os\n\nx = 1"
    assert one(spark, E.import_added(F.col("t"), "os"), None) is None


def test_symbols(spark):
    assert one(spark, E.renamed(F.col("t"), "a", "b"), "a + aa + a.x") == "b + aa + b.x"
    assert one(spark, E.parameter_added(F.col("t"), "f", "z"), "def f(x, y): pass\ndef g(): pass") == "def f(x, y, z): pass\ndef g(): pass"
    assert one(spark, E.parameter_added(F.col("t"), "g", "z"), "def f(x, y): pass\ndef g(): pass") == "def f(x, y): pass\ndef g(z): pass"
    assert one(spark, E.mended(F.col("t")), "try:  \n  pass\nexcept:\n  x == None") == "try:\n  pass\nexcept Exception:\n  x is None"


def test_patch(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n5"), ("b", "1\n2"), ("c", "x\n1\n2\n3\n4\n5")], "path STRING, content STRING")
    p = "--- a\n+++ a\n@@ -2,3 +2,3 @@\n 2\n-3\n+three\n 4"
    patches = spark.createDataFrame([("a", p), ("b", p), ("c", p)], "path STRING, patch STRING")
    got = {r.path: (r.patched, r.applied) for r in E.patched(files, patches).collect()}
    assert got == {"a": ("1\n2\nthree\n4\n5", True), "b": ("1\n2", False), "c": ("x\n1\n2\nthree\n4\n5", True)}


def test_embedding(spark):
    d = spark.createDataFrame([(1, "load the file"), (2, "load the file"), (3, None), (4, "")], "id BIGINT, text STRING").selectExpr("*", "1 AS h", "2 AS k")
    got = {r.id: list(r.embedding) for r in embedded(d, "id", "text").collect()}
    assert got[1] == got[2] and set(got) == {1, 2, 4} and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[4])


def test_permissions(spark):
    a = spark.createDataFrame([("write_code", "viewer"), ("write_code", "admin"), ("write_code", None), ("read", "guest")], "operation STRING, role STRING")
    assert E.denied(a).count() == 2 and E.denied(a, {"read": "search"}).count() == 0
    own = spark.createDataFrame([("commit", "agent", "u", "b"), ("commit", "agent", "v", "b"), ("commit", "admin", "v", "b"), ("search", "agent", "v", "b")], "operation STRING, role STRING, user_id STRING, buffer_id STRING")
    assert [(r.operation, r.user_id) for r in E.denied(own, owners=spark.createDataFrame([("b", "u")], "buffer_id STRING, owner STRING")).collect()] == [("commit", "v")]
    assert {r.chunk_id for r in E.profiled(spark.createDataFrame([(1, "a.py", 1, 5, "assertion", 1.0), (2, "tests/a.py", 1, 100, "x", 1.0)], "chunk_id BIGINT, file STRING, start_line INT, end_line INT, type STRING, score DOUBLE")).filter("profile = 'debugger' AND priority = 1.5").collect()} == {1}


def test_similar_vectors_keeps_every_link(spark, tmp_path):
    from chunkwright.plans.core_queries import QUERIES

    rows = [(i, [1.0, 0.0] if i <= 150 else [0.0, 1.0]) for i in range(100, 300)]  # 149 links of 200
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.qid, r.id) for r in QUERIES["j8_similar_vectors"](spark, str(tmp_path)).collect()}
    assert found == {(100, i) for i in range(100, 151)} | {(200, i) for i in range(151, 300)}


def test_faceted_scores_every_row(spark, folder, duck):
    from chunkwright.plans.core_queries import QUERIES

    dot = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))"
    sql = f"""WITH c AS (SELECT *, lower(coalesce(name, '')) AS n FROM chunks WHERE lower(trim(language)) = 'python' AND end_line - start_line + 1 >= 3),
        s AS (SELECT q.vec_id AS qid, chunk_id AS id, 0.7 * round({dot}, 6) + 0.15 * (coalesce(contains(lower(text), 'load'), false)::INT + coalesce(contains(lower(text), 'token'), false)::INT) / 2.0
          + 0.15 * CASE WHEN n = 'load token' THEN 1.0 WHEN contains(n, 'load token') THEN 0.7 WHEN contains(n, 'load') OR contains(n, 'token') THEN 0.5 ELSE 0.0 END + CASE WHEN type = 'function' THEN 0.05 ELSE 0 END AS score
          FROM c JOIN embeddings v ON v.vec_id = chunk_id CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
        SELECT qid, round(score, 3)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10"""
    found = sorted((r.qid, r.score) for r in QUERIES["q11_faceted"](spark, folder).collect())
    wanted = sorted(duck.sql(sql).fetchall())
    assert len(found) == len(wanted) > 10
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 0.001001 for a, b in zip(found, wanted, strict=True))


def test_faceted_takes_rows_beyond_the_nearest(spark, tmp_path):
    from chunkwright.plans.core_queries import QUERIES

    near = [(i, f"f{i}", "text", "java") for i in range(100, 300)]
    far = [(300 + i, "load token", "load token", "python") for i in range(12)]
    chunks = [(i, "a.py", 1, 9, "function", n, t, lang) for i, n, t, lang in near + far]
    spark.createDataFrame(chunks, "chunk_id BIGINT, file STRING, start_line INT, end_line INT, type STRING, name STRING, text STRING, language STRING").write.parquet(f"{tmp_path}/chunks.parquet")
    vectors = [(i, [1.0, 0.0]) for i in range(100, 300)] + [(300 + i, [0.5, 0.5]) for i in range(12)]
    spark.createDataFrame(vectors, "vec_id BIGINT, embedding ARRAY<FLOAT>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["q11_faceted"](spark, str(tmp_path)).collect()
    assert {(r.qid, r.chunk_id) for r in rows} == {(q, 300 + i) for q in (100, 200, 300) for i in range(10)}


CHUNKS = "chunk_id BIGINT, file STRING, start_line INT, end_line INT, type STRING, name STRING, text STRING, language STRING, imports ARRAY<STRING>"


def test_impacted_by_file_evidence(spark):
    rows = [
        (1, "src/store.py", 1, 5, "function", "put", "def put(): pass", "python", []), (2, "tests/test_a.py", 1, 5, "function", "test_a", "run()", "python", ["lib.store"]),
        (3, "tests/test_b.py", 1, 5, "function", "test_b", "open('src/store.py')", "python", []), (4, "tests/test_c.py", 1, 5, "function", "test_c", "put()", "python", ["lib.store"]),
        (5, "tests/test_c.py", 6, 9, "function", "test_d", "x = 'storehouse'", "python", []), (6, "tests/test_e.py", 1, 5, "function", "test_e", "nothing", "python", None),
    ]
    found = G.impacted_tests(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("src/store.py", "put")], "file STRING, symbol STRING"))
    assert {(r.test_file, r.score) for r in found.collect()} == {("tests/test_a.py", 20), ("tests/test_b.py", 100), ("tests/test_c.py", 90)}
    assert [r.test_file for r in G.impacted_tests(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("src/store.py", "put")], "file STRING, symbol STRING"), 1).collect()] == ["tests/test_b.py"]


def test_related_has_all_sections(spark):
    rows = [
        (1, "src/store.py", 1, 5, "function", "put", "def put(): pass", "python", []), (2, "src/a.py", 1, 5, "function", "a", "put(1)", "python", []),
        (3, "src/b.py", 1, 5, "function", "b", "put(2)" + " " * 400, "python", []), (4, "tests/test_x.py", 1, 5, "function", "test_x", "go()", "python", ["store"]),
        (5, "src/k.py", 1, 9, "class", "K", "class K: ...", "python", []), (6, "src/k.py", 2, 3, "method", "put", "def put(self): 0", "python", []),
        (7, "src/c.py", 1, 5, "class", "C", "# like put", "python", []), (8, "src/d.py", 1, 5, "function", "d", "x = 1", "python", []), (9, "src/store.py", 7, 9, "function", "e", "y = 1", "python", []),
    ]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (8, [0.5, 0.5]), (9, [1.0, 0.0]), (2, [0.0, 1.0])], "id BIGINT, v ARRAY<FLOAT>")
    found = P.related_code(spark.createDataFrame(rows, CHUNKS), v, spark.createDataFrame([(1,)], "chunk_id BIGINT"), 60).collect()
    assert {(r.section, r.id, r.score) for r in found} == {("callers", 2, 30), ("tests", 4, 30), ("interfaces", 5, 90), ("interfaces", 7, 30), ("semantic", 8, 70.7107)}
    assert max(r.used for r in found) <= 60
