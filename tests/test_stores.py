"""Kept tables, git output, edits and streams' companions in small cases."""

import pytest
from pyspark.sql import functions as F

from chunkwright.operators import analyzers as A
from chunkwright.operators import graph as G
from chunkwright.operators import interfaces as I
from chunkwright.operators import packing as P
from chunkwright.operators.embedding import embedded
from chunkwright.sources import code as C
from chunkwright.sources import store as D
from chunkwright.sources import tables
from chunkwright.streaming.watch import Progress, drop_deleted, keep_chunks, watched_files

CHUNK = "buffer_id STRING, chunk_id BIGINT, file STRING, start_line INT, end_line INT, type STRING, name STRING, text STRING, language STRING, imports ARRAY<STRING>"


def chunk(i, text, name=None, kind="function", file="a.py", buffer="b", start=1):
    return (buffer, i, file, start, start + text.count("\n"), kind, name, text, "python", [])


def test_catalog(spark, tmp_path):
    c = D.Catalog(spark, f"file://{tmp_path}/cat")
    row = "buffer_id STRING, root_path STRING, state STRING, file_count INT, chunk_count INT"
    assert c.buffers().count() == 0
    c.register(spark.createDataFrame([("a", "/a", None, 1, 1), ("b", "/b", "rebuilding", 1, 1)], row))
    c.register(spark.createDataFrame([("a", "/new", "ready", 2, 2)], row))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "buffer_id STRING")
    assert [(r.buffer_id, r.state) for r in c.move(ids("a", "b"), "dirty").collect()] == [("b", "rebuilding")]
    assert {r.buffer_id: (r.root_path, r.state) for r in c.buffers().collect()} == {"a": ("/new", "dirty"), "b": ("/b", "rebuilding")}
    c.delete(ids("b", "zz"))
    assert [r.buffer_id for r in c.buffers().collect()] == ["a"]
    with pytest.raises(ValueError):
        c.move(ids("a"), "gone")


def test_git_output(spark, tmp_path):
    (tmp_path / "status").write_text(" M a.py\nR  old.py -> new.py\n?? b.py\n")
    assert [(r.staged, r.changed, r.file, r.was) for r in D.read_git_status(spark, str(tmp_path / "status")).collect()] == [(" ", "M", "a.py", None), ("R", " ", "new.py", "old.py"), ("?", "?", "b.py", None)]
    (tmp_path / "diff").write_text("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n c\n@@ -9 +10 @@\n-q\n+r\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -0,0 +1,2 @@\n+a\n+b\n")
    assert sorted((r.file, r.begin, r.stop) for r in D.read_git_diff(spark, str(tmp_path / "diff")).collect()) == [("x.py", 1, 3), ("x.py", 10, 10), ("y.py", 1, 2)]
    (tmp_path / "blame").write_text("a" * 40 + " 1 1 2\nauthor ann\n\tx = 1\n" + "a" * 40 + " 2 2\n\ty = 2\n")
    assert [(r.commit[:2], r.line) for r in D.read_git_blame(spark, str(tmp_path / "blame")).collect()] == [("aa", 1), ("aa", 2)]


def test_edits_in_order(spark):
    files = spark.createDataFrame([("b", "a.py", "1\n2\n3"), ("b", "c.py", "x")], "buffer_id STRING, path STRING, content STRING")
    log = spark.createDataFrame([("b", "a.py", 2, 1, 1, "one\nmore"), ("b", "a.py", 1, 3, 3, "three"), ("b", "a.py", 3, 9, 9, "end")], "buffer_id STRING, path STRING, seq INT, start_line INT, end_line INT, text STRING")
    assert [(r.path, r.content, r.edits) for r in D.edited_files(files, log).collect()] == [("a.py", "one\nmore\n2\nthree\nend", 3)]
    risks = spark.createDataFrame([("b", "a.py", "high")], "buffer_id STRING, file STRING, level STRING")
    assert not D.commit_allowed(files, risks).first().allowed and D.commit_allowed(files, risks, force=True).first().allowed


def test_blocks_and_break_points(spark):
    f = spark.createDataFrame([(1, "aa\nbb\ncc\n" + "d" * 30 + "\ne"), (2, None), (3, "")], "id BIGINT, text STRING")
    assert sorted((r.id, r.start_line, r.end_line) for r in C.blocks(f, "id", "text", 10).collect()) == [(1, 1, 4), (1, 5, 5), (3, 1, 1)]
    text = "import os\n\ndef f():\n    pass\n\nx = 1\ny = 2\n"
    at = lambda t, n, reach=5000: spark.createDataFrame([(t,)], "t STRING").select(C.break_point(F.col("t"), F.lit(n), reach).alias("x")).first().x
    assert at(text, 35) == text.index("def f") and at(text, 40, 8) == text.index("y = 2") and at("def a", 4) == 0


def test_documentation_and_types(spark):
    c = spark.createDataFrame([chunk(1, "def pay(amount: float, cur: str = 'EUR') -> bool:\n    return True", "pay"), chunk(2, "def test_pay():\n    pay(1.0)\n    pay(2, 'x')", "test_pay", file="tests/test_p.py"), chunk(3, "x = 1")], CHUNK)
    d = I.generated_documentation(c).filter("symbol = 'pay'").first()
    assert d.docstring == '"""pay documentation.\n\nArgs:\n    amount (float)\n    cur (str), default: \'EUR\'\n\nReturns:\n    bool\n"""' and d.examples == "pay(1.0)\npay(2, 'x')"
    assert ":param amount (float)\n" in I.generated_documentation(c, "sphinx").filter("symbol = 'pay'").first().docstring and "----------" in I.generated_documentation(c, "numpy").filter("symbol = 'pay'").first().docstring
    with pytest.raises(ValueError):
        I.generated_documentation(c, "plain")
    t = I.inferred_types(c, encode=embedded).filter("symbol = 'pay'").first()
    assert t.signature == "pay(amount: float, cur: str) -> bool" and 0 <= t.confidence <= 1
    old, new = (spark.createDataFrame(rows, "buffer_id STRING, file STRING, type STRING, symbol STRING, params STRING") for rows in ([("b", "a", "f", "x", "p,q"), ("b", "a", "f", "y", "p"), ("b", "a", "f", "z", "p")], [("b", "a", "f", "x", "p"), ("b", "a", "f", "y", "p,r"), ("b", "a", "f", "n", "")]))
    assert {r.symbol: (r.change, r.breaking, r.params_added) for r in I.interface_changes(old, new).collect()} == {"x": ("changed", True, ""), "y": ("changed", False, "r"), "z": ("removed", True, ""), "n": ("added", False, "")}


def test_what_the_tables_lack(spark):
    c = spark.createDataFrame([chunk(1, "def f():\n    x = 1\n    try:\n        g(x)\n    except E:\n        pass", "f"), chunk(2, "def g(x): pass", "g", start=9), chunk(3, "CACHE = {}\nN: list = []\n  y = {}", kind="orphan", start=20)], CHUNK)
    assert [(r.symbol, r.line, r.context) for r in G.error_contexts(c).collect()] == [("g", 3, "g(x)")]
    assert sorted(r["name"] for r in A.module_mutables(c).collect()) == ["CACHE", "N"]
    files = spark.createDataFrame([("b", i, f, 1, 1, "orphan", None, "x", "python", imp) for i, (f, imp) in enumerate([("p/alpha.py", ["p.beta"]), ("p/beta.py", ["p.alpha"]), ("p/gamma.py", ["p.alpha"])])], CHUNK)
    edges = G.import_targets(files).select(F.col("file").alias("src"), F.col("target").alias("dst"))
    assert [r.cycle for r in G.cycles(edges, 3).collect()] == ["p/alpha.py > p/beta.py"]


def test_greedy_clusters_brute(spark, folder):
    import numpy as np

    v = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.lit("p").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = sorted((r.id, np.array(r.v, dtype=float)) for r in v.collect())
    own, wanted = {}, set()
    for n, (i, x) in enumerate(rows):
        if i in own:
            continue
        mates = [j for j, y in rows[n + 1 : n + 65] if j not in own and x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-10) > 0.25]
        if mates:
            for j in [i, *mates]:
                own[j] = i
                wanted.add((i, j))
    assert {(r.cluster, r.id) for r in P.greedy_clusters(v, 0.25).collect()} == wanted and wanted


def test_stream_companions(spark, tmp_path):
    src, out, ck = (tmp_path / n for n in ("src", "out", "ck"))
    src.mkdir()
    for n in "abc":
        (src / f"{n}.py").write_text(f"def {n}():\n    pass\n")
    seen = []
    listener = Progress(lambda *x: seen.append(x))
    spark.streams.addListener(listener)
    keep_chunks(watched_files(spark, str(src)), str(out), str(ck), encode=embedded).awaitTermination()
    spark.streams.removeListener(listener)
    kept = spark.read.parquet(str(out)).filter("name IS NOT NULL")
    assert sorted(r["name"] for r in kept.collect()) == ["a", "b", "c"] and kept.filter("size(embedding) = 64").count() == 3
    (src / "b.py").unlink()
    present = spark.read.format("binaryFile").load(str(src)).select("path")
    assert drop_deleted(spark, str(out), present) == 1 and drop_deleted(spark, str(out), present) == 0
    assert sorted(r["name"] for r in spark.read.parquet(str(out)).filter("name IS NOT NULL").collect()) == ["a", "c"]
    assert not seen or seen[0][0] == "started"


def test_folders_and_spread(spark, tmp_path, monkeypatch):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert tables.single_file(spark, f"{tmp_path}/t.parquet") == -1 and tables.table(spark, str(tmp_path), "t").count() == 10
    one = next(p for p in (tmp_path / "t.parquet").iterdir() if p.name.endswith(".parquet"))
    one.rename(tmp_path / "u.parquet")
    assert 0 < tables.single_file(spark, f"{tmp_path}/u.parquet") < 256 << 10

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Cluster()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        tables.shared_folder(Session())
