"""Small cases of the operators of the core, worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chunkwright.functions import text as T
from chunkwright.operators import analyzers as A
from chunkwright.operators import graph as G
from chunkwright.operators import history as H
from chunkwright.operators import packing as P
from chunkwright.operators import search as S
from chunkwright.sources import code as C

CHUNK = "chunk_id BIGINT, file STRING, start_line INT, end_line INT, type STRING, name STRING, text STRING, language STRING, imports ARRAY<STRING>"


def chunks(spark, *rows):
    full = [(i, f, s, s + t.count("\n") if t else s, kind, name, t, "python", imp) for i, f, s, kind, name, t, imp in rows]
    return spark.createDataFrame(full, CHUNK)


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="parseJSONFile my_var2X é") == ["parse", "jsonfile", "my", "var2", "x"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


def test_shingles(spark):
    w = spark.createDataFrame([("a b c d e",), ("a b",), ("",)], "t STRING").select(T.words(F.col("t")).alias("w")).select(F.size(T.shingles(F.col("w"))).alias("n"))
    assert [r.n for r in w.collect()] == [2, 1, 1]


def test_language(spark):
    for path, lang in (("a/b.py", "python"), ("Dockerfile.dev", "dockerfile"), ("x.TSX", "typescript"), ("none", None), ("CMakeLists.txt", "cmake")):
        assert one(spark, T.language_of(F.col("p")), p=path) == lang
    assert one(spark, T.language_of(F.col("p"), F.col("h")), p="a.py", h="C++") == "cpp"
    assert one(spark, T.language_of(F.col("p"), None, F.col("l")), p="run", l="#!/usr/bin/env python3") == "python"


def test_intent(spark):
    assert one(spark, T.intent(F.col("t")), t="Fix the crash").category == "bug_fix"
    assert one(spark, T.intent(F.col("t")), t="zzz").category == "unknown"


def test_measures(spark):
    code = 'def f(a, b):\n    """Doc."""\n    if a and b:\n        return 1\n'
    assert one(spark, T.complexity(F.col("t")), t=code) == 3
    assert one(spark, T.nesting(F.col("t")), t=code) == 2
    assert one(spark, T.docstring(F.col("t")), t=code) == "Doc."
    assert one(spark, A.parameters(F.col("t")), t="def g(self, a,\n b, *c): pass") == 3


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(0, "python search engine"), (1, "cooking recipes"), (2, None), (3, "")], "id BIGINT, text STRING")
    q = spark.createDataFrame([(1, "python search")], "qid BIGINT, query STRING")
    found = S.bm25(docs, "id", "text", q, 5).collect()
    assert [r.id for r in found] == [0] and found[0].rank == 1
    a = spark.createDataFrame([(1, i, r) for r, i in enumerate((0, 1, 2), 1)], "qid BIGINT, id BIGINT, rank INT")
    b = spark.createDataFrame([(1, i, r) for r, i in enumerate((1, 3, 0), 1)], "qid BIGINT, id BIGINT, rank INT")
    assert {r.id for r in S.fused(a, b, 10).collect()} == {0, 1, 2, 3}
    assert [r.id for r in S.fused(a, b.limit(0), 10).orderBy("rank").collect()] == [0, 1, 2]


def test_search_checks():
    for bad in (("", 5, 0), ("x", 0, 0), ("x", 5, -1), ("x", 20_000, 0)):
        with pytest.raises(ValueError):
            S.check_search(*bad)
    assert S.index_kind(5)["kind"] == "flat" and S.index_kind(20_000)["nlist"] == 141 and S.index_kind(10**6)["kind"] == "hnsw"


def test_vector_search_ties_and_recall(spark, folder):
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    exact = {(r.qid, r.id) for r in S.vector_search(v, "vec_id", "embedding", q, 10, 2).collect()}
    assert exact == {(r.qid, r.id) for r in S.vector_search(v, "vec_id", "embedding", q, 10).collect()}
    index, centres = S.inverted_file(v, "vec_id", "embedding", 16)
    assert index.count() == v.count()
    probe = S.calibrated_probe(index, centres, v, "vec_id", "embedding", q, 10, 0.9)
    near = {(r.qid, r.id) for r in S.inverted_file_search(index, centres, q, 10, probe).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and 1 <= probe <= 16
    assert S.vector_search(v, "vec_id", "embedding", q.limit(0), 3).count() == 0


def test_top_scores_in_parts():
    import numpy as np

    rng = np.random.default_rng(1)
    scores = np.round(rng.standard_normal((7, 500)), 1)  # many ties
    ids = rng.permutation(500)
    best = S.TopScores(7, 9)
    for at in range(0, 500, 33):
        best.add(scores[:, at : at + 33], ids[at : at + 33])
    got = [[(int(i), float(s)) for q, i, s in zip(*best.held, strict=True) if q == k] for k in range(7)]
    assert got == [[(int(i), float(s)) for s, i in sorted(((-x, i) for x, i in zip(row, ids, strict=True)))[:9] for s in [-s]] for row in scores]


def test_buckets_and_cache(spark):
    hits = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.99, 0.97, 0.8, 0.78, 0.5))], "qid BIGINT, id BIGINT, score DOUBLE")
    assert {r.id: r.bucket for r in S.score_buckets(hits, 0.95).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}
    assert {r.bucket: r.advice for r in S.bucket_facts(S.score_buckets(hits, 0.95), 0.95).collect()} == {1: "create_helper", 2: "create_helper", 3: "review_individually"}
    row = "buffer_id STRING, query STRING, v ARRAY<FLOAT>"
    cache = spark.createDataFrame([(1, "b", "Load file", [1.0, 0.0]), (2, "c", "Load file", [1.0, 0.0])], "cached BIGINT, " + row)
    asked = spark.createDataFrame([(1, "b", " load FILE", [0.0, 1.0]), (2, "b", "read", [1.0, 0.01]), (3, "b", "x", [0.0, 1.0])], "id BIGINT, " + row)
    assert {r.id: (r.kind, r.hit) for r in S.cached_queries(cache, asked).collect()} == {1: ("exact", 1), 2: ("similar", 1), 3: ("miss", None)}


def test_matches_span_lines(spark):
    c = chunks(spark, (1, "a.py", 10, "function", "f", "x = 1\nreturn\n  y\nreturn z", None))
    assert [(r.line, r.n) for r in S.matches(c, r"return\s+\w+").orderBy("n").collect()] == [(11, 0), (13, 1)]


def test_packing(spark):
    c = chunks(spark, *[(i, "a.py", 1, "function", f"f{i}", "x" * 40 * i, None) for i in range(1, 5)])
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 5)], "qid BIGINT, id BIGINT, rank INT")
    got = P.packed(ranked, c, 35).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [1, 2] and max(r.used for r in got) <= 35
    assert P.unique_texts(chunks(spark, (1, "a", 1, "f", None, "A b", None), (2, "a", 1, "f", None, "a  B", None), (3, "a", 1, "f", None, None, None))).count() == 1


def test_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(40))
    c = chunks(spark, (1, "a", 1, "f", None, base, None), (2, "b", 1, "f", None, base, None), (3, "c", 1, "f", None, base + " tail", None), (4, "d", 1, "f", None, "other words here now", None), (5, "e", 1, "f", None, None, None))
    assert {(r.chunk_a, r.chunk_b): r.similarity for r in P.duplicates(c, 0.85).collect()} == {(1, 2): 1.0, (1, 3): 0.9737, (2, 3): 0.9737}


def test_greedy_clusters(spark):
    v = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("p", 2, [1.0, 0.1]), ("p", 3, [0.0, 1.0]), ("q", 4, [1.0, 0.0])], "part STRING, id BIGINT, v ARRAY<DOUBLE>")
    assert sorted((r.cluster, r.id) for r in P.greedy_clusters(v, 0.75).collect()) == [(1, 1), (1, 2)]


def test_rules(spark):
    c = chunks(spark, (1, "a.py", 5, "function", "f", "x = eval(y)\ntry:\n    pass\nexcept:\n    password = 'a'\nyaml.load(f)\nyaml.load(f, Loader=L)", None))
    got = sorted((r.kind, r.line) for r in A.found(c, A.SECURITY).collect())
    assert got == [("broad_except", 8), ("eval_usage", 5), ("hardcoded_secret", 9), ("unsafe_yaml", 10)]
    hot = chunks(spark, (1, "a.py", 1, "function", "f", "for u in User.objects.all():\n    q = open('x')\n", None))
    assert {r.kind for r in A.found(hot, A.HOTSPOTS, "s").collect()} == {"n_plus_one", "unclosed_file"}
    dep = chunks(spark, (1, "a.py", 1, "function", "f", "@deprecated\ndef f():\n    # DEPRECATED soon\n    warnings.warn('deprecated', DeprecationWarning)", None))
    assert {r.kind for r in A.found(dep, A.DEPRECATED).collect()} == {"decorator", "comment", "warning", "deprecation_warning"}


def test_long_text_is_linear(spark):
    c = chunks(spark, (1, "a.py", 1, "function", "f", "secret " + "x y\n" * 100_000, None))
    assert [r.line for r in A.found(c, A.SECURITY).collect()] == [1]


def test_configuration_endpoints_todos(spark):
    text = "a = os.environ.get('URL', 'x')\nb = os.getenv(\"KEY\")\nopen('app.yaml')\n@app.get('/users')\nasync def users(): pass\n# TODO(ann): tidy up\n# FIXME"
    c = chunks(spark, (1, "a.py", 3, "function", "f", text, None))
    assert {(r.kind, r["name"], r.default) for r in A.configuration(c).collect()} == {("env", "URL", "x"), ("env", "KEY", None), ("file", "app.yaml", None)}
    assert [(r.verb, r.path, r.handler) for r in A.endpoints(c).collect()] == [("GET", "/users", "users")]
    assert [(r.line, r.tag, r.assignee, r.todo) for r in A.todos(c).collect()] == [(8, "TODO", "ann", "tidy up")]


def test_syntax_facts(spark):
    c = chunks(spark, (1, "a.py", 1, "method", "f", "    def f(self):\n        import os\n        return eval('1')", None), (2, "a.py", 9, "function", "g", "def g(:", None))
    assert {r.chunk_id: (r.parses, r.violations) for r in A.syntax_facts(c).collect()} == {1: (True, ["call eval", "import os"]), 2: (False, [])}


def test_graph(spark):
    c = chunks(
        spark, (1, "a.py", 1, "function", "main", "def main():\n    load(); util.save()", ["pkg.util"]), (2, "pkg/util.py", 1, "function", "load", "def load():\n    save()", None),
        (3, "pkg/util.py", 5, "function", "save", "def save():\n    return 1", None), (4, "tests/test_a.py", 1, "function", "test_load", "def test_load():\n    load()", None),
    )
    edges = {(r.src, r.dst) for r in G.call_edges(c).collect()}
    assert edges == {(1, 2), (1, 3), (2, 3), (4, 2)}
    assert {(r.file, r.target) for r in G.import_targets(c).collect()} == {("a.py", "pkg/util.py")}
    assert {r.symbol for r in G.dead_code(c).filter("confidence = 'high'").collect()} == {"main", "test_load"}
    reach = G.reachable(G.call_edges(c), c.filter("chunk_id = 1").selectExpr("chunk_id AS start"), 5).collect()
    assert {(r.node, r.depth) for r in reach} == {(1, 0), (2, 1), (3, 1)}
    risk = {r.symbol: (r.callers, r.untested, r.level) for r in G.impact(c, spark.createDataFrame([("save",), ("main",)], "symbol STRING")).collect()}
    assert risk["save"][0] == 3 and risk["save"][1] is False and risk["main"] == (0, True, "low")
    assert {(r.file, r.tests) for r in G.coverage(c).collect()} >= {("pkg/util.py", 1)}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "src STRING, dst STRING")
    assert {r.cycle for r in G.cycles(loop).collect()} == {"a > b", "a > b > c"}
    assert [r.node for r in G.shortest_path(loop, "a", "c").orderBy("step").collect()] == ["a", "b", "c"]
    assert G.shortest_path(loop, "a", "zz").count() == 0
    assert any(r.cyclic for r in G.execution_paths(loop, spark.createDataFrame([("a",)], "start STRING"), 3).collect())


def test_states_and_differences(spark):
    log = spark.createDataFrame([("b", 1, "ready"), ("b", 2, "dirty"), ("b", 3, "rebuilding"), ("b", 4, "dirty")], "buffer_id STRING, seq INT, state STRING")
    assert [(r.before, r.state) for r in H.invalid_transitions(log).collect()] == [("rebuilding", "dirty")]
    v = lambda *x: spark.createDataFrame([("b", *y) for y in x], "buffer_id STRING, path STRING, hash STRING")
    got = {r.path: r.state for r in H.conflicts(v(("a", "1"), ("b", "2"), ("c", "3")), v(("a", "1"), ("b", "1"), ("c", "1")), v(("a", "9"), ("b", "1"), ("c", "4"))).collect()}
    assert got == {"a": "buffer", "b": "disk", "c": "conflict"}
    f = lambda t: spark.createDataFrame([("p", t)], "path STRING, content STRING")
    ours = H.merged_lines(f("a\nb\nc"), f("a\nB\nc"), f("a\nb\nc\nd")).first()
    assert (ours.merged, ours.conflict) == ("a\nB\nc\nd", False)
    assert H.merged_lines(f("a\nb\nc"), f("a\nX\nc"), f("a\nY\nc")).first().conflict
    old, new = (spark.createDataFrame([(1, t)], "k BIGINT, t STRING") for t in ("a\nb\nc", "a\nx\nc\nd"))
    assert sorted(r.line for r in H.changed_lines(old, new, "k", "t").collect()) == [2, 4]
    assert "+x" in H.unified_diffs(old, new, "k", "t").first().diff


def test_redo_and_test_runs(spark):
    log = spark.createDataFrame([("b", i, a) for i, a in enumerate(("edit", "edit", "undo", "undo", "undo", "redo", "edit", "redo"))] + [(None, 1, "edit")], "branch STRING, seq INT, action STRING")
    assert [(r.branch, r.undoable, r.redoable) for r in H.redo_stacks(log).collect()] == [("b", 2, 0)]
    runs = spark.createDataFrame([("a", "FAILED tests/x.py::t - E\n=== 3 passed, 1 failed, 2 skipped in 0.05s"), ("b", ""), ("c", None)], "run STRING, output STRING")
    assert {r.run: (r.passed, r.failed, r.skipped, r.total, r.failures) for r in H.test_run_summary(runs).collect()} == {"a": (3, 1, 2, 6, "tests/x.py::t"), "b": (0, 0, 0, 0, "")}


def test_signatures_against_the_parser(spark, folder):
    import ast
    import textwrap

    from chunkwright.operators.interfaces import parsed_signatures

    odd = ["def f(a: Dict[str, List[int]] = {'x': (1, 2)}, *args, b='a,b)', **kw) -> Tuple[int, str]:\n    pass", "async def g(self,\n    x: int = 3,  # note, with a comma\n):\n    def h(q): return q", "def broken(a, b", "class A:\n    def m(cls, *, key=lambda x: x): pass"]
    seen = 0
    for text in odd + [r.text for r in spark.read.parquet(f"{folder}/chunks.parquet").filter("lower(trim(language)) = 'python' AND text IS NOT NULL").select("text").collect()]:
        try:
            tree = ast.parse(textwrap.dedent(text))
        except (SyntaxError, ValueError):
            continue
        wanted = []
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                a = node.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if x.arg not in ("self", "cls")]
                wanted.append((node.name, names, isinstance(node, ast.AsyncFunctionDef)))
        got = [(n, [p[0] for p in ps], is_async) for n, ps, _, is_async in parsed_signatures(text)]
        assert all(w in got for w in wanted)  # definitions written in a string are found as well
        seen += len(wanted)
    assert seen > 50
    assert parsed_signatures(odd[0])[0][1][0] == ("a", "Dict[str, List[int]]", "{'x': (1, 2)}") and parsed_signatures(odd[0])[0][2] == "Tuple[int, str]"


def test_names_mean_something_in_their_buffer_only(spark):
    c = chunks(spark, (1, "a.py", 1, "function", "f", "def f():\n    g()", None), (2, "a.py", 5, "function", "g", "def g(): pass", None), (3, "a.py", 1, "function", "g", "def g(): pass", None), (4, "t/test_x.py", 1, "function", "t", "g()", ["a"]))
    c = c.withColumn("buffer_id", F.when(F.col("chunk_id") < 3, "x").otherwise("y"))
    assert {(r.src, r.dst) for r in G.call_edges(c).collect()} == {(1, 2), (4, 3)}
    assert {(r.buffer_id, r.symbol): r.callers for r in G.dead_code(c).collect()} == {("x", "f"): 0, ("x", "g"): 1, ("y", "g"): 1, ("y", "t"): 0}
    assert {(r.buffer_id, r.file, r.target) for r in G.import_targets(c).collect()} == {("y", "t/test_x.py", "a.py")}
    assert {(r.buffer_id, r.symbol): r.callers for r in G.impact(c, c.select("buffer_id", F.col("name").alias("symbol"))).collect()}[("x", "g")] == 1
    assert sorted((r.buffer_id, r.chunks) for r in A.file_summary(c).collect()) == [("x", 2), ("y", 1), ("y", 1)]
    assert {(r.buffer_id, r.symbol): (r.callers, r.tests) for r in G.full_context(c).collect()}[("y", "g")] == (0, "t/test_x.py")


def test_brace_languages():
    js = "import x from 'y';\n\nclass K {\n    run(a) { return \"}\"; }\n}\n\nconst f = (a) => {\n    if (a) { g(); }\n};\n"
    assert C.cut_chunks("a.js", js) == [(1, 1, "orphan", None), (3, 5, "class", "K"), (4, 4, "method", "run"), (7, 9, "function", "f")]
    go = "package p\n\n// func no() {\nfunc (s *S) Load(x interface{}) map[string]interface{} {\n    return nil\n}\n\ntype S struct {\n    a int\n}\n"
    assert [x[2:] for x in C.cut_chunks("a.go", go) if x[3]] == [("method", "Load"), ("class", "S")]
    java = "public class A {\n    public <T> List<T> find(Map<String, T> m) throws E {\n        return x(m);\n    }\n    private int n = call(1);\n}\n"
    assert C.cut_chunks("A.java", java) == [(1, 6, "class", "A"), (2, 4, "method", "find")]
    assert C.cut_chunks("a.js", "x = 1\n") == [(1, 2, "sliding", None)]


def test_own_chunk_handler(spark):
    files = spark.createDataFrame([(1, "a.txt", "x\ny")], "id BIGINT, path STRING, content STRING")
    got = C.definition_chunks(files, "id", "path", "content", handler=lambda p, t: [(2, 2, "line", p)]).first()
    assert (got.type, got["name"], got.text) == ("line", "a.txt", "y")


def test_histogram_index(spark):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 7)], "k STRING, v INT")
    got = {r.k: (r.p50, r.p95, r.p99) for r in H.histogram(rows, "k", "v").collect()}
    assert got == {"a": (50, 95, 99), "b": (0, 0, 0)}


def test_chunker(spark):
    text = "import os\n\n\ndef f():\n    def g():\n        pass\n    return g\n\n\nclass A:\n    def m(self):\n        pass\n"
    files = spark.createDataFrame([(1, "a.py", text), (2, "b.go", "x\n" * 70), (3, "c.py", "def ("), (4, "d.py", None), (5, "e.py", "")], "id BIGINT, path STRING, content STRING")
    got = C.definition_chunks(files, "id", "path", "content").collect()
    assert [(r.type, r.name) for r in sorted((x for x in got if x.id == 1), key=lambda r: r.start_line)] == [("orphan", None), ("function", "f"), ("nested_function", "g"), ("class", "A"), ("nested_function", "m")]
    assert [(r.start_line, r.end_line) for r in got if r.id == 2] == [(1, 30), (26, 55), (51, 71)]
    assert [r.type for r in got if r.id == 3] == ["sliding"]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    rows = C.read_folder(spark, str(tmp_path / "src")).collect()
    assert [(r.path, r.lines, r.size) for r in rows] == [("a.py", 2, 6)]
    (tmp_path / "log.jsonl").write_text(json.dumps({"timestamp": 1.5, "operation": "read", "status": "success"}) + "\nbroken{\n")
    assert [(r.ts, r.operation) for r in C.read_audit(spark, str(tmp_path / "log.jsonl")).collect()] == [(1.5, "read")]
    (tmp_path / "git.txt").write_text("commit abc|ann|100\n\na.py\nb.py\ncommit def|bo|200\n\na.py\n")
    assert sorted((r.commit, r.file) for r in C.read_git_log(spark, str(tmp_path / "git.txt")).collect()) == [("abc", "a.py"), ("abc", "b.py"), ("def", "a.py")]


def test_audit_filters(spark):
    a = spark.createDataFrame([(1.0, "read", "u", "success"), (2.0, "write", "u", "error"), (3.0, "write", None, "success")], "ts DOUBLE, operation STRING, user_id STRING, status STRING")
    assert [r.ts for r in H.audit_filter(a, operations=["write"], since=2.0, limit=1).collect()] == [3.0]
    assert {(r.dimension, r.value): r.n for r in H.audit_stats(a).collect()}[("total", None)] == 3


def test_empty_tables(spark):
    e = chunks(spark).limit(0)
    for df in (A.found(e, A.SECURITY), A.smells(e), A.quality(e), A.todos(e), G.call_edges(e), G.dead_code(e), G.import_targets(e), P.duplicates(e), A.configuration(e), A.nested_loops(e)):
        assert df.count() == 0


def test_dates(spark):
    b = spark.createDataFrame([("a", dt.datetime(2025, 1, 1)), ("b", dt.datetime(2025, 1, 30))], "buffer_id STRING, modified_at TIMESTAMP")
    d = spark.createDataFrame([("b",)] * 6, "buffer_id STRING")
    got = {r.buffer_id: r.level for r in H.health(b, d, F.lit("2025-02-01").cast("date")).collect()}
    assert got == {"a": "degraded", "b": "warning"}
