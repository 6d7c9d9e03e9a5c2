"""Symbols, call and import graphs, reachability, impact and implicit joins between chunks.

Edges are rows; breadth-first searches go level by level as joins against the edges, with the frontier cut off from its
lineage at each level, and end at a depth bound or when nothing new is reached. Null names are no symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.tables import written


def buffered(rows: DataFrame) -> DataFrame:
    """``rows`` with a buffer_id that is never null: a buffer is a repository, and names and paths mean something within one only.

    Rows without the column, or with null in it, are one buffer of the empty name.
    """
    return rows.withColumn("buffer_id", F.coalesce("buffer_id", F.lit("")) if "buffer_id" in rows.columns else F.lit(""))


def definitions(chunks: DataFrame) -> DataFrame:
    """buffer_id, symbol, chunk_id, file, start_line, end_line, kind: what is defined where."""
    kind = F.when(F.col("type").isin("function", "nested_function", "lambda"), "function").when(F.col("type").isin("method", "class", "trait", "interface", "macro", "module"), F.col("type")).otherwise("variable")
    return buffered(chunks).filter("name IS NOT NULL").select("buffer_id", F.col("name").alias("symbol"), "chunk_id", "file", "start_line", "end_line", kind.alias("kind"))


def definition_of(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, symbol, chunk_id, file, start_line: definitions of names (buffer_id, asked); of a dotted name without one, those of its last part."""
    d = definitions(chunks)
    a = buffered(asked).select("buffer_id", "asked").distinct().withColumn("part", F.element_at(F.split("asked", r"\."), -1))
    each = a.select("buffer_id", "asked", F.explode(F.array(F.struct(F.lit(1).alias("way"), F.col("asked").alias("symbol")), F.struct(F.lit(2).alias("way"), F.col("part").alias("symbol")))).alias("s")).select("buffer_id", "asked", "s.way", "s.symbol")
    hit = each.join(d, ["buffer_id", "symbol"])
    best = F.min("way").over(Window.partitionBy("buffer_id", "asked"))
    return hit.withColumn("best", best).filter("way = best").select("buffer_id", "asked", "symbol", "chunk_id", "file", "start_line").distinct()


def call_sites(chunks: DataFrame) -> DataFrame:
    """buffer_id, chunk_id, file, caller, callee: the names each chunk calls, by their last part, without its own name."""
    rows = buffered(chunks).filter("text IS NOT NULL").select("buffer_id", "chunk_id", "file", F.col("name").alias("caller"), F.explode(T.calls(F.col("text"))).alias("c"))
    return rows.select("buffer_id", "chunk_id", "file", "caller", F.substring_index("c", ".", -1).alias("callee")).filter("caller IS NULL OR callee <> caller").distinct()


def call_edges(chunks: DataFrame) -> DataFrame:
    """src, dst, symbol: chunks calling chunks of their buffer; of several definitions of a symbol the last counts."""
    last = definitions(chunks).groupBy("buffer_id", F.col("symbol").alias("callee")).agg(F.max("chunk_id").alias("dst"))
    return call_sites(chunks).join(last, ["buffer_id", "callee"]).select(F.col("chunk_id").alias("src"), "dst", F.col("callee").alias("symbol")).filter("src <> dst").distinct()


def callees(chunks: DataFrame) -> DataFrame:
    """chunk_id, callee, file, confidence: where each callee is defined, else the caller's own file with medium confidence."""
    first = definitions(chunks).groupBy("buffer_id", F.col("symbol").alias("callee")).agg(F.min_by("file", "chunk_id").alias("dfile"))
    return call_sites(chunks).join(first, ["buffer_id", "callee"], "left").select("chunk_id", "callee", F.coalesce("dfile", "file").alias("file"), F.when(F.col("dfile").isNull(), "medium").otherwise("high").alias("confidence"))


def import_edges(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, module: what each file imports."""
    return buffered(chunks).select("buffer_id", "file", F.explode("imports").alias("module")).filter("module IS NOT NULL").distinct()


def import_targets(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, target: files of the buffer that an import may mean: its path is part of theirs, or its last part is part of their stem.

    Both sides are keyed by buffer and words of names before the exact test, so the test runs on an equi-join, not on all pairs.
    """
    e = import_edges(chunks).withColumn("p", F.translate("module", ".", "/")).withColumn("tail", F.element_at(F.split("p", "/"), -1)).filter("tail <> ''")
    stem = F.regexp_replace(T.base_name(F.col("file")), r"\.[^.]*$", "")
    f = buffered(chunks).select("buffer_id", "file").distinct().select("buffer_id", F.col("file").alias("target"), stem.alias("stem"))
    # A path that contains the tail has the tail's first letters, three or as many as it has, among its runs.
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    grams = lambda c: F.array_distinct(F.concat(runs(c, 1), runs(c, 2), runs(c, 3)))
    left = e.withColumn("g", F.substring("tail", 1, 3))
    # Runs that no import begins with needn't be exchanged.
    right = f.withColumn("path", F.col("target")).withColumn("g", F.explode(grams(F.col("target")))).join(left.select("buffer_id", "g").distinct(), ["buffer_id", "g"], "left_semi")
    hit = left.join(right, ["buffer_id", "g"]).filter((F.contains(F.col("path"), F.col("p")) | F.contains(F.col("stem"), F.col("tail"))) & (F.col("file") != F.col("target")))
    return hit.select("buffer_id", "file", "target").distinct()


def dependencies(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, direction, other: modules that each file imports (outgoing) and files that import it (incoming)."""
    out = import_edges(chunks).select("buffer_id", "file", F.lit("outgoing").alias("direction"), F.col("module").alias("other"))
    return out.unionByName(import_targets(chunks).select("buffer_id", F.col("target").alias("file"), F.lit("incoming").alias("direction"), F.col("file").alias("other"))).distinct()


def exported_graph(chunks: DataFrame) -> DataFrame:
    """buffer_id, kind, src, dst: the files (node), import edges between files and calls between symbols of each buffer, each once."""
    b = buffered(chunks)
    nodes = b.filter("file IS NOT NULL").select("buffer_id", F.lit("node").alias("kind"), F.col("file").alias("src"), F.lit(None).cast("string").alias("dst"))
    imports = import_edges(chunks).select("buffer_id", F.lit("import").alias("kind"), F.col("file").alias("src"), F.col("module").alias("dst"))
    calls = call_sites(chunks).filter("caller IS NOT NULL").select("buffer_id", F.lit("call").alias("kind"), F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return nodes.unionByName(imports).unionByName(calls).distinct()


def dead_code(chunks: DataFrame) -> DataFrame:
    """buffer_id, symbol, chunk_id, callers, confidence: definitions that no chunk of their buffer calls (high), or one or two do (low)."""
    used = call_sites(chunks).groupBy("buffer_id", F.col("callee").alias("symbol")).agg(F.countDistinct("chunk_id").alias("callers"))
    rows = definitions(chunks).join(used, ["buffer_id", "symbol"], "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return rows.filter("callers <= 2").select("buffer_id", "symbol", "chunk_id", "callers", F.when(F.col("callers") == 0, "high").otherwise("low").alias("confidence"))


def unused_imports(chunks: DataFrame) -> DataFrame:
    """chunk_id, file, module: imports whose last part begins no call in the same file."""
    b = buffered(chunks)
    each = b.select("buffer_id", "chunk_id", "file", F.explode("imports").alias("module")).filter("module IS NOT NULL").withColumn("tail", F.element_at(F.split("module", "[./]"), -1))
    whole = b.filter("text IS NOT NULL").select(F.col("buffer_id").alias("wb"), F.col("file").alias("f"), F.explode(T.calls(F.col("text"))).alias("c")).distinct()
    return each.join(whole, (F.col("buffer_id") == F.col("wb")) & (F.col("file") == F.col("f")) & F.startswith(F.col("c"), F.col("tail")), "left_anti").select("chunk_id", "file", "module").distinct()


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, depth: nodes reached from each start (start) over edges (src, dst) in at most ``depth`` steps, at the least depth."""
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    seen = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "seen")
    front, parts = seen, [seen]
    for d in range(1, depth + 1):
        new = front.join(edges, front.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        for p in parts:
            new = new.join(p.select("start", "node"), ["start", "node"], "left_anti")
        front = written(new.withColumn("depth", F.lit(d)), "front")
        if not front.limit(1).count():
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 10) -> DataFrame:
    """step, node: a shortest path over edges (src, dst), the least one by its nodes; no rows if there is none."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").distinct()
    front = spark.createDataFrame([(source, [source])], "node STRING, path ARRAY<STRING>")
    seen = front.select("node")
    for _ in range(depth):
        if front.filter(F.col("node") == target).limit(1).count():
            break
        step = front.join(edges, front.node == edges.src).groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).select(F.col("dst").alias("node"), "path")
        front = written(step.join(seen, "node", "left_anti"), "front")
        if not front.limit(1).count():
            break
        seen = seen.union(front.select("node"))
    return front.filter(F.col("node") == target).select(F.posexplode("path").alias("step", "node"))


def cycles(edges: DataFrame, length: int = 4) -> DataFrame:
    """cycle: simple cycles of at most ``length`` edges, each once, beginning with its least node.

    Only edges that can lie on a cycle are walked: nodes that no edge enters or none leaves are peeled off first, as often as a cycle is long.
    """
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    for _ in range(length):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges = written(edges, "edges")
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    paths = e.select(F.array("src", "dst").alias("p")).filter("p[1] > p[0]")
    found = None
    for _ in range(1, length):
        step = paths.join(e, F.element_at("p", -1) == F.col("src"))
        closed = step.filter("dst = p[0]").select("p")
        found = closed if found is None else found.unionByName(closed)
        paths = step.filter("dst > p[0] AND NOT array_contains(p, dst)").select(F.concat("p", F.array("dst")).alias("p"))
    return found.select(F.array_join("p", " > ").alias("cycle")).distinct()


def references(chunks: DataFrame, symbol: str, top_k: int = 50) -> DataFrame:
    """buffer_id, file, line, confidence: lines that name the symbol outside of its definition; calls are high, other mentions medium; the first ``top_k`` of each buffer."""
    import re

    word = rf"\b{re.escape(symbol)}\b"
    rows = buffered(chunks).filter((F.col("text").contains(symbol)) & (F.col("name").isNull() | (F.col("name") != symbol)))
    lines = rows.select("buffer_id", "file", "start_line", F.posexplode(F.split("text", "\n")).alias("n", "body")).filter(F.col("body").rlike(word))
    each = lines.select("buffer_id", "file", (F.col("start_line") + F.col("n")).alias("line"), F.col("body").rlike(word + r"\s*\(").alias("call"))
    by = each.groupBy("buffer_id", "file", "line").agg(F.max("call").alias("call")).select("buffer_id", "file", "line", F.when(F.col("call"), "high").otherwise("medium").alias("confidence"))
    w = Window.partitionBy("buffer_id").orderBy("confidence", "file", "line")
    return by.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k).drop("r")


def references_of_all(chunks: DataFrame, top_k: int = 50) -> DataFrame:
    """buffer_id, symbol, direction, file, line, context, confidence: callers and callees of every symbol of each buffer.

    incoming: the first line of each calling chunk that has the symbol followed by a bracket; outgoing: where each callee is
    defined (high), else the line of its call (medium). The first ``top_k`` of each symbol and direction by confidence, file and line.
    """
    d = definitions(chunks).select("buffer_id", "symbol").distinct()
    sites = call_sites(chunks)
    lines = buffered(chunks).filter("text IS NOT NULL").select("chunk_id", "start_line", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    used = lines.select("chunk_id", (F.col("start_line") + F.col("n")).alias("line"), F.trim("body").alias("context"), F.explode(F.transform(T.calls(F.col("body")), lambda c: F.substring_index(c, ".", -1))).alias("callee"))
    first = used.groupBy("chunk_id", "callee").agg(F.min(F.struct("line", "context")).alias("at")).select("chunk_id", "callee", "at.line", "at.context")
    spots = sites.join(first, ["chunk_id", "callee"])
    incoming = spots.join(d.withColumnRenamed("symbol", "callee"), ["buffer_id", "callee"]).select("buffer_id", F.col("callee").alias("symbol"), F.lit("incoming").alias("direction"), "file", "line", "context", F.lit("high").alias("confidence"))
    home = definitions(chunks).groupBy("buffer_id", F.col("symbol").alias("callee")).agg(F.min(F.struct("chunk_id", "file", "start_line")).alias("h"))
    outgoing = spots.filter("caller IS NOT NULL").join(home, ["buffer_id", "callee"], "left").select(
        "buffer_id", F.col("caller").alias("symbol"), F.lit("outgoing").alias("direction"), F.coalesce("h.file", "file").alias("file"), F.coalesce("h.start_line", "line").alias("line"), F.col("callee").alias("context"),
        F.when(F.col("h").isNull(), "medium").otherwise("high").alias("confidence"),
    )
    w = Window.partitionBy("buffer_id", "symbol", "direction").orderBy("confidence", "file", "line", "context")
    return incoming.unionByName(outgoing).distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k).drop("r")


def overlapping(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """buffer_id, chunk_id, file, name: chunks that overlap changed ranges (buffer_id, file, begin, stop) of their file."""
    r = buffered(ranges).select(F.col("buffer_id").alias("rb"), F.col("file").alias("rf"), "begin", "stop")
    return buffered(chunks).join(r, (F.col("buffer_id") == F.col("rb")) & (F.col("file") == F.col("rf")) & (F.col("start_line") <= F.col("stop")) & (F.col("end_line") >= F.col("begin"))).select("buffer_id", "chunk_id", "file", "name").distinct()


def owning_chunk(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, line, chunk_id: the first chunk whose lines hold each line (file_id, line)."""
    c = chunks.select(F.col("file_id").alias("cf"), "start_line", "end_line", "chunk_id")
    hit = lines.join(c, (F.col("file_id") == F.col("cf")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("file_id", "line").agg(F.min_by("chunk_id", F.struct("start_line", "chunk_id")).alias("chunk_id"))


def coverage(chunks: DataFrame) -> DataFrame:
    """buffer_id, file, start_line, end_line, tests, names: for each definition outside of tests, how many test chunks call it, and their names."""
    test = T.is_test_file_loose(F.col("file"))
    defs = definitions(chunks.filter(~test))
    used = call_sites(chunks.filter(test)).select("buffer_id", F.col("callee").alias("symbol"), F.col("chunk_id").alias("t"), F.col("caller").alias("test"))
    names = F.concat_ws(",", F.array_sort(F.collect_set("test")))  # of one definition
    return defs.join(used, ["buffer_id", "symbol"], "left").groupBy("buffer_id", "file", "start_line", "end_line").agg(F.countDistinct("t").alias("tests"), names.alias("names"))


def impact(chunks: DataFrame, symbols: DataFrame, depth: int = 6) -> DataFrame:
    """buffer_id, symbol, callers, files, critical, depth, untested, risk, level: what a change of each of ``symbols`` (buffer_id, symbol) may break in its buffer."""
    edges = call_edges(chunks)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = definitions(chunks).join(buffered(symbols).select("buffer_id", "symbol").distinct(), ["buffer_id", "symbol"], "left_semi").select("buffer_id", "symbol", F.col("chunk_id").alias("start"))
    hit = reachable(back, starts.select("start").distinct(), depth).filter("depth > 0")
    info = chunks.select(F.col("chunk_id").alias("node"), "file")
    rows = starts.join(hit, "start").join(info, "node")
    by = rows.groupBy("buffer_id", "symbol").agg(
        F.countDistinct("node").alias("callers"), F.countDistinct("file").alias("files"), F.count_if(T.is_critical_file(F.col("file"))).alias("critical"), F.max("depth").alias("depth"), (F.count_if(T.is_test_file_impact(F.col("file"))) == 0).alias("untested"),
    )
    by = starts.select("buffer_id", "symbol").distinct().join(by, ["buffer_id", "symbol"], "left").select("buffer_id", "symbol", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "files", "critical", "depth")], F.coalesce("untested", F.lit(True)).alias("untested"))
    f, d = F.col("files"), F.col("depth")
    risk = (
        F.when(f == 0, 0.0).when(f <= 3, 0.05).when(f <= 8, 0.15).otherwise(0.3) + F.when(d >= 5, 0.25).when(d >= 3, 0.15).when(d >= 1, 0.05).otherwise(0.0)
        + F.least(F.lit(0.25), 0.1 * F.col("critical")) + F.when(F.col("untested"), 0.2).otherwise(0.0)
    )
    return by.withColumn("risk", F.round(risk, 3)).withColumn("level", F.when(F.col("risk") < 0.25, "low").when(F.col("risk") < 0.6, "medium").otherwise("high"))


def held_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """word, name: which of ``words`` (word) contain which of ``names`` (name).

    A word that contains a name has the name's first letters, three or as many as it has, among its runs, so the exact
    test runs on an equi-join.
    """
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    w, n = words.filter("word <> ''").distinct(), names.filter("name <> ''").distinct()
    left = w.select("word", F.explode(F.array_distinct(F.concat(*[runs(F.col("word"), k) for k in (1, 2, 3)]))).alias("g"))
    return left.join(n.withColumn("g", F.substring("name", 1, 3)), "g").filter(F.contains("word", "name")).select("word", "name")


def file_evidence(tests: DataFrame, files: DataFrame, base: int, path: int, imported: int) -> DataFrame:
    """buffer_id, file, chunk_id, test_file, points: which of ``tests`` (buffer_id, chunk_id, test_file, text, imports) speak of which of ``files`` (buffer_id, file) of their buffer.

    ``base`` for the file's base name without suffix in the text, ``path`` for its path in the text, ``imported`` for the
    base name in one of the imports.
    """
    f = buffered(files).select("buffer_id", "file").filter("file IS NOT NULL").distinct().withColumn("name", F.regexp_replace(T.base_name(F.col("file")), r"(?<=.)\.[^.]+$", ""))
    plain, spaced = f.filter(~F.col("file").rlike(r"\s")), f.filter(F.col("file").rlike(r"\s"))
    # A name without white space stands in a text if and only if it stands in a run without white space.
    words = tests.select("buffer_id", "chunk_id", "test_file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+"), 0))).alias("word"))
    text = words.join(held_names(words.select("word"), plain.select("name")), "word").join(plain, ["buffer_id", "name"]).select("buffer_id", "file", "chunk_id", "test_file", F.contains("word", "file").alias("p"))
    odd = tests.join(spaced, "buffer_id").filter(F.contains("text", "name")).select("buffer_id", "file", "chunk_id", "test_file", F.contains("text", "file").alias("p"))  # paths with white space are few
    text = text.unionByName(odd).groupBy("buffer_id", "file", "chunk_id", "test_file").agg((F.lit(base) + F.when(F.max("p"), path).otherwise(0)).alias("points"))
    imports = tests.select("buffer_id", "chunk_id", "test_file", F.explode(F.array_distinct("imports")).alias("word"))
    by_import = imports.join(held_names(imports.select("word"), f.select("name")), "word").join(f, ["buffer_id", "name"]).select("buffer_id", "file", "chunk_id", "test_file", F.lit(imported).alias("points")).distinct()
    return text.unionByName(by_import).groupBy("buffer_id", "file", "chunk_id", "test_file").agg(F.sum("points").cast("int").alias("points"))


def impacted_tests(chunks: DataFrame, changes: DataFrame, top_k: int = 20) -> DataFrame:
    """buffer_id, file, symbol, test_file, score: tests that a change (buffer_id, file, symbol) concerns, by the best chunk of each test file.

    40 for the symbol as a word of the text, 30 for a call of it, 50 for the file's base name in the text, 50 for its path in
    the text, 20 for its base name in an import.
    """
    changes = buffered(changes).select("buffer_id", "file", "symbol").distinct()
    tests = buffered(chunks).filter(T.is_test_file_loose(F.col("file")) & F.col("text").isNotNull()).select("buffer_id", "chunk_id", F.col("file").alias("test_file"), "text", "imports")
    words = tests.select("buffer_id", "chunk_id", "test_file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("symbol"))
    called = call_sites(chunks).select("chunk_id", F.col("callee").alias("symbol"), F.lit(30).alias("call"))
    named = words.join(changes, ["buffer_id", "symbol"]).join(called, ["chunk_id", "symbol"], "left").select("buffer_id", "file", "symbol", "chunk_id", "test_file", (F.lit(40) + F.coalesce("call", F.lit(0))).alias("own"))
    points = written(file_evidence(tests, changes, 50, 50, 20), "evidence")
    both = named.join(points.drop("test_file", "buffer_id"), ["file", "chunk_id"], "left").select("buffer_id", "file", "symbol", "test_file", (F.col("own") + F.coalesce("points", F.lit(0))).alias("score"))
    # Evidence of the file is the same for all its symbols: of a file's tests only the first top_k can be among a symbol's first top_k by that alone.
    by_file = points.groupBy("buffer_id", "file", "test_file").agg(F.max("points").alias("score"))
    first = by_file.withColumn("r", F.row_number().over(Window.partitionBy("buffer_id", "file").orderBy(F.desc("score"), "test_file"))).filter(F.col("r") <= top_k)
    rows = both.unionByName(first.join(changes, ["buffer_id", "file"]).select("buffer_id", "file", "symbol", "test_file", "score"))
    w = Window.partitionBy("buffer_id", "file", "symbol").orderBy(F.desc("score"), "test_file")
    return rows.groupBy("buffer_id", "file", "symbol", "test_file").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k).drop("r")


def execution_paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, path, cyclic: the call paths from each start of at most ``depth`` calls; a path ends where it meets itself."""
    e = edges.select("src", "dst").distinct()
    live = starts.select("start", F.array("start").alias("p"), F.lit(False).alias("cyclic"))
    out = None
    for _ in range(depth):
        step = live.filter("NOT cyclic").join(e, F.element_at("p", -1) == F.col("src")).select("start", F.concat("p", F.array("dst")).alias("p"), F.array_contains("p", F.col("dst")).alias("cyclic"))
        out = step if out is None else out.unionByName(step)
        live = step
    return out.select("start", F.array_join("p", " > ").alias("path"), "cyclic").distinct()


def neighbourhood_graph(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, src, dst: the edges between the nodes that each start reaches, against or along edges (src, dst), in at most ``depth`` steps."""
    edges = edges.select("src", "dst").distinct()
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = reachable(both, starts, depth).select("start", "node")
    return near.withColumnRenamed("node", "src").join(edges, "src").join(near.withColumnRenamed("node", "dst"), ["start", "dst"]).select("start", "src", "dst").distinct()


def branches(chunks: DataFrame) -> DataFrame:
    """chunk_id, line, kind, condition: the branches on the execution paths of Python chunks."""
    p = r"^\s*(if|elif|else|for|while|except)\b.*:\s*(#.*)?$"
    lines = chunks.filter("text IS NOT NULL").select("chunk_id", "start_line", F.posexplode(F.split("text", "\n")).alias("n", "body")).filter(F.col("body").rlike(p))
    return lines.select("chunk_id", (F.col("start_line") + F.col("n")).alias("line"), F.regexp_extract("body", r"^\s*(if|elif|else|for|while|except)\b", 1).alias("kind"), F.trim(F.regexp_extract("body", r"^\s*(?:if|elif|else|for|while|except)\b\s*(.*?)\s*:\s*(?:#.*)?$", 1)).alias("condition"))


def symbol_metadata(chunks: DataFrame) -> DataFrame:
    """buffer_id, symbol, chunk_id, loc, called_by, calls_count, complexity, docstring, returns: facts about each definition."""
    sites = call_sites(chunks)
    used, made = sites.groupBy("buffer_id", F.col("callee").alias("symbol")).agg(F.countDistinct("chunk_id").alias("called_by")), sites.groupBy("chunk_id").agg(F.count("*").alias("calls_count"))
    returns = F.trim(F.regexp_extract("text", r"\)\s*->\s*([A-Za-z_][\w\[\], .]*)\s*:", 1))
    own = chunks.filter("name IS NOT NULL").select("chunk_id", T.complexity(F.col("text")).alias("complexity"), T.docstring(F.col("text")).alias("docstring"), F.when(F.length(returns) > 0, returns).alias("returns"))
    d = definitions(chunks).join(own, "chunk_id").join(used, ["buffer_id", "symbol"], "left").join(made, "chunk_id", "left")
    return d.select("buffer_id", "symbol", "chunk_id", (F.col("end_line") - F.col("start_line") + 1).alias("loc"), F.coalesce("called_by", F.lit(0)).alias("called_by"), F.coalesce("calls_count", F.lit(0)).alias("calls_count"), "complexity", "docstring", "returns")


def error_contexts(chunks: DataFrame) -> DataFrame:
    """buffer_id, symbol, file, line, context: try blocks that name a symbol of their buffer, with their first 200 characters."""
    block = r"(?s)try:[ \t\r]*\n(.*?)\bexcept\b"
    cut = buffered(chunks).filter(F.col("text").rlike(block)).select("buffer_id", "chunk_id", "file", "start_line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).*?(?:" + block[4:] + ")"), 0)).alias("n", "piece"), F.regexp_extract_all("text", F.lit(r"(?s).*?(?:" + block[4:] + ")"), 0).alias("pieces"))
    upto = F.array_join(F.slice("pieces", F.lit(1), F.col("n")), "")
    head = F.concat(upto, F.substring_index("piece", "try:", 1))
    body = F.regexp_extract("piece", block, 1)
    rows = cut.select("buffer_id", "file", (F.col("start_line") + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).alias("line"), body.alias("body"))
    named = rows.select("buffer_id", "file", "line", F.substring(F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")), 1, 200).alias("context"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), 0))).alias("symbol"))
    return named.join(definitions(chunks).select("buffer_id", "symbol").distinct(), ["buffer_id", "symbol"]).select("buffer_id", "symbol", "file", "line", "context")


def full_context(chunks: DataFrame) -> DataFrame:
    """buffer_id, symbol, chunk_id, file, start_line, callers, tests, callees, errors: of every symbol its first definition, how many chunks
    outside of tests call it, the test files that do, what it calls, and in how many try blocks it stands."""
    test = T.is_test_file_loose(F.col("file"))
    first = definitions(chunks).groupBy("buffer_id", "symbol").agg(F.min(F.struct("chunk_id", "file", "start_line")).alias("d")).select("buffer_id", "symbol", "d.*")
    sites = call_sites(chunks)
    # Lists of one symbol; callers are counted only.
    used = sites.groupBy("buffer_id", F.col("callee").alias("symbol")).agg(F.countDistinct(F.when(~test, F.col("chunk_id"))).alias("callers"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(test, F.col("file"))))).alias("tests"))
    made = sites.filter("caller IS NOT NULL").groupBy("buffer_id", F.col("caller").alias("symbol")).agg(F.concat_ws(",", F.array_sort(F.collect_set("callee"))).alias("callees"))
    errors = error_contexts(chunks).groupBy("buffer_id", "symbol").agg(F.count("*").alias("errors"))
    rows = first.join(used, ["buffer_id", "symbol"], "left").join(made, ["buffer_id", "symbol"], "left").join(errors, ["buffer_id", "symbol"], "left")
    return rows.select("buffer_id", "symbol", "chunk_id", "file", "start_line", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("tests", F.lit("")).alias("tests"), F.coalesce("callees", F.lit("")).alias("callees"), F.coalesce("errors", F.lit(0)).alias("errors"))


def new_symbols(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, symbol, body: definitions on lines of the new text that no line of the old text of the same key equals."""
    lines = lambda d: d.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.split(text, "\n"))).alias("body"))
    p = r"^\s*(?:async\s+)?(?:def|class|func|function)\s+(\w+)"
    return lines(new).filter(F.col("body").rlike(p)).join(lines(old), [key, "body"], "left_anti").select(key, F.regexp_extract("body", p, 1).alias("symbol"), "body")


def invalidated_symbols(chunks: DataFrame, dirty: DataFrame) -> DataFrame:
    """buffer_id, symbol: symbols whose cached neighbourhoods a change of ``dirty`` files (buffer_id, file) spoils: those defined there and those of the buffer that are called from there."""
    d = buffered(dirty).select("buffer_id", "file").distinct()
    defs = definitions(chunks)
    own = defs.join(d, ["buffer_id", "file"], "left_semi").select("buffer_id", "symbol")
    used = call_sites(chunks).join(d, ["buffer_id", "file"], "left_semi").select("buffer_id", F.col("callee").alias("symbol")).join(defs.select("buffer_id", "symbol"), ["buffer_id", "symbol"], "left_semi")
    return own.unionByName(used).distinct()
