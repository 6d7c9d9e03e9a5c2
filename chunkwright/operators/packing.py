"""Packing of ranked chunks into a token budget, duplicates, snippets, signatures and related code.

Null texts are left out of packing and similarity; ties are broken by the least id; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import runs as R
from ..functions import text as T
from ..sources.tables import written
from .graph import buffered, file_evidence
from .search import l2_normalized, vector_links

#: Words of a query that tell nothing (fixed values).
STOP_WORDS = {"a", "an", "the", "is", "to", "for", "and", "or"}


def unique_texts(chunks: DataFrame) -> DataFrame:
    """The first of the chunks whose texts are equal but for white space and letter case; null texts are left out.

    The texts themselves aren't exchanged: only ids and hashes are grouped, and one row per hash is kept.
    """
    keep = chunks.filter("text IS NOT NULL").groupBy(F.sha2(T.normalized(F.col("text")), 256).alias("h")).agg(F.min("chunk_id").alias("chunk_id"))
    return chunks.join(keep.select("chunk_id"), "chunk_id", "left_semi")


def packing_reason(chunks: DataFrame, excluded: list[str], min_lines: int, max_lines: int) -> DataFrame:
    """The chunks with why each is kept or left out: type, test, short, long or kept."""
    n = F.col("end_line") - F.col("start_line") + 1
    return chunks.withColumn("reason", F.when(F.col("type").isin(excluded), "type").when(T.is_test_file(F.col("file")), "test").when(n < min_lines, "short").when(n > max_lines, "long").otherwise("kept"))


def within_budget(ranked: DataFrame, cost: Column, budget: int, part: str = "qid", order: str = "rank") -> DataFrame:
    """The longest prefix of each ranking whose costs fit the budget, with the sum so far."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("cost", cost.cast("int")).withColumn("used", F.sum("cost").over(w)).filter(F.col("used") <= budget)


def packed(ranked: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """qid, id, rank, cost, used: the best chunks of each query that fit the token budget, without skipping any."""
    costs = chunks.filter("text IS NOT NULL").select(F.col("chunk_id").alias("id"), T.estimated_tokens(F.col("text")).alias("c"))
    return within_budget(ranked.join(costs, "id"), F.col("c"), budget).select("qid", "id", "rank", "cost", "used")


def stripped(text: Column) -> Column:
    """The text without boilerplate and blank lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~T.is_boilerplate(x)), "\n")


def packed_smart(ranked: DataFrame, chunks: DataFrame, budget: int, excluded: tuple[str, ...] = ("sliding", "orphan"), min_lines: int = 1, max_lines: int = 400, full: int = 3) -> DataFrame:
    """qid, file, start_line, id, rank, cost, used, body, saved: filtered, without duplicates, the first ``full`` as whole texts, the rest as signatures; saved are the tokens that each costs less."""
    kept = unique_texts(packing_reason(chunks, list(excluded), min_lines, max_lines).filter("reason = 'kept'"))
    rows = ranked.join(kept.select(F.col("chunk_id").alias("id"), "file", "start_line", "text"), "id")
    w = Window.partitionBy("qid").orderBy("rank")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("body", stripped(F.when(F.col("place") <= full, F.col("text")).otherwise(T.signature(F.col("text")))))
    return within_budget(rows, T.estimated_tokens(F.col("body")), budget, order="place").select("qid", "file", "start_line", "id", "rank", "cost", "used", "body", (T.estimated_tokens(F.col("text")) - F.col("cost")).alias("saved"))


def packed_hierarchy(chunks: DataFrame, query: str, budget: int, top_files: int = 5, top_chunks: int = 10) -> DataFrame:
    """level, file, chunk_id, body, used: summaries of the best files, their best chunks and those lines that have a query word, in one budget."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if t]
    has = lambda c: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(c), t)))
    # In tenths: .8 for a term in the name, .3 in the text, .5 in the path.
    scored = buffered(chunks).filter("text IS NOT NULL").withColumn("s", 8 * has(F.coalesce("name", F.lit(""))) + 3 * has(F.col("text")))
    files = scored.groupBy("buffer_id", "file").agg(F.sum("s").alias("fs"), F.count("*").alias("n"), F.concat_ws(", ", F.array_sort(F.collect_set("name"))).alias("names"))
    files = files.withColumn("fs", F.col("fs") + 5 * has(F.col("file"))).filter("fs > 0").orderBy(F.desc("fs"), "buffer_id", "file").limit(top_files)
    files = files.withColumn("fr", F.row_number().over(Window.orderBy(F.desc("fs"), "buffer_id", "file")))
    w = Window.partitionBy("buffer_id", "file").orderBy(F.desc("s"), "chunk_id")
    inner = scored.join(F.broadcast(files.select("buffer_id", "file", "fr")), ["buffer_id", "file"]).filter("s > 0").withColumn("cr", F.row_number().over(w)).filter(F.col("cr") <= top_chunks)
    lines = inner.withColumn("body", F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda x: has(x) > 0), 1, 3), "\n"))
    parts = files.select(F.lit(1).alias("level"), "file", "fr", F.lit(0).alias("cr"), F.lit(None).cast("bigint").alias("chunk_id"), F.concat_ws(": ", "file", "names").alias("body"))
    parts = parts.unionByName(inner.select(F.lit(2).alias("level"), "file", "fr", "cr", "chunk_id", T.signature(F.col("text")).alias("body"))).unionByName(lines.select(F.lit(3).alias("level"), "file", "fr", "cr", "chunk_id", "body"))
    ordered = parts.withColumn("qid", F.lit(1)).withColumn("place", F.struct("level", "fr", "cr"))
    return within_budget(ordered, T.estimated_tokens(F.col("body")), budget, order="place").select("level", "file", "chunk_id", "body", "used")


def disclosed(chunks: DataFrame, level: str) -> DataFrame:
    """chunk_id, file, name, body, tokens: the chunks at a level of disclosure: signatures, details or full."""
    body = {"signatures": T.signature(F.col("text")), "details": F.substring("text", 1, 500), "full": F.col("text")}[level]
    return chunks.select("chunk_id", "file", "name", body.alias("body")).withColumn("tokens", F.floor(F.length("body") / 4))


def related_code(chunks: DataFrame, vectors: DataFrame, targets: DataFrame, budget: int) -> DataFrame:
    """qid, section, id, score, used: callers, tests, interfaces and semantic neighbours of each of ``targets`` (chunk_id).

    tests: 50 for the base name of the target's file in the text, 40 for the target's name as a word, 30 for an import of the
    file; interfaces, of functions and methods: 90 for a class that defines one of the name, 30 for one that has the name as a
    word; semantic: chunks of other files whose vector (id, v) has a cosine of at least 0.3, scored by 100 times that. The
    sections share a budget: each takes its longest prefix that fits what those before it left.
    """
    named = buffered(chunks).filter("text IS NOT NULL")
    all_ = targets.select("chunk_id").distinct().join(named.select("chunk_id", "buffer_id", "name", "file", "type"), "chunk_id").select(F.col("chunk_id").alias("qid"), "buffer_id", F.col("name").alias("target"), F.col("file").alias("tfile"), "type")
    t = all_.filter("target IS NOT NULL")
    info = named.select(F.col("chunk_id").alias("id"), "file", "text")
    test = T.is_test_file_loose(F.col("file"))
    uses = named.filter(~test).select("buffer_id", F.col("chunk_id").alias("id"), "file", F.explode(T.calls(F.col("text"))).alias("call")).withColumn("target", F.substring_index("call", ".", -1))
    callers = uses.join(t, ["buffer_id", "target"]).filter("id <> qid").select("qid", "id", F.when(F.col("file") == F.col("tfile"), 50).otherwise(30).alias("score")).distinct()

    tests = named.filter(test).select("buffer_id", "chunk_id", F.col("file").alias("test_file"), "text", "imports")
    words = lambda rows: rows.select("buffer_id", F.col("chunk_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("target"))
    by_file = file_evidence(tests, all_.select("buffer_id", F.col("tfile").alias("file")), 50, 0, 30).select("buffer_id", F.col("file").alias("tfile"), F.col("chunk_id").alias("id"), "points").join(all_, ["buffer_id", "tfile"]).select("qid", "id", F.col("points").alias("score"))
    by_name = words(tests).join(t, ["buffer_id", "target"]).select("qid", "id", F.lit(40).alias("score"))
    tested = by_file.unionByName(by_name).filter("id <> qid").groupBy("qid", "id").agg(F.sum("score").cast("int").alias("score"))

    of = t.filter("type IN ('function', 'nested_function', 'method')").select("qid", "buffer_id", "target")
    classes = named.filter("type IN ('class', 'trait', 'interface')")
    inner = named.filter("type IN ('function', 'nested_function', 'method')").select("buffer_id", "file", F.col("name").alias("target"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    defined = classes.join(inner, ["buffer_id", "file"]).filter("s >= start_line AND e <= end_line").select("buffer_id", F.col("chunk_id").alias("id"), "target").join(of, ["buffer_id", "target"]).select("qid", "id", F.lit(90).alias("score"))
    interfaces = defined.unionByName(words(classes).join(of, ["buffer_id", "target"]).select("qid", "id", F.lit(30).alias("score"))).groupBy("qid", "id").agg(F.max("score").alias("score"))

    asked = vectors.join(all_.select(F.col("qid").alias("id")), "id").select(F.col("id").alias("qid"), l2_normalized(F.col("v")).alias("q"))
    links = vector_links(vectors.select("id", l2_normalized(F.col("v")).alias("v")), "id", "v", asked, 0.3).filter("id <> qid")
    semantic = links.join(all_.select("qid", "buffer_id", "tfile"), "qid").join(named.select(F.col("chunk_id").alias("id"), F.col("buffer_id").alias("own"), "file"), "id").filter("own = buffer_id AND file <> tfile").select("qid", "id", F.round(100 * F.col("score"), 4).alias("score"))

    out, spent = None, all_.select("qid", F.lit(0).cast("bigint").alias("spent"))
    for section, rows in (("callers", callers), ("tests", tested), ("interfaces", interfaces), ("semantic", semantic)):
        ranked = rows.join(info, "id").withColumn("place", F.struct(-F.col("score"), "id")).join(spent, "qid")
        # The sum so far starts from what the sections before have used.
        w = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kept = ranked.withColumn("used", F.col("spent") + F.sum(T.estimated_tokens(F.col("text"))).over(w)).filter(F.col("used") <= budget)
        part = written(kept.select("qid", F.lit(section).alias("section"), "id", "score", "used"), "related")
        spent = spent.join(part.groupBy("qid").agg(F.max("used").alias("now")), "qid", "left").select("qid", F.coalesce("now", "spent").alias("spent"))
        out = part if out is None else out.unionByName(part)
    return out


def duplicates(chunks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """chunk_a < chunk_b, similarity: pairs of chunks whose 4-word shingles overlap by ``threshold`` or more, exactly.

    Chunks with one set of shingles form a class; only one of each is compared. With shingles ordered from rare to
    frequent, similar sets share one of their first n - ceil(threshold * n) + 1, so only those are joined on; the
    candidates, filtered by size, are then confirmed on the whole sets.
    """
    sets = chunks.filter("text IS NOT NULL").select("chunk_id", T.words(F.col("text")).alias("w")).select("chunk_id", F.array_sort(T.shingles(F.col("w"))).alias("s"))
    classes = written(sets.withColumn("c", F.xxhash64("s")), "shingles")  # the words are cut once
    reps = classes.groupBy("c").agg(F.min("chunk_id").alias("rep"), F.first("s").alias("s")).withColumn("n", F.size("s"))
    members = classes.select("chunk_id", "c").join(reps.select("c", "rep"), "c").select("chunk_id", "rep")
    each = reps.select("rep", "n", F.explode("s").alias("h"))
    # Rare first: the place of a shingle comes from how many classes have it.
    df = each.groupBy("h").agg(F.count("*").alias("df"))
    w = Window.partitionBy("rep").orderBy("df", "h")
    prefix = each.join(df, "h").withColumn("place", F.row_number().over(w)).filter((F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1) & (F.col("df") > 1)).select("h", "rep", "n")
    a, b = prefix.select("h", F.col("rep").alias("ra"), F.col("n").alias("na")), prefix.select("h", F.col("rep").alias("rb"), F.col("n").alias("nb"))
    pairs = a.join(b, "h").filter((F.col("ra") < F.col("rb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("ra", "rb").distinct()
    full = reps.select("rep", "s", "n")
    both = pairs.join(full.toDF("ra", "sa", "na"), "ra").join(full.toDF("rb", "sb", "nb"), "rb").withColumn("k", F.size(F.array_intersect("sa", "sb")))
    links = both.withColumn("sim", F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).filter(F.col("sim") >= threshold).select("ra", "rb", "sim")
    links = links.unionByName(members.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("sim")))
    out = links.join(members.toDF("ka", "ra"), "ra").join(members.toDF("kb", "rb"), "rb").filter("ra <> rb OR ka < kb")
    return out.select(F.least("ka", "kb").alias("chunk_a"), F.greatest("ka", "kb").alias("chunk_b"), F.round("sim", 4).alias("similarity"))


def run_sets(rows: DataFrame, key: str, text: str, n: int, threshold: float = 0, known: tuple | None = None) -> DataFrame:
    """``key``, c, n, s: the distinct runs of ``n`` words of each text that has some, as hashes; rows of one c have the same s and n.

    With the filter ``known`` (a broadcast and its bits), s keeps only runs that it may hold, and texts are left out whose s
    is under ``threshold`` of their n runs.
    """
    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            counts, h = R.distinct_runs(b.column(1), n)
            size, least = counts, np.ones(len(counts))
            if known:
                hit = R.may_hold(known[0].value, h, known[1])
                own = np.repeat(np.arange(len(size)), size)
                counts = np.bincount(own[hit], minlength=len(size))
                least = np.maximum(1, np.ceil(threshold * size * (1 - 1e-9)))
                h = h[hit & (counts >= least)[own]]
            keep = counts >= least
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(size[keep], pa.int32()), R.list_array(counts[keep], h)], ["k", "n", "s"])

    cutting = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), text)
    sets = cutting.mapInArrow(cut, f"k {cutting.schema['k'].dataType.simpleString()}, n INT, s ARRAY<BIGINT>")
    return sets.select(F.col("k").alias(key), F.xxhash64("n", "s").alias("c"), "n", "s")


def run_filter(sets: DataFrame) -> tuple:
    """A filter of all runs in ``sets``, broadcast, and its bits; the driver holds 32 MB at most, whatever is in the sets."""
    bits = R.filter_bits(sets.agg(F.sum(F.size("s"))).first()[0] or 0)
    slices = bits - R.SLICE_BITS

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        cells = np.zeros((1 << slices, 1 << R.SLICE_BITS - 3), dtype=np.uint8)
        for b in batches:
            R.put(cells.reshape(-1), b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
        used = np.flatnonzero(cells.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([cells[i].tobytes() for i in used], pa.binary())], ["slice", "cells"])

    runs = sets.select(F.explode("s").alias("h")).repartition(min(64, 1 << slices), F.shiftrightunsigned("h", 64 - slices) if slices else F.lit(0))
    cells = bytearray(1 << bits - 3)
    for r in runs.mapInArrow(fill, "slice INT, cells BINARY").toLocalIterator():
        cells[r["slice"] << R.SLICE_BITS - 3 : (r["slice"] + 1) << R.SLICE_BITS - 3] = r["cells"]
    import numpy as np

    return sets.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(cells), dtype=np.uint8)), bits


def similar_snippets(chunks: DataFrame, snippets: DataFrame, threshold: float = 0.7, n: int = 3) -> DataFrame:
    """qid, id, score: the chunks whose runs of ``n`` words overlap with those of a snippet (qid, snippet) by ``threshold`` or more, exactly.

    A chunk of which fewer than ``threshold`` of its runs may be in any snippet is left out when it is cut. Equal sets form a
    class; only one of each is compared. With runs ordered from rare to frequent, similar sets share one of their first
    n - ceil(threshold * n) + 1, so only those are joined on; the candidates, filtered by size, are then confirmed on the
    whole sets. All joins merge: a size estimated before runs are exploded is far too small, and the driver would build a
    broadcast of all of them.
    """
    asked = written(run_sets(snippets, "qid", "snippet", n), "snippets")
    found = written(run_sets(chunks.withColumnRenamed("chunk_id", "id"), "id", "text", n, threshold, run_filter(asked)), "runs")
    sets = asked.select(F.lit(True).alias("q"), "c", "n", "s").unionByName(found.select(F.lit(False).alias("q"), "c", "n", "s")).distinct()
    each = sets.select("q", "c", "n", F.explode("s").alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df"), F.count_if("q").alias("dq")).filter("dq > 0 AND df > dq").select("h", "df")
    least = F.greatest(F.lit(1), F.ceil(threshold * F.col("n") * (1 - 1e-9)))
    # o: the runs that both sides have, rare first; all others of a set count as rarer.
    ordered = each.join(df.hint("merge"), "h").groupBy("q", "c", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "h"))), lambda x: x["h"]).alias("o"))
    ordered = written(ordered.withColumn("k", F.size("o")).filter(F.col("k") >= least), "ordered")

    prefix = ordered.select("q", "c", "n", "k", F.explode(F.slice("o", 1, (F.col("k") - least + 1).cast("int"))).alias("h"))
    side = lambda rows, q, *names: rows.filter("q" if q else "NOT q").select(*[F.col(x).alias(x if x == "h" else x + "qd"[not q]) for x in names])
    both = F.col("nq") + F.col("nd")
    pairs = side(prefix, True, "h", "c", "n", "k").join(side(prefix, False, "h", "c", "n", "k").hint("merge"), "h").filter(F.least("kq", "kd") * (1 + threshold) >= threshold * both * (1 - 1e-9)).select("cq", "cd").distinct()
    shared = pairs.join(side(ordered, False, "c", "n", "o").hint("merge"), "cd").join(side(ordered, True, "c", "n", "o").hint("merge"), "cq").withColumn("k", F.size(F.array_intersect("od", "oq")))
    score = F.col("k") / (both - F.col("k"))
    links = shared.filter((F.col("k") > 0) & (score >= threshold)).select("cq", "cd", F.round(score, 6).alias("score"))
    return links.join(found.select("id", F.col("c").alias("cd")).hint("merge"), "cd").join(asked.select("qid", F.col("c").alias("cq")).hint("merge"), "cq").select("qid", "id", "score")


def greedy_clusters(vectors: DataFrame, threshold: float = 0.75, ahead: int = 64) -> DataFrame:
    """part, cluster, id: in the order of ids, a vector without cluster opens one and takes those of the next ``ahead``
    vectors without cluster whose cosine is over ``threshold``; clusters of one are left out.

    The order matters within a part (part, id, v), so a part is swept by one task as a stream of batches that holds ``ahead`` rows.
    """
    import numpy as np
    import pandas as pd

    def sweep(batches):
        held: list[tuple] = []  # (part, id, v, cluster) still in reach

        def close(row):
            part, i, v, own = row
            out = []
            if own is None:
                mates = [h for h in held[: ahead] if h[0] == part and h[3] is None and float(np.dot(v, h[2])) / (np.linalg.norm(v) * np.linalg.norm(h[2]) + 1e-10) > threshold]
                if mates:
                    out.append((part, i, i))
                    for m in mates:
                        m[3] = i
                        out.append((part, i, m[1]))
            return out

        for b in batches:
            rows = []
            for part, i, v in zip(b["part"], b["id"], b["v"], strict=True):
                held.append([part, i, np.asarray(v, dtype=float), None])
                if len(held) > ahead:
                    rows += close(held.pop(0))
            yield pd.DataFrame(rows, columns=["part", "cluster", "id"])
        rows = []
        while held:
            rows += close(held.pop(0))
        yield pd.DataFrame(rows, columns=["part", "cluster", "id"])

    return vectors.filter("v IS NOT NULL").repartition("part").sortWithinPartitions("part", "id").mapInPandas(sweep, "part STRING, cluster BIGINT, id BIGINT")


def implementations(chunks: DataFrame) -> DataFrame:
    """buffer_id, cls, base, via: direct bases of the classes of each buffer and those one step further up."""
    each = buffered(chunks).filter((F.col("type") == "class") & F.col("text").isNotNull()).select("buffer_id", F.explode(F.regexp_extract_all("text", F.lit(r"class\s+\w+\s*\([^)]+\)"), 0)).alias("h"))
    c = each.select("buffer_id", F.regexp_extract("h", r"class\s+(\w+)", 1).alias("cls"), F.explode(F.split(F.regexp_extract("h", r"\(([^)]*)\)", 1), ",")).alias("base")).withColumn("base", F.trim("base")).filter("base <> ''").distinct()
    up = c.select("buffer_id", F.col("cls").alias("base"), F.col("base").alias("upper"))
    return c.select("buffer_id", "cls", "base", F.lit("direct").alias("via")).union(c.join(up, ["buffer_id", "base"]).select("buffer_id", "cls", F.col("upper").alias("base"), F.lit("transitive"))).distinct()


def path_keywords(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id, keyword: confidence .3 for each word of the query (over 3 letters, no stop word) in the path, .9 at most."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 3 and w not in STOP_WORDS]
    if not words:
        return chunks.limit(0).select("chunk_id", F.lit(0.0).alias("keyword"))
    n = F.size(F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(F.lower("file"), w)))
    return chunks.filter(n > 0).select("chunk_id", F.least(F.lit(0.9), 0.3 * n).alias("keyword"))


def annotated_results(hits: DataFrame, chunks: DataFrame, query: str, edited: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """qid, id, reason, confidence, reasons: why each hit (qid, id, score) is shown: the surest reason and all of them.

    edited (1.0): its file is among ``edited`` (buffer_id, file); called (.95): a chunk of an edited file calls one of its file's (``edges`` src, dst);
    imported (.9): an edited file imports it (``imports`` buffer_id, file, target); semantic (.85): the score is over .5; keyword: as
    :func:`path_keywords`. Hits without any have the reason none at 0.
    """
    c = buffered(chunks).select(F.col("chunk_id").alias("id"), "buffer_id", "file")
    e = buffered(edited).select("buffer_id", "file").distinct()
    by_call = edges.join(c.withColumnRenamed("id", "src").join(e, ["buffer_id", "file"], "left_semi").select("src"), "src", "left_semi").join(c.select(F.col("id").alias("dst"), "buffer_id", "file"), "dst").select("buffer_id", "file").distinct()
    by_import = imports.join(e, ["buffer_id", "file"], "left_semi").select("buffer_id", F.col("target").alias("file")).distinct()
    rows = hits.join(c, "id").join(path_keywords(chunks, query).withColumnRenamed("chunk_id", "id"), "id", "left")
    for name, own in (("edited", e), ("called", by_call), ("imported", by_import)):
        rows = rows.join(own.withColumn(name, F.lit(True)), ["buffer_id", "file"], "left")
    sure = F.array(*[F.when(test, F.struct(F.lit(v).cast("double").alias("confidence"), F.lit(n).alias("reason"))) for n, v, test in (("edited", 1.0, F.col("edited")), ("called", 0.95, F.col("called")), ("imported", 0.9, F.col("imported")), ("semantic", 0.85, F.col("score") > 0.5))], F.when(F.col("keyword").isNotNull(), F.struct(F.col("keyword").alias("confidence"), F.lit("keyword").alias("reason"))))
    found = F.array_sort(F.filter(sure, lambda x: x.isNotNull()), lambda x, y: F.when(x["confidence"] > y["confidence"], -1).when(x["confidence"] < y["confidence"], 1).otherwise(0))
    rows = rows.withColumn("found", found)
    return rows.select("qid", "id", F.coalesce(F.get("found", 0)["reason"], F.lit("none")).alias("reason"), F.round(F.coalesce(F.get("found", 0)["confidence"], F.lit(0.0)), 4).alias("confidence"), F.array_join(F.transform("found", lambda x: x["reason"]), ",").alias("reasons"))
