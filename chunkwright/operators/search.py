"""Lexical, vector, hybrid and faceted search over chunks, for many queries in one job.

Ties are broken by the least id everywhere. Blank queries and k under 1 are refused with ValueError; null texts match
nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import glob_pattern, tokens

K1, B = 1.5, 0.75
RRF = 60


def check_search(query: str, top_k: int, offset: int = 0) -> str:
    """The query, trimmed; ValueError for a blank query, top_k outside 1..10000 or a negative offset."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("query must not be blank")
    if not 1 <= top_k <= 10_000:
        raise ValueError("top_k must lie in 1..10000")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return query.strip()


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, dl: how often each term stands in each text, with the text's length in terms."""
    t = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return t.select("id", "dl", F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """n, avgdl: number of texts and their mean length in terms."""
    return docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, top_k: int = 50) -> DataFrame:
    """qid, id, score, rank: the best ``top_k`` texts for each of ``queries`` (qid, query) by BM25.

    A term that stands twice in a query counts twice. Only postings of terms that some query has are exchanged.
    """
    asked = queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    tf = (
        docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
        .select("id", "dl", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(corpus_stats(docs, text))  # one row
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    idf = asked.join(df, "term").crossJoin(stats).select("qid", "term", "avgdl", (F.col("times") * weight).alias("w"))
    score = tf.join(idf, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * gain), 6).alias("score"))
    return best(score, top_k)


def best(scored: DataFrame, top_k: int, *by: str) -> DataFrame:
    """The ``top_k`` rows of each qid by falling score, with their rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    """Cosine; vectors of norm 0 have cosine 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)


def l2_normalized(v: Column) -> Column:
    """The vector at unit length; one of norm 0 as it is."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: (x / F.when(n > 0, n).otherwise(1.0)).cast("float"))


#: Query vectors of one block, and bytes of scores that a task holds; blocks are broadcast one by one, so what is sent has a fixed size.
BLOCK = 20_000
SCORE_BYTES = 32 << 20


class TopScores:
    """The ``top_k`` best (score, id) of each of ``n`` queries among blocks of scores; ties go to the least id.

    Holds at most about ``n * top_k`` kept rows and one block's hits at a time: once a query has ``top_k``, only what reaches its last one is taken.
    """

    def __init__(self, n: int, top_k: int):
        import numpy as np

        self.k, self.least = top_k, np.full(n, -np.inf)
        self.held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]

    def add(self, scores, ids, *more) -> None:
        """Scores of all queries (rows) with ``ids`` (columns); ``more`` has further matrices of the same shape to keep."""
        import numpy as np

        q, j = np.nonzero(scores >= self.least[:, None])
        new = [q, ids[j], scores[q, j], *(m[q, j] for m in more)]
        held = self.held + [np.zeros(0) for _ in more] if len(self.held) < len(new) else self.held
        both = [np.concatenate(x) for x in zip(held, new, strict=True)]
        order = np.lexsort((both[1], -both[2], both[0]))
        both = [x[order] for x in both]
        begin = np.searchsorted(both[0], both[0], "left")
        keep = np.arange(len(order)) - begin < self.k
        self.held = [x[keep] for x in both]
        q, n = np.unique(self.held[0], return_counts=True)
        full = q[n == self.k]
        self.least[full] = self.held[2][np.searchsorted(self.held[0], full, "right") - 1]


def vector_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, top_k: int, spark_blocks: int = BLOCK) -> DataFrame:
    """qid, id, score, rank: the nearest ``top_k`` vectors by inner product for each of ``queries`` (qid, q).

    Queries go against all vectors in blocks: each task multiplies its rows with a broadcast block of queries as one
    matrix product, in parts of ``SCORE_BYTES``, and keeps ``top_k`` of each, so at most tasks x queries x top_k rows are exchanged.
    """
    import numpy as np
    import pandas as pd

    out = None
    for block in _blocks(queries.filter("q IS NOT NULL"), spark_blocks):
        qid, q = np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)
        held = vectors.sparkSession.sparkContext.broadcast((qid, q))

        def near(batches, held=held):
            qid, q = held.value
            best_, step = TopScores(len(qid), top_k), max(1, SCORE_BYTES // (8 * len(qid)))
            for b in batches:
                ids = b["id"].to_numpy()
                for at in range(0, len(ids), step):
                    v = np.stack(b["v"].to_numpy()[at : at + step]).astype(np.float64)
                    best_.add(np.round(q @ v.T, 6), ids[at : at + step])
            yield pd.DataFrame({"qid": qid[best_.held[0]], "id": best_.held[1], "score": best_.held[2]})

        rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(near, "qid BIGINT, id BIGINT, score DOUBLE")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "qid BIGINT, id BIGINT, score DOUBLE, rank INT")
    return best(out, top_k)


def vector_links(vectors: DataFrame, key: str, vector: str, queries: DataFrame, threshold: float, spark_blocks: int = BLOCK) -> DataFrame:
    """qid, id, score: every vector whose inner product with one of ``queries`` (qid, q) is at least ``threshold``.

    As :func:`vector_search`, but all pairs at or over the threshold go out, however many a query has.
    """
    import numpy as np
    import pandas as pd

    out = None
    for block in _blocks(queries.filter("q IS NOT NULL"), spark_blocks):
        held = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)))

        def link(batches, held=held):
            qid, q = held.value
            for b in batches:
                v, ids = np.stack(b["v"].to_numpy()).astype(np.float64), b["id"].to_numpy()
                for at in range(0, len(v), 256):
                    s = np.round(q @ v[at : at + 256].T, 6)
                    i, j = np.nonzero(s >= threshold)
                    yield pd.DataFrame({"qid": qid[i], "id": ids[at + j], "score": s[i, j]})

        rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(link, "qid BIGINT, id BIGINT, score DOUBLE")
        out = rows if out is None else out.unionByName(rows)
    return vectors.sparkSession.createDataFrame([], "qid BIGINT, id BIGINT, score DOUBLE") if out is None else out


def _blocks(queries: DataFrame, size: int):
    block = []
    for r in queries.select("qid", "q").toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def index_kind(n: int) -> dict[str, object]:
    """Which index to use for ``n`` vectors, and its parameters."""
    if n < 10_000:
        return {"kind": "flat"}
    if n < 100_000:
        lists = max(1, int(n**0.5))
        return {"kind": "ivf", "nlist": lists, "nprobe": max(1, lists // 10)}
    return {"kind": "hnsw", "m": 16, "ef_construction": 200, "ef_search": 16}


def inverted_file(vectors: DataFrame, key: str, vector: str, lists: int, sample: int = 50_000, seed: int = 7) -> tuple[DataFrame, object]:
    """(id, v, list) of every vector, and the centres; centres are fitted on at most ``sample`` vectors, all are indexed."""
    import numpy as np
    import pandas as pd

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    fit = np.stack([r[0] for r in rows.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select("v").collect()]).astype(float)
    centres = fit[np.random.default_rng(seed).choice(len(fit), min(lists, len(fit)), replace=False)]
    for _ in range(10):
        near = (fit @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = fit[near == c].mean(0)
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        c = held.value
        for b in batches:
            v = np.stack(b["v"].to_numpy()).astype(float)
            yield b.assign(list=(v @ c.T - (c**2).sum(1) / 2).argmax(1).astype("int32"))

    return rows.mapInPandas(place, "id BIGINT, v ARRAY<FLOAT>, list INT"), centres


def inverted_file_search(index: DataFrame, centres, queries: DataFrame, top_k: int, probe: int) -> DataFrame:
    """qid, id, score, rank: approximate nearest vectors, looking into the ``probe`` lists nearest to each query."""
    import numpy as np

    held = index.sparkSession.sparkContext.broadcast(centres)

    def lists(batches):
        c = held.value
        for b in batches:
            q = np.stack(b["q"].to_numpy()).astype(float)
            order = np.argsort(-(q @ c.T - (c**2).sum(1) / 2), axis=1)[:, :probe]
            out = b.loc[b.index.repeat(order.shape[1])]
            yield out.assign(list=order.ravel().astype("int32"))

    asked = queries.filter("q IS NOT NULL").select(F.col("qid").cast("bigint").alias("qid"), "q").mapInPandas(lists, "qid BIGINT, q ARRAY<FLOAT>, list INT")
    return best(asked.join(index, "list").select("qid", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")), top_k)


def calibrated_probe(index: DataFrame, centres, vectors: DataFrame, key: str, vector: str, queries: DataFrame, top_k: int, recall: float = 0.9, sample: int = 200, seed: int = 7) -> int:
    """The least number of lists to look into that finds at least ``recall`` of the exact ``top_k`` for a sample of at most ``sample`` of ``queries``.

    For each exact neighbour it is counted in which of a query's lists it lies, nearest list first, so one exact search of the sample tells the recall of
    every number of lists.
    """
    import numpy as np

    some = queries.filter("q IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "qid")).limit(sample)
    exact = vector_search(vectors, key, vector, some, top_k).select("qid", "id")
    rows = exact.join(index.select("id", "list"), "id").join(some, "qid").select("q", "list").collect()  # at most sample x top_k
    if not rows:
        return 1
    q, own = np.array([r["q"] for r in rows], dtype=float), np.array([r["list"] for r in rows])
    order = np.argsort(-(q @ centres.T - (centres**2).sum(1) / 2), axis=1)
    place = np.argmax(order == own[:, None], axis=1)
    return int(np.sort(place)[int(np.ceil(recall * len(place))) - 1]) + 1


def fused(first: DataFrame, second: DataFrame, top_k: int = 10, weight_first: float = 1.0, weight_second: float = 1.0) -> DataFrame:
    """qid, id, score, rank: reciprocal rank fusion of two rankings (qid, id, rank); an id of either list is in the result."""
    a, b = first.select("qid", "id", F.col("rank").alias("r1")), second.select("qid", "id", F.col("rank").alias("r2"))
    part = lambda r, w: F.coalesce(F.lit(float(w)) / (RRF + F.col(r)), F.lit(0.0))
    return best(a.join(b, ["qid", "id"], "full_outer").select("qid", "id", F.round(part("r1", weight_first) + part("r2", weight_second), 6).alias("score")), top_k)


def matches(docs: DataFrame, pattern: str, case_sensitive: bool = False, context: int = 30) -> DataFrame:
    """chunk_id, file, line, snippet, n: one row for each match of ``pattern`` in a text, the n-th of its chunk."""
    p = pattern if case_sensitive else f"(?i){pattern}"
    # Each piece is what stands before a match, together with the match.
    piece = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s)\G.*?(?:{p})"), 0)
    rows = docs.filter(F.col("text").rlike(p)).select("chunk_id", "file", "start_line", "text", F.posexplode(F.transform(piece, lambda x: F.length(x))).alias("n", "size"), piece.alias("pieces"))
    upto = F.array_join(F.slice("pieces", F.lit(1), F.col("n") + 1), "")
    hit = F.regexp_extract(F.element_at("pieces", F.col("n") + 1), f"(?s)^.*?({p})$", 1)
    rows = rows.withColumn("before", F.length(upto) - F.length(hit)).withColumn("hit", hit)
    head = F.substring(F.col("text"), F.lit(1), F.col("before"))
    line = F.col("start_line") + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    begin = F.greatest(F.col("before") - context, F.lit(0))
    snippet = F.substring(F.col("text"), begin + 1, F.col("before") - begin + F.length("hit") + context)
    return rows.select("chunk_id", "file", line.cast("int").alias("line"), snippet.alias("snippet"), F.col("n").cast("int").alias("n"))


def files_like(docs: DataFrame, pattern: str, glob: bool = False) -> DataFrame:
    """file: the distinct files whose path matches."""
    return docs.select("file").distinct().filter(F.col("file").rlike(glob_pattern(pattern) if glob else pattern))


def symbol_search(symbols: DataFrame, name: str) -> DataFrame:
    """name, file, start_line, kind: exact, prefix and fuzzy hits (contained, or two edits away for names over 3 letters)."""
    low, q = F.lower("name"), name.strip().lower()
    fuzzy = low.contains(q) | (F.levenshtein(low, F.lit(q), 2) >= 0) if len(q) > 3 else low.contains(q)
    kind = F.when(low == q, "exact").when(low.startswith(q), "prefix").when(fuzzy, "fuzzy")
    return symbols.filter("name IS NOT NULL").select("name", "file", "start_line", kind.alias("kind")).filter("kind IS NOT NULL")


def symbols_named(docs: DataFrame, query: str, nearest: DataFrame | None = None, top_k: int = 10) -> DataFrame:
    """chunk_id, name, score, rank: definitions whose name holds the query (1 if it is the query, else .8), topped up to ``top_k`` by the ``nearest`` chunks
    (id, score) whose name isn't among them yet."""
    low, q = F.lower("name"), check_search(query, top_k).lower()
    named = docs.filter("name IS NOT NULL").filter(low.contains(q)).select("chunk_id", "name", F.when(low == q, 1.0).otherwise(0.8).alias("score"), F.lit(1).alias("way"))
    rows = named
    if nearest is not None:
        other = docs.filter("name IS NOT NULL").select("chunk_id", "name").join(nearest.select(F.col("id").alias("chunk_id"), "score"), "chunk_id").join(named.select("name").distinct(), "name", "left_anti")
        rows = named.unionByName(other.select("chunk_id", "name", "score", F.lit(2).alias("way")))
    return rows.orderBy("way", F.desc("score"), "chunk_id").limit(top_k).select("chunk_id", "name", "score", F.row_number().over(Window.orderBy("way", F.desc("score"), "chunk_id")).alias("rank"))


def modified_only(hits: DataFrame, docs: DataFrame, dirty: DataFrame, imports: DataFrame, top_k: int = 10) -> DataFrame:
    """qid, id, score, is_edited, rank: the first ``top_k`` of each query's hits (qid, id, score) in files that are dirty (buffer_id, file) or imported by one
    (``imports`` buffer_id, file, target), edited ones first."""
    near = imports.join(dirty.select("buffer_id", "file").distinct(), ["buffer_id", "file"], "left_semi").select("buffer_id", F.col("target").alias("file"), F.lit(False).alias("is_edited"))
    scope = dirty.select("buffer_id", "file", F.lit(True).alias("is_edited")).unionByName(near).groupBy("buffer_id", "file").agg(F.max("is_edited").alias("is_edited"))
    rows = best(hits.join(docs.select(F.col("chunk_id").alias("id"), "buffer_id", "file"), "id").join(scope, ["buffer_id", "file"]).select("qid", "id", "score", "is_edited"), top_k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("is_edited"), F.desc("score"), "id")))


def scope_estimate(docs: DataFrame, dirty: DataFrame) -> DataFrame:
    """buffer_id, searched, skipped, speedup: what a search of the dirty files alone (buffer_id, file) saves, at ten chunks a file."""
    all_ = docs.groupBy("buffer_id").agg(F.countDistinct("file").alias("files"))
    own = dirty.groupBy("buffer_id").agg(F.countDistinct("file").alias("dirty"))
    rows = all_.join(own, "buffer_id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(0)))
    return rows.select("buffer_id", (F.col("dirty") * 10).alias("searched"), F.greatest(F.lit(0), (F.col("files") - F.col("dirty")) * 10).alias("skipped"), F.round(F.greatest(F.lit(1.0), F.col("files") * 10 / F.greatest(F.col("dirty") * 10, F.lit(1))), 1).alias("speedup"))


def score_buckets(hits: DataFrame, threshold: float = 0.8, expected: int | None = None) -> DataFrame:
    """qid, id, score, bucket: each query's hits (qid, id, score) by falling score in buckets of like scores.

    A hit joins the first bucket whose mean is at most max(.05, 1 - threshold) away, else it opens one; with ``expected`` they are cut into
    as many equal parts instead. The scores of one query, which are its top-k, pass in order.
    """
    if expected:
        return hits.select("qid", "id", "score", F.ntile(expected).over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).alias("bucket"))
    tolerance = max(0.05, 1.0 - threshold)
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id"))).alias("h"))  # the top-k of one query
    empty = F.array().cast("array<struct<n: double, total: double>>")
    start = F.struct(empty.alias("b"), F.array().cast("array<struct<id: bigint, score: double, bucket: int>>").alias("out"))

    def join(state, x):
        score = -x["m"]
        at = F.array_position(F.transform(state["b"], lambda b: F.abs(score - b["total"] / b["n"]) <= tolerance), True).cast("int")
        place = F.when(at > 0, at).otherwise(F.size(state["b"]) + 1)
        grown = F.when(at > 0, F.transform(state["b"], lambda b, i: F.when(i + 1 == at, F.struct((b["n"] + 1).alias("n"), (b["total"] + score).alias("total"))).otherwise(b))).otherwise(F.concat(state["b"], F.array(F.struct(F.lit(1.0).alias("n"), score.alias("total")))))
        return F.struct(grown.alias("b"), F.concat(state["out"], F.array(F.struct(x["id"].alias("id"), score.alias("score"), place.cast("int").alias("bucket")))).alias("out"))

    return rows.select("qid", F.inline(F.aggregate("h", start, join, lambda s: s["out"])))


def bucket_facts(buckets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """qid, bucket, size, mean, compactness, advice: each bucket's size, mean score, how near its scores are, and what may be done with its members."""
    tolerance = max(0.05, 1.0 - threshold)
    mean = F.round(F.avg("score").over(Window.partitionBy("qid", "bucket")), 4)
    by = buckets.withColumn("mean", mean).groupBy("qid", "bucket").agg(F.count("*").alias("size"), F.first("mean").alias("mean"), F.max(F.abs(F.col("score") - F.col("mean"))).alias("far"))
    advice = F.when(F.col("size") >= 3, "extract_method").when(F.col("size") == 2, "create_helper").otherwise("review_individually")
    return by.select("qid", "bucket", "size", "mean", F.round(F.greatest(F.lit(0.0), 1 - F.when(F.col("size") > 1, F.col("far")).otherwise(0.0) / tolerance), 3).alias("compactness"), advice.alias("advice"))


#: Words that a profile adds to a query (fixed values).
PROFILE_WORDS = {"reviewer": "review refactor improve", "debugger": "error bug exception fail", "architect": "interface api design public", "documenter": "documentation example guide"}


def adapted(query: Column, profile: Column) -> Column:
    """The query with the words of its profile; of an unknown or null profile as it is."""
    words = F.create_map(*[F.lit(x) for pair in PROFILE_WORDS.items() for x in pair])
    return F.concat(query, F.coalesce(F.concat(F.lit(" "), F.try_element_at(words, F.lower(profile))), F.lit("")))


def cached_queries(cache: DataFrame, asked: DataFrame, least: float = 0.95) -> DataFrame:
    """id, kind, hit: for each query asked (id, buffer_id, query, v) the cached one (cached, buffer_id, query, v) of its buffer that answers it:
    the same but for case and margins (exact), else the first whose cosine is at least ``least`` (similar), else none (miss)."""
    norm = lambda c: F.lower(F.trim(c))
    c = cache.select("cached", "buffer_id", norm("query").alias("key"), l2_normalized(F.col("v")).alias("cv"))
    exact = asked.select("id", "buffer_id", norm("query").alias("key")).join(c.groupBy("buffer_id", "key").agg(F.min("cached").alias("exact")), ["buffer_id", "key"]).select("id", "exact")
    rest = asked.join(exact, "id", "left_anti")
    links = vector_links(c, "cached", "cv", rest.select(F.col("id").alias("qid"), l2_normalized(F.col("v")).alias("q")), least)
    same = links.select(F.col("qid").alias("id"), F.col("id").alias("cached")).join(asked.select("id", "buffer_id"), "id").join(c.select("cached", F.col("buffer_id").alias("cb")), "cached").filter("cb = buffer_id")
    similar = same.groupBy("id").agg(F.min("cached").alias("similar"))
    rows = asked.select("id").distinct().join(exact, "id", "left").join(similar, "id", "left")
    return rows.select("id", F.when(F.col("exact").isNotNull(), "exact").when(F.col("similar").isNotNull(), "similar").otherwise("miss").alias("kind"), F.coalesce("exact", "similar").alias("hit"))


def facet_filter(docs: DataFrame, language: str | None = None, path_regex: str | None = None, types: list[str] | None = None, min_lines: int | None = None, max_lines: int | None = None, file_glob: str | None = None) -> DataFrame:
    """The rows that meet all given facets; filters come before any scoring and reach the scan where they can."""
    n = F.col("end_line") - F.col("start_line") + 1
    for given, test in (
        (language, F.lower(F.trim("language")) == (language or "").lower()), (path_regex, F.col("file").rlike(path_regex or "")), (types, F.col("type").isin(types or [])),
        (min_lines, n >= (min_lines or 0)), (max_lines, n <= (max_lines or 0)), (file_glob, F.col("file").rlike(glob_pattern(file_glob or ""))),
    ):
        if given is not None:
            docs = docs.filter(test)
    return docs


def score_parts(docs: DataFrame, query: str, wanted_type: str | None = None) -> DataFrame:
    """id, lexical, symbol, bonus: what each row of ``docs`` scores beside its vector: the share of the query's distinct terms that the text holds, how
    well the name fits, and .05 for the wanted type."""
    q = check_search(query, 1).lower()
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(q.split())])
    name = F.lower(F.coalesce("name", F.lit("")))
    lexical = F.coalesce(F.size(F.filter(terms, lambda t: F.contains(F.lower("text"), t))) / F.size(terms), F.lit(0.0))
    symbol = F.when(name == q, 1.0).when((F.length(name) > 0) & name.contains(q), 0.7).when((F.length(name) > 0) & F.exists(terms, lambda t: F.contains(name, t)), 0.5).otherwise(0.0)
    bonus = F.when(F.col("type") == wanted_type, 0.05).otherwise(0.0) if wanted_type else F.lit(0.0)
    return docs.select(F.col("chunk_id").cast("bigint").alias("id"), lexical.alias("lexical"), symbol.alias("symbol"), bonus.alias("bonus"))


def intent_centres(vectors: DataFrame) -> DataFrame:
    """cluster, v: the mean vector of each cluster (cluster, v) at unit length; only sums by place are exchanged."""
    each = vectors.filter("v IS NOT NULL").select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    by = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))  # as many as a vector has places
    return by.select("cluster", l2_normalized(F.col("v")).alias("v"))


def faceted(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query: str, top_k: int = 10, wanted_type: str | None = None) -> DataFrame:
    """qid, chunk_id, score, lexical, symbol, confidence, why, rank: the best ``top_k`` of ``docs`` for each of ``queries`` (qid, q).

    score = .7 semantic + .15 lexical + .15 symbol + .05 if the type is the wanted one; semantic is the inner product with
    the row of ``vectors`` (id, v), lexical the share of the query's distinct terms that the text has. Every row of ``docs``
    that has a vector is scored; each task keeps the ``top_k`` whole scores of each query.
    """
    parts = score_parts(docs, query, wanted_type)
    check_search(query, top_k)
    ranked = best(_faceted_scores(parts.join(vectors.filter("v IS NOT NULL"), "id").select("id", "v", (0.15 * F.col("lexical") + 0.15 * F.col("symbol") + F.col("bonus")).alias("rest")), queries, top_k), top_k)
    ranked = ranked.join(parts.drop("bonus"), "id").withColumnRenamed("id", "chunk_id")
    stats = Window.partitionBy("qid")
    gap, mean = F.max("score").over(stats) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(stats), F.avg("score").over(stats)
    confidence = (
        F.when(F.col("score") < 0.3, "low").when(F.col("score") > 0.85, "high").when((gap > 0.2) & (F.col("rank") == 1), "high").when(gap < 0.05, "low")
        .when(F.col("score") > mean + 0.1, "high").when(F.col("score") < mean - 0.3, "low").otherwise("medium")
    )
    why = F.concat_ws(" ", F.when(F.col("semantic") > 0.7, "Strong semantic match.").when(F.col("semantic") > 0.4, "Moderate semantic match."), F.when(F.col("lexical") > 0.5, "Query terms found in the text."), F.when(F.col("symbol") > 0, "Symbol name matches."))
    return ranked.select("qid", "chunk_id", "score", F.round("lexical", 3).alias("lexical"), F.round("symbol", 3).alias("symbol"), confidence.alias("confidence"), why.alias("why"), "rank")


def _faceted_scores(rows: DataFrame, queries: DataFrame, top_k: int, spark_blocks: int = 2_000) -> DataFrame:
    """qid, id, semantic, score: of each task the best ``top_k`` of ``rows`` (id, v, rest) by .7 semantic + rest."""
    import numpy as np
    import pandas as pd

    schema, out = "qid BIGINT, id BIGINT, semantic DOUBLE, score DOUBLE", None
    for block in _blocks(queries.filter("q IS NOT NULL"), spark_blocks):
        held = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)))

        def score(batches, held=held):
            qid, q = held.value
            best_, step = TopScores(len(qid), top_k), max(1, SCORE_BYTES // (24 * len(qid)))
            for b in batches:
                ids = b["id"].to_numpy()
                for at in range(0, len(ids), step):
                    v, rest = np.stack(b["v"].to_numpy()[at : at + step]).astype(np.float64), b["rest"].to_numpy()[at : at + step]
                    s = np.round(q @ v.T, 6)
                    total = np.floor((0.7 * s + rest) * 1000 + 0.5 + 1e-9) / 1000  # halves go up, as F.round does
                    best_.add(total, ids[at : at + step], s)
            none = len(best_.held) < 4
            yield pd.DataFrame({"qid": qid[best_.held[0]], "id": best_.held[1], "semantic": best_.held[2] if none else best_.held[3], "score": best_.held[2]})

        part = rows.mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def result_confidence(scored: DataFrame) -> DataFrame:
    """qid, id, score, confidence: high, medium or low by the score's place among those of its query."""
    w = Window.partitionBy("qid")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    mean, dev = F.avg("score").over(w), F.stddev_pop("score").over(w)
    gap = F.max("score").over(w) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w)
    label = (
        F.when(F.col("score") < 0.3, "low").when(F.col("score") > 0.9, "high").when((gap > 0.2) & (F.col("rank") == 1), "high").when(gap < 0.03, "low")
        .when(F.col("score") >= mean + 0.5 * dev, "high").when(F.col("score") <= mean - 2 * dev, "low").otherwise("medium")
    )
    return ranked.select("qid", "id", "score", label.alias("confidence"))


def most_similar(left: DataFrame, right: DataFrame, top_k: int) -> DataFrame:
    """id, best, score: for each vector of ``left`` (id, v) the nearest of ``right`` (id, v), of the ``top_k`` nearest the first."""
    return vector_search(right, "id", "v", left.select(F.col("id").alias("qid"), F.col("v").alias("q")), top_k).filter("rank = 1").select(F.col("qid").alias("id"), F.col("id").alias("best"), "score")
