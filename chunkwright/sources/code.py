"""Reading code folders and logs, and cutting files into chunks.

Null contents give no chunks; files that can't be parsed fall back on sliding windows; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lex import BRACE_LANGUAGES, definitions

WINDOW, OVERLAP = 30, 5


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """path (below the folder), mtime, size, hash, content, lines of the files whose name matches ``pattern``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    below = F.regexp_replace(F.replace("path", F.lit(folder.rstrip("/") + "/"), F.lit("")), "^file:/*", "")
    text = F.decode("content", "UTF-8")
    return raw.select(below.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), text.alias("content"), F.size(F.split(text, "\n")).alias("lines"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log in JSON lines; lines that can't be read are left out."""
    schema = "timestamp DOUBLE, operation STRING, buffer_id STRING, user_id STRING, role STRING, status STRING, details MAP<STRING, STRING>, duration_ms INT, error_message STRING"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("operation IS NOT NULL").withColumnRenamed("timestamp", "ts")


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines."""
    rows.withColumnRenamed("ts", "timestamp").write.mode("append").json(path)


def save_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table in Parquet by buffer; buffers that are written again are replaced, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buffer_id").parquet(path)


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, at, file: an exported ``git log --name-only --format='commit %H|%an|%ct'``, one row per file of each commit."""
    # Records end where the next commit begins, so a long log is split over tasks.
    text = spark.read.text(path, lineSep="\ncommit ").select(F.regexp_replace("value", "^commit ", "").alias("c")).filter("length(trim(c)) > 0")
    head = F.split(F.substring_index("c", "\n", 1), r"\|")
    return text.select(head[0].alias("commit"), head[1].alias("author"), head[2].cast("bigint").alias("at"), F.explode(F.filter(F.slice(F.split("c", "\n"), 2, 2**30), lambda x: F.length(F.trim(x)) > 0)).alias("file"))


def sliding_chunks(files: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """key, start_line, end_line, text: windows of ``window`` lines that share ``overlap`` lines, until the end is reached."""
    step = window - overlap
    lines = files.filter(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("l"))
    last = F.greatest(F.lit(0), F.ceil((F.size("l") - window) / step)).cast("int")
    each = lines.select(key, "l", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return each.select(key, (F.col("k") * step + 1).alias("start_line"), F.least(F.col("k") * step + window, F.size("l")).alias("end_line"), F.array_join(F.slice("l", F.col("k") * step + 1, window), "\n").alias("text"))


def _python_chunks(text: str) -> list[tuple[int, int, str, str | None]] | None:
    """(first line, last line, type, name) of definitions and of the gaps between them; None if the text doesn't parse."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found: list[tuple[int, int, str, str | None]] = []

    def walk(node: ast.AST, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "nested_function" if inside else "function"
                found.append((child.lineno, child.end_lineno, kind, child.name))
                walk(child, kind)
            else:
                walk(child, inside)

    walk(tree, "")
    found.sort(key=lambda f: (f[0], -f[1]))
    return found + _gaps(text, found)


def _gaps(text: str, found: list) -> list[tuple[int, int, str, None]]:
    """The lines outside of all definitions, as orphans without blank lines at their ends, where they aren't blank."""
    lines, upto, gaps = text.split("\n"), 0, []
    for a, z, _, _ in [*sorted(found, key=lambda f: (f[0], -f[1])), (len(lines) + 1, 0, "", None)]:
        filled = [n for n in range(upto + 1, a) if lines[n - 1].strip()]
        if filled:
            gaps.append((filled[0], filled[-1], "orphan", None))
        upto = max(upto, z)
    return gaps


def cut_chunks(path: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, str, str | None]]:
    """(first line, last line, type, name) of the chunks of a file: definitions and gaps of Python, JavaScript, Java and Go, else sliding windows."""
    plain = text.replace("\r", "").lstrip("\ufeff")
    suffix = path.rsplit(".", 1)[-1].lower()
    cut = None
    if suffix in ("py", "pyw", "pyi"):
        cut = _python_chunks(plain)
    elif suffix in BRACE_LANGUAGES:
        found = definitions(plain, BRACE_LANGUAGES[suffix])
        cut = found + _gaps(plain, found) if found else None
    if cut is None:
        n = text.count("\n") + 1
        return [(s + 1, min(s + window, n), "sliding", None) for s in range(0, max(1, n - overlap), window - overlap)]
    return sorted(cut, key=lambda f: (f[0], -f[1], f[2]))


def definition_chunks(files: DataFrame, key: str, path: str, text: str, handler=cut_chunks) -> DataFrame:
    """key, start_line, end_line, type, name, text: files by definition and gap where their language is known and they can be read, all others by sliding window.

    A chunk's text has no byte order mark before it and no carriage return after it. ``handler`` (path, text) gives the (first line, last line, type, name) of a file's chunks, so that any chunker can be used.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for k, p, t in zip(b["k"], b["p"], b["t"], strict=True):
                lines = t.split("\n")
                out += [(k, a, z, kind, name, "\n".join(lines[a - 1 : z]).removesuffix("\r").removeprefix("\ufeff")) for a, z, kind, name in handler(p or "", t)]
            yield pd.DataFrame(out, columns=[key, "start_line", "end_line", "type", "name", "text"])

    kind = files.schema[key].dataType.simpleString()
    rows = files.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"{key} {kind}, start_line INT, end_line INT, type STRING, name STRING, text STRING")


def folder_hashes(files: DataFrame) -> DataFrame:
    """buffer_id, hash: SHA-256 over the sorted path, time and size of the files of each buffer.

    The files of a buffer pass one task in order, as a stream of names that goes into the hash and is not kept.
    """
    import hashlib

    import pandas as pd

    def run(batches):
        at, h, done = None, None, []
        for b in batches:
            for k, line in zip(b["buffer_id"], b["line"], strict=True):
                if h is None or k != at:
                    if h is not None:
                        done.append((at, h.hexdigest()))
                    at, h = k, hashlib.sha256()
                h.update(line.encode())
            yield pd.DataFrame(done, columns=["buffer_id", "hash"])
            done = []
        if h is not None:
            yield pd.DataFrame([(at, h.hexdigest())], columns=["buffer_id", "hash"])

    line = F.concat_ws("::", "path", F.unix_timestamp("mtime"), F.coalesce("size", F.lit(0)))
    rows = files.repartition("buffer_id").sortWithinPartitions("buffer_id", "path", "mtime", "size").select("buffer_id", line.alias("line"))
    return rows.mapInPandas(run, "buffer_id STRING, hash STRING")


def size_budget(files: DataFrame, dim: int = 384, most_mb: int = 500) -> DataFrame:
    """buffer_id, files, n_lines, tokens, bytes, fits: what an index of each buffer would take."""
    by = files.groupBy("buffer_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("n_lines"))
    tokens = F.col("n_lines") * 8
    return by.select("buffer_id", "files", "n_lines", tokens.alias("tokens"), (tokens * (dim * 4 + 8 + 256)).alias("bytes"), (tokens * (dim * 4 + 8 + 256) <= most_mb * 1024 * 1024).alias("fits"))


def external_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """buffer_id, path, change: new, deleted or changed files of each buffer by hash (buffer_id, path, hash)."""
    keys = ["buffer_id", "path"]
    o, n = old.select(*keys, F.col("hash").alias("was"), F.lit(True).alias("o")), new.select(*keys, F.col("hash").alias("now"), F.lit(True).alias("n"))
    rows = o.join(n, keys, "full_outer")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return rows.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def resource_estimate(files: DataFrame, dim: int = 384, per_chunk: int = 25, cuda: bool = False) -> DataFrame:
    """buffer_id, files, n_lines, chunks, ram_mb, embed_s, search_ms, warning: what embedding each buffer (lines, size) would take.

    Vectors of 4 bytes, half as much again for an index and a fifth of the files' size; 50 ms a chunk (5 on a GPU). The warning is for over
    50,000 chunks, else for over 4 GB.
    """
    by = files.groupBy("buffer_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("n_lines"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    by = by.withColumn("chunks", F.greatest(F.lit(1), F.floor(F.col("n_lines") / per_chunk)))
    ram = F.col("chunks") * dim * 4 * 1.5 / 1048576 + F.col("bytes") * 0.2 / 1048576
    by = by.withColumn("ram_mb", F.round(ram, 2))
    warning = F.when(F.col("chunks") > 50_000, "many chunks").when(F.col("ram_mb") > 4096, "much memory")
    return by.select("buffer_id", "files", "n_lines", "chunks", "ram_mb", F.round(F.col("chunks") * (0.005 if cuda else 0.05), 2).alias("embed_s"), F.lit(1.0 if cuda else 20.0).alias("search_ms"), warning.alias("warning"))


def existing_buffers(known: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, buffer_id: the buffers that already hold a folder, by its hash; both have (buffer_id, hash)."""
    return asked.select(F.col("buffer_id").alias("asked"), "hash").join(known.select("buffer_id", "hash"), "hash").select("asked", "buffer_id")


def blocks(files: DataFrame, key: str, text: str, size: int = 1 << 20) -> DataFrame:
    """key, block, start_line, end_line, content: texts in blocks of whole lines; a line lies in the block in which its first character does."""
    lines = files.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("n", "body"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("block", F.floor(F.coalesce(F.sum(F.length("body") + 1).over(w), F.lit(0)) / size))
    by = placed.groupBy(key, "block").agg((F.min("n") + 1).alias("start_line"), (F.max("n") + 1).alias("end_line"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("l"))  # the lines of one block
    return by.select(key, "block", "start_line", "end_line", F.array_join(F.transform("l", lambda x: x["body"]), "\n").alias("content"))


def break_point(text: Column, target: Column, reach: int = 5000) -> Column:
    """Where to cut a text at or before ``target`` (characters from 0): before the last line within ``reach`` characters that begins a
    definition or decorator, else after the last line end."""
    begin = F.greatest(F.lit(0), target - reach)
    region = F.substring(text, begin + 1, target - begin)
    last = F.regexp_extract(region, r"(?s)^(.*\n)(?:def |class |@)", 1)
    first = region.rlike(r"^(?:def |class |@)")
    upto = F.substring(text, F.lit(1), F.least(target + 1, F.length(text)))
    return F.when(F.length(last) > 0, begin + F.length(last)).when(first, begin).otherwise(F.greatest(F.lit(1), F.length(F.regexp_extract(upto, r"(?s)^(.*\n)", 1)))).cast("int")


def line_range(text: Column, start: int, stop: int) -> Column:
    """Lines ``start`` (from 1) up to but without ``stop``."""
    return F.array_join(F.slice(F.split(text, "\n"), start, max(0, stop - start)), "\n")
