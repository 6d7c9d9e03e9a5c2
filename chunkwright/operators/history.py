"""Audit logs, metrics, state histories and differences between versions.

Rows that are delivered twice are the business of the caller (``distinct`` before); null groups are groups of their own;
empty tables give no rows, or zeros where a single row of totals is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States and where each may go (fixed values).
TRANSITIONS = {"ready": ["dirty", "rebuilding"], "dirty": ["ready", "rebuilding"], "rebuilding": ["ready"]}
BUCKETS = [10, 50, 100, 500, 1000, 5000, 10000]
CHANGE_WORDS = [("features", ["feat", "feature", "add", "new"]), ("fixes", ["fix", "bug", "patch", "hotfix"]), ("breaking", ["breaking", "remove", "delete", "deprecate"])]
ROLE_LIMITS = {"admin": 300, "developer": 60, "agent": 60, "viewer": 30, "guest": 10}


def audit_stats(audit: DataFrame) -> DataFrame:
    """dimension, value, n: counts by status, operation and user and in all, in one pass."""
    sets = audit.groupingSets([["status"], ["operation"], ["user_id"], []], "status", "operation", "user_id").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "operation").when(F.col("g") == 6, "user").otherwise("total")
    value = F.when(F.col("g") == 3, F.col("status")).when(F.col("g") == 5, F.col("operation")).when(F.col("g") == 6, F.col("user_id"))
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def audit_filter(audit: DataFrame, user: str | None = None, operations: list[str] | None = None, status: str | None = None, since: float | None = None, limit: int | None = None) -> DataFrame:
    """The rows that meet all given filters, newest first if there is a limit."""
    for given, test in ((user, F.col("user_id") == user), (operations, F.col("operation").isin(operations or [])), (status, F.col("status") == status), (since, F.col("ts") >= (since or 0.0))):
        if given is not None:
            audit = audit.filter(test)
    return audit.orderBy(F.desc("ts"), "operation", "user_id").limit(limit) if limit else audit


def histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, count, sum, min, max, mean, p50, p95, p99: the p-th value is the one at index ``int(count * p)`` of the sorted values.

    Values are counted before they are ranked, so what is ordered is as large as the number of distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("__k").over(w)).withColumn("n", F.sum("__k").over(Window.partitionBy(by)))
    at = lambda p: F.when(F.first("n") >= 2, F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("__v")))).otherwise(F.lit(0))
    return upto.groupBy(by).agg(F.sum("__k").alias("count"), F.sum(F.col("__v") * F.col("__k")).alias("sum"), F.min("__v").alias("min"), F.max("__v").alias("max"), F.round(F.sum(F.col("__v") * F.col("__k")) / F.sum("__k"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def cumulative_buckets(rows: DataFrame, by: str, value: str, bounds: list[int] = BUCKETS) -> DataFrame:
    """by, le, n: how many values are at most each bound, as in exported metrics."""
    wide = rows.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(str(b)) for b in bounds], F.count(value).alias("+Inf"))
    return wide.unpivot([by], [*map(str, bounds), "+Inf"], "le", "n")


def hit_rate(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """by, hits, rate."""
    return rows.groupBy(by).agg(F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"))


def health(buffers: DataFrame, dirty: DataFrame, now: Column) -> DataFrame:
    """buffer_id, dirty, age_days, level: ok, warning or degraded by dirty files (5, 20) and age (7, 30 days)."""
    n = dirty.groupBy("buffer_id").agg(F.count("*").alias("dirty"))
    rows = buffers.join(n, "buffer_id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(0))).withColumn("age_days", F.datediff(now, "modified_at"))
    level = F.when(F.col("dirty") >= 20, "degraded").when(F.col("dirty") >= 5, "warning").when(F.col("age_days") >= 30, "degraded").when(F.col("age_days") >= 7, "warning").otherwise("ok")
    return rows.select("buffer_id", "dirty", "age_days", level.alias("level"))


def utilisation(share: Column) -> Column:
    """critical from .9 of a limit on, high from .75 on, else ok."""
    return F.when(share >= 0.9, "critical").when(share >= 0.75, "high").otherwise("ok")


def category(message: Column) -> Column:
    """Category of a change message: the first whose words it holds, else other."""
    low, out = F.lower(message), F.lit("other")
    for name, words in reversed(CHANGE_WORDS):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def invalid_transitions(log: DataFrame) -> DataFrame:
    """buffer_id, seq, before, state: steps of a state log (buffer_id, seq, state) that the state machine doesn't allow."""
    w = Window.partitionBy("buffer_id").orderBy("seq")
    rows = log.withColumn("before", F.lag("state").over(w)).filter("before IS NOT NULL AND before <> state")
    allowed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        allowed = allowed | ((F.col("before") == a) & F.col("state").isin(bs))
    return rows.filter(~allowed).select("buffer_id", "seq", "before", "state")


def pending_transactions(log: DataFrame) -> DataFrame:
    """txid, status: transactions of a write-ahead log (txid, seq, status) whose last status is pending."""
    return log.groupBy("txid").agg(F.max_by("status", "seq").alias("status")).filter("status = 'pending'")


def chunk_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: added, removed, changed or kept of chunks by key and text hash."""
    h = lambda d, n: d.select(*keys, F.sha2(F.coalesce("text", F.lit("")), 256).alias(n))
    both = h(old, "was").join(h(new, "now"), keys, "full_outer")
    return both.select(*keys, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("kept").alias("change"))


def changed_lines(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, line: the 1-based lines of the new text that are new or differ from the old line of the same number."""
    lines = lambda d: d.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("n", "body")).select(key, (F.col("n") + 1).alias("line"), F.xxhash64("body").alias("h"))
    o = lines(old).withColumnRenamed("h", "was")
    return lines(new).join(o, [key, "line"], "left").filter("was IS NULL OR was <> h").select(key, "line")


def conflicts(disk: DataFrame, snapshot: DataFrame, buffer: DataFrame) -> DataFrame:
    """buffer_id, path, state: same, disk, buffer, both or conflict, by hashes (buffer_id, path, hash) of the three versions of each file."""
    keys = ["buffer_id", "path"]
    d, s, b = disk.toDF(*keys, "d"), snapshot.toDF(*keys, "s"), buffer.toDF(*keys, "b")
    rows = d.join(s, keys, "full_outer").join(b, keys, "full_outer")
    on_disk, in_buffer = ~F.col("d").eqNullSafe(F.col("s")), ~F.col("b").eqNullSafe(F.col("s"))
    state = F.when(on_disk & in_buffer, F.when(F.col("d").eqNullSafe(F.col("b")), "both").otherwise("conflict")).when(on_disk, "disk").when(in_buffer, "buffer").otherwise("same")
    return rows.select(*keys, state.alias("state"))


def merged_lines(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key, merged, conflict: line-by-line three-way merge; where both sides changed a part in different ways, ours is taken and conflict set."""
    import difflib

    import pandas as pd

    def changes(a: list[str], b: list[str]) -> dict[int, tuple[int, list[str]]]:
        return {i: (j, b[k:m]) for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"}

    def merge(batches):
        for x in batches:
            out = []
            for k, b, o, t in zip(x["k"], x["b"], x["o"], x["t"], strict=True):
                a = (b or "").split("\n")
                mine, other = changes(a, (o or "").split("\n")), changes(a, (t or "").split("\n"))
                lines, at, clash = [], 0, False
                while at <= len(a):
                    step = mine.get(at) or other.get(at)
                    if step is None:
                        if at < len(a):
                            lines.append(a[at])
                        at += 1
                        continue
                    both = at in mine and at in other
                    clash |= (both and mine[at] != other[at]) or any(at < i < step[0] for i in (other if at in mine else mine))
                    lines += step[1]
                    if step[0] == at:  # an insertion: the line itself follows
                        if at < len(a):
                            lines.append(a[at])
                        at += 1
                    else:
                        at = step[0]
                out.append((k, "\n".join(lines), clash))
            yield pd.DataFrame(out, columns=[key, "merged", "conflict"])

    rows = base.select(F.col(key).alias("k"), F.col(text).alias("b")).join(ours.select(F.col(key).alias("k"), F.col(text).alias("o")), "k").join(theirs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    return rows.mapInPandas(merge, f"{key} STRING, merged STRING, conflict BOOLEAN")


def unified_diffs(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, diff: unified differences with three lines of context of the texts that differ."""
    import difflib

    import pandas as pd

    def run(batches):
        for x in batches:
            rows = [(k, "\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "old", "new", lineterm="", n=3))) for k, a, b in zip(x["k"], x["a"], x["b"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "diff"])

    rows = old.select(F.col(key).alias("k"), F.col(text).alias("a")).join(new.select(F.col(key).alias("k"), F.col(text).alias("b")), "k").filter(~F.col("a").eqNullSafe(F.col("b")))
    return rows.mapInPandas(run, f"{key} {rows.schema['k'].dataType.simpleString()}, diff STRING")


def undo_stack(edits: DataFrame, most: int = 100) -> DataFrame:
    """The last ``most`` edits of each branch (branch, seq, …), newest first by ``depth``."""
    w = Window.partitionBy("branch").orderBy(F.desc("seq"))
    return edits.withColumn("depth", F.row_number().over(w)).filter(F.col("depth") <= most)


def recalled(memory: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """key, score: memories (key, value, tags) by .5 for the query in the key, .3 in the value and .2 for each tag it holds."""
    q = query.lower()
    score = F.when(F.lower("key").contains(q), 0.5).otherwise(0.0) + F.when(F.lower("value").contains(q), 0.3).otherwise(0.0) + 0.2 * F.size(F.filter("tags", lambda t: F.contains(F.lit(q), F.lower(t))))
    return memory.select("key", F.round(score, 3).alias("score")).filter("score > 0").orderBy(F.desc("score"), "key").limit(top_k)


def allowed_requests(events: DataFrame, limits: dict[str, int] = ROLE_LIMITS) -> DataFrame:
    """user_id, minute, n, over: requests per user and minute beyond the limit of the role, a token bucket's refill seen by whole minutes."""
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    by = events.groupBy("user_id", "role", F.floor(F.col("ts") / 60).alias("minute")).agg(F.count("*").alias("n"))
    return by.select("user_id", "minute", "n", F.greatest(F.lit(0), F.col("n") - F.coalesce(F.try_element_at(table, F.lower("role")), F.lit(10))).alias("over"))


def conflict_risk(dirty: DataFrame, commits: DataFrame, dependents: DataFrame) -> DataFrame:
    """buffer_id, file, commits, dependents, risk: by commits that touch a dirty file (0-1 low, 2 medium, 3 high) and 2 dependents or more; all three by (buffer_id, file)."""
    keys = ["buffer_id", "file"]
    c = commits.groupBy(*keys).agg(F.count("*").alias("commits"))
    d = dependents.groupBy(*keys).agg(F.count("*").alias("dependents"))
    rows = dirty.select(*keys).distinct().join(c, keys, "left").join(d, keys, "left").fillna(0, ["commits", "dependents"])
    return rows.withColumn("risk", F.when(F.col("commits") >= 3, "high").when((F.col("commits") == 2) | (F.col("dependents") >= 2), "medium").otherwise("low"))


def test_run_summary(runs: DataFrame) -> DataFrame:
    """run, passed, failed, skipped, total, failures: counts of the summary lines of test runs (run, output) and the tests named as failed.

    Errors count as failed; an output without a summary has zeros.
    """
    counts = {k: F.aggregate(F.transform(F.regexp_extract_all("output", F.lit(rf"(?i)(\d+)\s+{p}"), 1), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x) for k, p in (("passed", "passed"), ("failed", "(?:failed|errors?)\\b"), ("skipped", "skipped"))}
    names = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("output", F.lit(r"(?m)^(?:FAILED|ERROR) (\S+)"), 1))), ",")
    rows = runs.filter("output IS NOT NULL").select("run", *[c.alias(k) for k, c in counts.items()], names.alias("failures"))
    return rows.select("run", "passed", "failed", "skipped", (F.col("passed") + F.col("failed") + F.col("skipped")).alias("total"), "failures")


def redo_stacks(log: DataFrame, most: int = 100) -> DataFrame:
    """branch, undoable, redoable: how many edits of each branch can be undone and redone after a log (branch, seq, action) of edit, undo and redo.

    An edit clears what could be redone; at most ``most`` edits are kept; undo and redo with nothing to take do nothing. The rows of a
    branch pass one task in order, as a stream that holds two counts.
    """
    import pandas as pd

    def run(batches):
        at, done, undone, out = None, 0, 0, []
        for b in batches:
            for branch, action in zip(b["branch"], b["action"], strict=True):
                if branch != at:
                    if at is not None:
                        out.append((at, done, undone))
                    at, done, undone = branch, 0, 0
                if action == "edit":
                    done, undone = min(most, done + 1), 0
                elif action == "undo" and done:
                    done, undone = done - 1, undone + 1
                elif action == "redo" and undone:
                    done, undone = done + 1, undone - 1
            yield pd.DataFrame(out, columns=["branch", "undoable", "redoable"])
            out = []
        if at is not None:
            yield pd.DataFrame([(at, done, undone)], columns=["branch", "undoable", "redoable"])

    rows = log.filter("branch IS NOT NULL").select(F.col("branch").cast("string"), "seq", "action").repartition("branch").sortWithinPartitions("branch", "seq")
    return rows.select("branch", "action").mapInPandas(run, "branch STRING, undoable BIGINT, redoable BIGINT")
