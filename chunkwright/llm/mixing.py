"""Mixing of sources to target shares of the tokens, with capped repeats.

The budget of a source is its target share of the tokens of all documents. A source that can't fill its budget with
``max_repeats`` uses of each record gives all of them. Any other source gives each record ``q`` whole times, as long as that
fits, and for what is left of the budget a subset of its records once more:

* records are counted by exact token length, the only facts that reach the driver: one row per source and length,
  however many records there are (a source of t tokens has at most sqrt(2 t) lengths);
* of each length the share of the rest goes in evenly, and what rounding leaves is filled by a bounded-knapsack dynamic
  program over the counts, as a bit set of the sums that can be reached, so the budget is met to the token wherever it
  can be;
* records over ``LONG`` get their share of the rest first, in seeded order of their lengths, and more of it only where the
  others can't fill what is left; their sums are told apart by 1/``EXACT`` of that, the others then fill to the token;
* which records of a length are used is decided by a seeded hash of the key, so a run can be repeated.

Defined results: sources are compared trimmed and in lower case; documents of other or null sources count for the total
only; a source without documents has 0 tokens and share 0; null and empty texts have 0 tokens and are used with the
whole passes; a null max_repeats counts as 1, a null target_share as 0; repeated rows are records of their own; keys
that tie in the hash are told apart by the key.
"""

from __future__ import annotations

import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from .tokens import encoded

SEED = 42
#: Records of one length that are ranked together; of a length with more, only the part in which its last used record lies.
RANKED = 10_000
#: Records over this length are chosen before the others, whose sums fill what is left.
LONG = 65_536
#: Rest of a budget that the dynamic program fills exactly; what is above it is filled greedily before.
EXACT = 1 << 17


def clean_source(column: str) -> F.Column:
    """A source's name, trimmed of white space and in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def fit_long(counts: list[tuple[int, int]], rest: int, others: int, seed: int = SEED) -> dict[int, int]:
    """How many of the records of each length over ``LONG`` to use, where shorter records have ``others`` tokens."""
    total = others + sum(n * c for n, c in counts)
    use = {n: c * rest // total for n, c in counts}
    left = rest * (total - others) // total - sum(n * k for n, k in use.items())
    order = [n for n, _ in counts]
    random.Random(seed).shuffle(order)
    for n in order:
        if n <= left:  # rounding took less than one record of each length
            use[n], left = use[n] + 1, left - n
    rest -= sum(n * k for n, k in use.items())
    for n in [n for n in reversed(order) if use[n]][:32] if rest > others else ():  # room for a better sum
        use[n], rest = use[n] - 1, rest + n
    while rest > others:
        # Half of what the others fill to the token is left to them, if a record fits below it.
        spare, goal = [(n, c - use[n]) for n, c in counts if n <= rest and c > use[n]], rest - min(others, EXACT) // 2
        if not spare:
            break
        room = goal if spare[0][0] <= goal else rest
        # Sums in parts of the rest, rounded up, with the step that reaches each first.
        size = min(room, EXACT)
        first = np.full(size + 1, -1, dtype=np.int32)
        first[0], steps = 0, [(0, 0, 0)]
        for n, c in spare:
            w, c, k = -(-n * size // room), min(c, room // n), 1
            while c > 0 and first[size] < 0:
                k = min(k, c)
                if w * k <= size:
                    new = np.flatnonzero((first[: size + 1 - w * k] >= 0) & (first[w * k :] < 0)) + w * k
                    first[new] = len(steps)
                    steps.append((n, k, w * k))
                c, k = c - k, k * 2
        at = int(np.flatnonzero(first >= 0)[-1])
        while at:
            n, k, w = steps[first[at]]
            use[n], rest, at = use[n] + k, rest - n * k, at - w
    return {n: k for n, k in use.items() if k}


def fit(counts: list[tuple[int, int]], rest: int, seed: int = SEED) -> dict[int, int]:
    """How many of the records of each length to use so that their sum is as near below ``rest`` as possible.

    ``counts`` has (length, records) of one source.
    """
    counts = sorted((n, c) for n, c in counts if 0 < n and c > 0)
    total = sum(n * c for n, c in counts)
    if rest <= 0 or not total:
        return {}
    if rest >= total:
        return dict(counts)
    if counts[-1][0] > LONG:
        short, long = [x for x in counts if x[0] <= LONG], [x for x in counts if x[0] > LONG]
        use = fit_long(long, rest, sum(n * c for n, c in short), seed)
        return use | fit(short, rest - sum(n * k for n, k in use.items()), seed)
    # Evenly by length; what rounding leaves comes after.
    use = {n: c * rest // total for n, c in counts}
    rest -= sum(n * k for n, k in use.items())
    spare = {n: c - use[n] for n, c in counts}
    for n, _ in reversed(counts):
        k = min(spare[n], max(0, rest - EXACT) // n)
        use[n], spare[n], rest = use[n] + k, spare[n] - k, rest - n * k
    # Sums that can be reached, as bits; of each length the copies go in as 1, 2, 4, ... so that any number is possible.
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for n, c in spare.items():
        c, k = min(c, rest // n), 1
        while c > 0 and not reach >> rest & 1:
            k = min(k, c)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            c, k = c - k, k * 2
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            use[n] += k
            at -= n * k
    return use


def measured(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens: the clean source and length of each document."""
    rows = documents.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), clean_source("source").alias("source")).alias("d"), "text")
    return encoded(rows, "d", "text", counts_only=True, path=path).select("d.doc_id", "d.source", "n_tokens")


def clean_targets(targets: DataFrame) -> DataFrame:
    return targets.select(clean_source("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).filter("source IS NOT NULL").dropDuplicates(["source"])


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens, total: what each target source has, and the tokens of all documents."""
    by = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = by.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    return clean_targets(targets).join(by, "source", "left").crossJoin(F.broadcast(total)).withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))


class Fitted(NamedTuple):
    """How one source is used: each record ``whole`` times and ``extra`` records of each length once more."""

    source: str
    target: float
    available: int
    whole: int
    extra: dict[int, int]
    counts: dict[int, int]
    reached: int


def fitted(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> list[Fitted]:
    """The budget fitting of each target source from ``sized`` (doc_id, source, n_tokens)."""
    facts = budgets(sized, targets).collect()  # one row per target source
    counts: dict[str, dict[int, int]] = {r["source"]: {} for r in facts}
    hist = sized.filter(F.col("source").isin(list(counts))).groupBy("source", "n_tokens").agg(F.count("*").alias("c"))
    for r in hist.toLocalIterator():  # bounded: lengths of a source, at most sqrt(2 x its tokens)
        counts[r["source"]][r["n_tokens"]] = r["c"]
    out = []
    for r in facts:
        target, tokens, own = r["target_share"] * r["total"], r["tokens"], counts[r["source"]]
        budget, available = int(target), tokens * r["max_repeats"]
        whole = r["max_repeats"] if available <= budget else budget // tokens
        extra = {} if available <= budget else {n: k for n, k in fit(list(own.items()), budget - whole * tokens, seed).items() if k}
        out.append(Fitted(r["source"], target, available, whole, extra, own, whole * tokens + sum(n * k for n, k in extra.items())))
    return out


def short_sources(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """source: those of ``targets`` whose fitted use stays below their share because all their records don't reach it.

    A source can also end below its target because no sum of its records meets it; that is no lack, so what the source has is
    compared with the target as well.
    """
    plan = fitted(written(measured(documents, path), "sized"), targets)
    return documents.sparkSession.createDataFrame([(p.source,) for p in plan if p.reached < p.target and p.available < p.target], "source STRING")


def mixed_documents(documents: DataFrame, targets: DataFrame, seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats: the documents of the mix and how often each is used.

    Of a length the first in the order of a seeded hash are used. No length is ranked as a whole: records of a common one are counted
    in parts of about ``RANKED`` by hash, and only the part where the used ones end is ranked.
    """
    sized = written(measured(documents, path), "sized")
    plan = fitted(sized, targets, seed)
    spark = documents.sparkSession
    passes = spark.createDataFrame([(p.source, p.whole) for p in plan], "source STRING, whole INT")
    extra = spark.createDataFrame([(p.source, n, k, -(-p.counts[n] // RANKED)) for p in plan for n, k in p.extra.items()], "source STRING, n_tokens INT, extra BIGINT, parts BIGINT")
    rows = sized.join(F.broadcast(passes), "source").join(F.broadcast(extra), ["source", "n_tokens"], "left")  # one row per source, and per source and length
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("part", F.when(F.col("extra").isNotNull(), F.pmod("h", "parts")))
    by = ["source", "n_tokens", "part"]
    counts = rows.filter("part IS NOT NULL").groupBy(*by).agg(F.count("*").alias("own"))
    upto = Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(counts.withColumn("upto", F.sum("own").over(upto)), by, "left")
    border = (F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("own") < F.col("extra"))
    used = ["doc_id", "source", "n_tokens"]
    clear = placed.filter(~F.coalesce(border, F.lit(False))).select(*used, (F.col("whole") + F.coalesce((F.col("upto") <= F.col("extra")).cast("int"), F.lit(0))).alias("repeats"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    last = placed.filter(border).select(*used, "whole", (place <= F.col("extra") - F.col("upto") + F.col("own")).cast("int").alias("more")).select(*used, (F.col("whole") + F.col("more")).alias("repeats"))
    return clear.unionByName(last).withColumn("repeats", F.col("repeats").cast("int")).filter("repeats > 0")


def reached_shares(documents: DataFrame, targets: DataFrame, seed: int = SEED, path: str | None = None) -> DataFrame:
    """source, target_share, tokens, share, most_repeats: what each source contributes to the mix."""
    mix = mixed_documents(documents, targets, seed, path).groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    all_ = clean_targets(targets).select("source", "target_share").join(mix, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1))  # one row per target source
    return all_.select("source", "target_share", "tokens", share.alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
