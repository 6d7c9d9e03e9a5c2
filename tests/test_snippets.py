"""Similar snippets against brute force, the cutting of runs, and the volume of their joins."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chunkwright.functions import runs as R
from chunkwright.operators import packing as P


def cut(text, n):
    w = re.findall("[a-z0-9_]+", text.replace("İ", "i").replace("K", "k").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(chunks, snippets, threshold, n):
    d, q = ({k: s for k, t in rows if t is not None and (s := cut(t, n))} for rows in (chunks, snippets))
    links = ((a, b, len(x & y), len(x | y)) for a, x in q.items() for b, y in d.items())
    return sorted((a, b, round(k / u, 6)) for a, b, k, u in links if k and k / u >= threshold)


def similar(spark, chunks, snippets, *how):
    rows = P.similar_snippets(spark.createDataFrame(chunks, "chunk_id BIGINT, text STRING"), spark.createDataFrame(snippets, "qid BIGINT, snippet STRING"), *how)
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("threshold, n", [(0.0, 3), (0.1, 1), (0.3, 3), (0.5, 2), (0.7, 3), (1.0, 3)])
def test_similar_snippets(spark, threshold, n):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))] for _ in range(30)]
    texts = [" ".join(w if rng.random() > 0.15 else rng.choice("xyz") for w in rng.choice(base)) for _ in range(150)]
    odd = [None, "", "one two", "one two three", "ONE\ntwo--three", "İx Kelvin é_1 ß", "ix kelvin _1", "a a a a a a"]
    chunks = list(enumerate(texts + odd + odd))
    snippets = [(1000 + i, t) for i, t in enumerate([*texts[:20], *odd, "no chunk has this one"])]
    assert similar(spark, chunks, snippets, threshold, n) == brute(chunks, snippets, threshold, n)


def test_similar_snippets_of_none(spark):
    assert similar(spark, [], [(1, "a b c")], 0.3) == similar(spark, [(1, "a b c")], [], 0.3) == []


def test_runs_end_with_their_text(monkeypatch):
    monkeypatch.setattr(R, "SLAB", 64)
    texts = ["a b c", "d e f g", "", None, "x" * 200 + " y z " + "x" * 200 + " y z", "A_1 b-C é a_1 B c", "b", "c d"] * 5
    counts, h = R.distinct_runs(pa.array(["skipped a b", *texts]).slice(1), 2)
    assert counts.tolist() == [len(cut(t or "", 2)) for t in texts]
    by, at = {}, 0
    for t, c in zip(texts, counts, strict=True):
        by.setdefault(frozenset(cut(t or "", 2)), set()).add(tuple(h[at : at + c]))
        at += c
    assert all(len(x) == 1 for x in by.values())
    names = {run: v for runs, (hashes,) in by.items() if len(runs) == 1 for run, v in zip(runs, hashes, strict=True)}
    assert len(set(names.values())) == len(names) and len(np.unique(h)) == len(set().union(*by))


def test_filter_misses_none():
    h = np.random.default_rng(3).integers(0, 1 << 63, 120_000).astype(np.uint64) * np.uint64(2)
    for bits in (R.filter_bits(0), R.filter_bits(60_000), R.filter_bits(200_000)):
        cells = np.zeros(1 << bits - 3, dtype=np.uint8)
        R.put(cells, h[:60_000], bits)
        assert R.may_hold(cells, h[:60_000], bits).all()
        assert R.may_hold(cells, h[60_000:], bits).mean() < (0.05 if bits > 19 else 0.1)
    assert R.filter_bits(10**12) == 28


def most_rows(plan):
    """The most rows that any node of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return most_rows(plan.plan())
    own, children = plan.metrics().get("numOutputRows"), plan.children()
    return max([own.get().value() if own.isDefined() else 0, *(most_rows(children.apply(i)) for i in range(children.size()))])


def test_common_runs_are_not_joined(spark):
    """A header that all texts share, but which makes none similar: joined on it, 600 texts have 600 * 600 * 18 rows."""
    header = " ".join(f"h{i}" for i in range(20))
    rows = [(i, header + "".join(f" w{i}_{j}" for j in range(60))) for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id BIGINT, text STRING")
    found = P.similar_snippets(chunks, chunks.toDF("qid", "snippet"), 0.3)
    assert sorted(map(tuple, found.collect())) == [(i, i, 1.0) for i in range(600)]
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 600 * 78 * 4


def test_nothing_exploded_is_broadcast(spark, folder):
    """By their size in the files all runs of all chunks seem to be few enough to be built into one broadcast by the driver."""
    from chunkwright.plans.core_queries import QUERIES

    found = QUERIES["q22_similar_patterns"](spark, folder)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
