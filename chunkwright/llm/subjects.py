"""Subject areas of documents by latent semantic analysis with seed centroids that are refined iteratively.

1. Texts are cut into units (sentences, lines of lists, comments and code) and these into words; names in code count by their
   parts. The table of units holds word hashes only and is written once.
2. Words are weighted by inverse document frequency over all documents times relevance, the divergence of the
   subjects of the documents that hold a word from the usual ones. Words of every subject alike weigh nothing. Each task sums
   the subjects of its words before anything is exchanged.
3. Documents are embedded by truncated singular value decomposition of the weighted matrix, by subspace iteration: each
   step is one distributed pass that sums a small matrix.
4. Centroids are seeded by labelled documents, one for each subject and language, and refined: all documents are assigned
   by cosine similarity, and centroids become the means of what was assigned. Then weights are learned again from all
   assigned documents, and steps 2 to 4 are repeated.
5. A unit speaks of each area whose centroid is near enough; a document is about the areas of at least ``SHARE`` of its units.

Labels are a bounded sample: at most ``LABELS`` documents, the least in a hash of the key. All else covers all documents. Words
count from a share ``FLOOR`` of the documents that teach, so at most ``1 / FLOOR`` times the mean number of distinct words of a
document can be relevant, however many documents there are: what reaches the driver and is broadcast (words x ``RANK`` floats) doesn't grow
with the corpus.

Defined results: null, empty and blank texts, and texts without words, are about nothing; conflicting labels of one
document count in parts; labels of unknown subjects are ignored; repeated rows of a document count once in the result; with
no labels or no documents there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

LABELS = 200_000
RANK = 96
PASSES = 4
REFINEMENTS = 3
ROUNDS = 2
#: A unit speaks of an area from this cosine on, if no other area is more than twice as near; a document is assigned to
#: the nearest area from the second on while centroids are refined. One word of an area has one of its many directions,
#: so its cosine to the centroid is about one by the root of the area's number of words; other areas' are near 0.
NEAR_UNIT, NEAR_DOCUMENT, RIVAL = 0.15, 0.4, 0.5
#: A third, less what headings and cut sentences take away from a document's own count of sentences.
SHARE = 0.26
#: Words count from this many documents and this share of one subject on, and if their divergence from the prior is
#: beyond chance (twice the documents times the divergence, as in a likelihood-ratio test).
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_RATIO = 3, 0.4, 14.0
FLOOR = 5e-5
SLICE = 256
#: Words whose sums a task holds before it gives them out.
HELD_WORDS = 1_000_000

_unit = re.compile(r"[.!?;{}]\s+|\n+")
_run = re.compile(r"[^\W\d_]+")
_hump = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")


class WordHashes(dict):
    """Runs of letters with the hashes of their lower-case words, each worked out once: names in code give their parts."""

    def __missing__(self, run: str) -> tuple[int, ...]:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        words = () if len(run) < 2 else (run.lower(),) if run.islower() or run.isupper() or run[1:].islower() else tuple(p.lower() for p in _hump.sub(" ", run).split())
        found = self[run] = tuple(xxhash.xxh64_intdigest(w) - (1 << 63) for w in words)
        return found


def unit_hashes(text: str, known: WordHashes) -> list[set[int]]:
    """The distinct words, as hashes, of each unit of ``text`` that has any."""
    each = (set(chain.from_iterable(map(known.__getitem__, _run.findall(u)))) for u in _unit.split(text))
    return [u for u in each if u]


def units_of(documents: DataFrame) -> DataFrame:
    """doc_id, lang, units ARRAY<INT> (words in each unit), words ARRAY<BIGINT>: the hashed words of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            own = [unit_hashes(t, known) if t else [] for t in b.column("text").to_pylist()]
            per_doc = np.cumsum([0, *map(len, own)]).astype(np.int32)
            sizes = np.array([len(u) for units in own for u in units], dtype=np.int32)
            at = np.r_[0, np.cumsum(sizes)][per_doc].astype(np.int32)
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(own)), dtype=np.int64, count=int(at[-1]))
            lists = [pa.ListArray.from_arrays(per_doc, pa.array(sizes)), pa.ListArray.from_arrays(at, pa.array(flat))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *lists], ["doc_id", "lang", "units", "words"])

    rows = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.substring(F.lower(F.trim("lang")), 1, 2).alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id BIGINT, lang STRING, units ARRAY<INT>, words ARRAY<BIGINT>")


def label_shares(labels: DataFrame, areas: list[str], most: int) -> DataFrame:
    """doc_id, shares ARRAY<DOUBLE>: the part of each area (and of none, at the end) among a document's labels."""
    known = labels.filter("doc_id IS NOT NULL").filter(F.col("subject").isNull() | F.col("subject").isin(areas)).select(F.col("doc_id").cast("bigint"), "subject").distinct()
    n = known.groupBy("doc_id").agg(F.collect_set(F.coalesce("subject", F.lit(""))).alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # A null beside an area says that some annotator saw none; it halves the weight of the area.
    return n.select("doc_id", F.array(*[F.array_contains("s", a).cast("double") / F.size("s") for a in [*areas, ""]]).alias("shares"))


def _word_sums(flat: pa.Array, doc: np.ndarray, shares: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and of each the documents that hold it, those of them that are taught, and the sums of their shares."""
    coded = flat.dictionary_encode()  # by hashing; what is sorted then are small numbers
    n = len(shares)
    pair = np.unique(coded.indices.to_numpy().astype(np.int64) * n + doc)
    w, d = pair // n, pair % n
    begin = np.nonzero(np.r_[True, w[1:] != w[:-1]])[0] if len(w) else np.zeros(0, dtype=np.int64)
    facts = np.concatenate([np.ones((n, 1)), taught[:, None], shares], axis=1)
    return coded.dictionary.to_numpy()[w[begin]], (np.add.reduceat(facts[d], begin) if len(w) else np.zeros((0, shares.shape[1] + 2)))


def word_sums(units: DataFrame, areas: int, shares_of) -> DataFrame:
    """w, df, n, s0, s1, ...: of each word the documents that hold it, how many of them teach, and the sums of their shares of the areas.

    The row without a word is that of all documents. ``shares_of`` gives the matrix of shares (a row of nan where a document
    doesn't teach) of a batch of ``units``, once it is called without arguments in the task.
    """
    names = ["df", "n", *(f"s{i}" for i in range(areas + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shares_of()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total, rows = np.zeros(areas + 3), 0

        def out() -> pa.RecordBatch:
            w, facts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            by = np.argsort(w, kind="stable")
            begin = np.nonzero(np.r_[True, w[by][1:] != w[by][:-1]])[0] if len(w) else np.zeros(0, dtype=np.int64)
            facts = np.add.reduceat(facts[by], begin) if len(w) else facts
            return pa.RecordBatch.from_arrays([pa.array(w[by][begin]), *(pa.array(np.ascontiguousarray(facts[:, i])) for i in range(areas + 3))], ["w", *names])

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                shares = read(b)
                taught = ~np.isnan(shares[:, 0])
                shares = np.nan_to_num(shares)
                n = np.diff(b.column("words").offsets.to_numpy())
                held.append(_word_sums(b.column("words").flatten(), np.repeat(np.arange(b.num_rows), n), shares, taught))
                total += np.r_[b.num_rows, taught.sum(), shares.sum(axis=0)]
                rows += len(held[-1][0])
                if rows > HELD_WORDS:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([float(x)]) for x in total)], ["w", *names])

    sums = units.mapInArrow(run, "w BIGINT, " + ", ".join(f"{x} DOUBLE" for x in names))
    return sums.groupBy("w").agg(*[F.sum(x).alias(x) for x in names])


def relevant_words(sums: DataFrame, areas: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(words, their document frequency, their sums of shares, the prior shares, the number of documents) of words that may be relevant."""
    sums = written(sums, "words")
    whole = sums.filter("w IS NULL").first()
    all_ = np.array([whole[f"s{i}"] for i in range(areas + 1)])
    least = max(LEAST_DOCUMENTS, FLOOR * whole["n"])
    rows = sums.filter(F.col("w").isNotNull() & (F.col("n") >= least) & (F.greatest(*[F.col(f"s{i}") for i in range(areas)]) >= LEAST_SHARE * F.col("n"))).orderBy("w").toPandas()  # bounded by FLOOR
    prior = np.maximum(all_ / max(1.0, whole["n"]), 1e-3)
    return rows["w"].to_numpy(np.int64), rows["df"].to_numpy(float), rows[[f"s{i}" for i in range(areas + 1)]].to_numpy(float).reshape(len(rows), areas + 1), prior / prior.sum(), int(whole["df"])


def weights_of(df: np.ndarray, shares: np.ndarray, documents: int, prior: np.ndarray) -> np.ndarray:
    """Inverse document frequency times relevance, the divergence of a word's subjects from the prior."""
    n = shares.sum(axis=1, keepdims=True)
    p = (shares + 2 * prior) / (n + 2)
    relevance = np.maximum((p * np.log(p / prior)).sum(axis=1), 0)
    return np.log((1 + documents) / (0.5 + df)) * relevance * (2 * n[:, 0] * relevance >= LEAST_RATIO)


def summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that tasks give in slices of rows (slice INT, part BINARY); its size is that of one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(part)
                total[i] = total[i] + own if i in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["slice", "part"])

    out = np.zeros(shape)
    for r in rows.repartition(max(1, min(32, -(-shape[0] // SLICE))), "slice").mapInArrow(add, "slice INT, part BINARY").collect():
        part = np.frombuffer(r["part"]).reshape(-1, shape[1])
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return out


def _slices(m: np.ndarray) -> pa.RecordBatch:
    at = range(0, len(m), SLICE)
    return pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in at], pa.int32()), pa.array([np.ascontiguousarray(m[i : i + SLICE]).tobytes() for i in at], pa.binary())], ["slice", "part"])


def _places(b: pa.RecordBatch, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, unit, place among ``vocabulary``) of each known word of a batch of units, and the number of units of each document."""
    sizes, per_doc = b.column("units").flatten().to_numpy(), np.diff(b.column("units").offsets.to_numpy())
    coded = b.column("words").flatten().dictionary_encode()
    words = coded.dictionary.to_numpy()
    # Each distinct word is looked up once.
    known = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = np.where(vocabulary[known] == words, known, -1)
    place = known[coded.indices.to_numpy()]
    hit = np.nonzero(place >= 0)[0]
    # Units are numbered within their document.
    first = np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    unit = np.repeat(np.arange(len(sizes)), sizes)[hit]
    doc = np.repeat(np.arange(b.num_rows), per_doc)
    return doc[unit], unit - first[unit], place[hit], per_doc


def known_words(units: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, lang, n_units, unit ARRAY<INT>, at ARRAY<INT>: places among ``words`` of the relevant words of each unit."""
    held = units.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for b in batches:
            doc, unit, place, per_doc = _places(b, vocabulary)
            at = np.zeros(b.num_rows + 1, dtype=np.int32)
            np.cumsum(np.bincount(doc, minlength=b.num_rows), out=at[1:])
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (unit, place)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(per_doc.astype(np.int32)), *lists], ["doc_id", "lang", "n_units", "unit", "at"])

    return units.select("doc_id", "lang", "units", "words").mapInArrow(run, "doc_id BIGINT, lang STRING, n_units INT, unit ARRAY<INT>, at ARRAY<INT>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, unit, place) of each word of a batch of known words."""
    n = np.diff(b.column("at").offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), n), b.column("unit").flatten().to_numpy(), b.column("at").flatten().to_numpy()


def _rows_sum(rows: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by the ascending group numbers ``by``."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    if len(by):
        begin = np.nonzero(np.r_[True, by[1:] != by[:-1]])[0]
        out[by[begin]] = np.add.reduceat(rows, begin)
    return out


def unit_length(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def truncated_svd(known: DataFrame, weights: np.ndarray, rank: int, passes: int) -> np.ndarray:
    """The leading right singular vectors of the weighted, length-normed document matrix, one row per word."""
    rank = min(rank, len(weights))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(weights), rank)))[0]
    sc = known.sparkSession.sparkContext
    for _ in range(passes):
        held = sc.broadcast((q.astype(np.float32), weights))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, w = held.value
            out = np.zeros(q.shape)
            for batch in batches:
                for k in range(0, batch.num_rows, 2000):
                    b = batch.slice(k, 2000)
                    doc, _, at = _flat(b)
                    if not len(at):
                        continue
                    # Only the words met take part; the block of the matrix over them is dense.
                    met, place = np.unique(at, return_inverse=True)
                    m = np.bincount(doc * len(met) + place, w[at], b.num_rows * len(met)).reshape(b.num_rows, len(met)).astype(np.float32)
                    size = np.sqrt(np.bincount(doc, w[at] ** 2, b.num_rows))
                    m /= np.maximum(size, 1e-12)[:, None].astype(np.float32)
                    out[met] += m.T @ (m @ q[met])
            yield _slices(out)

        q = np.linalg.qr(summed(known.mapInArrow(run, "slice INT, part BINARY"), q.shape))[0]
    return q


def embedded(b: pa.RecordBatch, places: np.ndarray) -> np.ndarray:
    """Embeddings of unit length of the documents of a batch from the ``places`` of words; documents without known words have zeros."""
    doc, _, at = _flat(b)
    return unit_length(_rows_sum(places[at], doc, b.num_rows))


def centroid_sums(known: DataFrame, places: np.ndarray, groups: list[tuple[int, str]], centroids: np.ndarray | None) -> np.ndarray:
    """Sums of embeddings by group; from labelled documents (with shares) if there are no centroids yet."""
    held = known.sparkSession.sparkContext.broadcast((places, groups, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, groups, centroids = held.value
        out = np.zeros((len(groups), places.shape[1]))
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                v = embedded(b, places)
                if centroids is None:
                    lang = np.array([x or "" for x in b.column("lang").to_pylist()])
                    shares = np.array(b.column("shares").to_pylist(), dtype=float).reshape(b.num_rows, -1)
                    for g, (area, code) in enumerate(groups):
                        # The weight falls off with doubt: a label beside others counts by its square.
                        out[g] += (shares[:, area] ** 2 * (lang == code)) @ v
                else:
                    near = v @ centroids.T
                    best = near.argmax(axis=1)
                    sure = np.nonzero(near[np.arange(len(v)), best] >= NEAR_DOCUMENT)[0]
                    by = sure[np.argsort(best[sure], kind="stable")]
                    out += _rows_sum(v[by], best[by], len(out))
        yield _slices(out)

    return summed(known.mapInArrow(run, "slice INT, part BINARY"), (len(groups), places.shape[1]))


def _counts(n: int, doc: np.ndarray, unit: np.ndarray, at: np.ndarray, places: np.ndarray, of: np.ndarray, centroids: np.ndarray, areas: int) -> np.ndarray:
    """How many units of each of ``n`` documents speak of each area."""
    counts = np.zeros((n, areas), dtype=np.int32)
    if len(at):
        edge = np.r_[True, (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1])]
        number = np.cumsum(edge) - 1
        near = unit_length(_rows_sum(places[at], number, number[-1] + 1)) @ centroids.T
        least = np.maximum(NEAR_UNIT, RIVAL * near.max(axis=1))
        for a in np.unique(of):
            counts[:, a] = np.bincount(doc[edge], near[:, of == a].max(axis=1) >= least, n)
    return counts


def area_counts(known: DataFrame, places: np.ndarray, groups: list[tuple[int, str]], centroids: np.ndarray, areas: int) -> DataFrame:
    """doc_id, n_units, counts ARRAY<INT>: how many units of each document speak of each area."""
    held = known.sparkSession.sparkContext.broadcast((places, np.array([g[0] for g in groups]), centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, of, centroids = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                counts = _counts(b.num_rows, *_flat(b), places, of, centroids, areas)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_units"), pa.array(list(counts), pa.list_(pa.int32()))], ["doc_id", "n_units", "counts"])

    return known.select("doc_id", "lang", "n_units", "unit", "at").mapInArrow(run, "doc_id BIGINT, n_units INT, counts ARRAY<INT>")


def labelled(areas: int):
    """The shares of a batch of units with labels in the column ``shares``."""

    def read(b: pa.RecordBatch) -> np.ndarray:
        own = b.column("shares").to_pylist()
        return np.array([s if s is not None else [np.nan] * (areas + 1) for s in own], dtype=float).reshape(b.num_rows, areas + 1)

    return lambda: read


def assigned(held, areas: int, share: float):
    """The shares of a batch of units by what the centroids in the broadcast ``held`` assign: of each document equal parts of its areas."""

    def task():
        words, places, of, centroids = held.value

        def read(b: pa.RecordBatch) -> np.ndarray:
            doc, unit, at, per_doc = _places(b, words)
            counts = _counts(b.num_rows, doc, unit, at, places, of, centroids, areas)
            about = (counts > 0) & (counts >= share * per_doc[:, None])
            n = about.sum(axis=1, keepdims=True)
            return np.concatenate([about / np.maximum(n, 1), n == 0], axis=1)

        return read

    return task


def document_areas(documents: DataFrame, areas: DataFrame, labels: DataFrame, most_labels: int = LABELS, share: float = SHARE) -> DataFrame:
    """doc_id, n_units, counts, about ARRAY<STRING>: the areas each document is about, in the order of their names."""
    names = [r[0] for r in areas.filter("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]  # one column of the result each
    spark = documents.sparkSession
    nothing = "doc_id BIGINT, n_units INT, counts ARRAY<INT>, about ARRAY<STRING>"
    units = written(units_of(documents), "units")
    shares = written(label_shares(labels, names, most_labels), "labels")
    if not names or not units.limit(1).count() or not shares.limit(1).count():
        return spark.createDataFrame([], nothing)
    about = F.filter(F.array(*[F.when((F.col("counts")[i] > 0) & (F.col("counts")[i] >= share * F.col("n_units")), F.lit(a)) for i, a in enumerate(names)]), lambda x: x.isNotNull())
    sums, out = word_sums(units.join(shares, "doc_id", "left").select("words", "shares"), len(names), labelled(len(names))), None
    for turn in range(ROUNDS):
        words, df, by_area, prior, n = relevant_words(sums, len(names))
        weights = weights_of(df, by_area, n, prior)
        words, weights = words[weights > 0], weights[weights > 0]
        if not len(words):
            return spark.createDataFrame([], nothing)
        known = written(known_words(units, words), "known")
        # Where each word lies: its row of the basis times its weight.
        places = (weights[:, None] * truncated_svd(known, weights, RANK, PASSES)).astype(np.float32)
        taught = written(known.join(shares, "doc_id"), "taught")
        langs = [r[0] for r in taught.groupBy("lang").count().filter("lang IS NOT NULL").orderBy(F.desc("count"), "lang").collect()]  # of labelled documents, two letters each
        groups = [(a, code) for a in range(len(names)) for code in langs]
        centroids = centroid_sums(taught, places, groups, None)
        some = np.linalg.norm(centroids, axis=1) > 0.2
        groups, centroids = [g for g, ok in zip(groups, some, strict=True) if ok], unit_length(centroids[some])
        if not groups:
            return spark.createDataFrame([], nothing)
        for _ in range(REFINEMENTS):
            total = centroid_sums(known, places, groups, centroids.astype(np.float32))
            # A centroid keeps half of its seed's direction, so that none wanders off to another area.
            moved = np.linalg.norm(total, axis=1) > 0
            centroids[moved] = unit_length(centroids[moved] + unit_length(total[moved]))
        if turn + 1 < ROUNDS:  # what is assigned teaches the next round, over all documents
            held = spark.sparkContext.broadcast((words, places, np.array([g[0] for g in groups]), centroids.astype(np.float32)))
            sums = word_sums(units, len(names), assigned(held, len(names), share))
        else:
            out = written(area_counts(known, places, groups, centroids.astype(np.float32), len(names)).withColumn("about", about), "areas")
    return out


def subjects_found(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, subject: one row for each area a document is about."""
    return document_areas(documents, areas, labels).select("doc_id", F.explode("about").alias("subject")).distinct()


def corpus_composition(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """subject, documents, share: how many documents are about each area, or about none (null)."""
    found = document_areas(documents, areas, labels).dropDuplicates(["doc_id"])
    by = found.select("doc_id", F.explode_outer(F.when(F.size("about") > 0, F.col("about"))).alias("subject")).groupBy("subject").agg(F.count("*").alias("documents"))
    return by.crossJoin(F.broadcast(found.agg(F.count("*").alias("n")))).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))
