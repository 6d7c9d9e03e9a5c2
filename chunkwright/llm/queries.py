"""Queries of the training-data operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .docpairs import function_docs
from .mixing import mixed_documents, reached_shares, short_sources
from .near import near_groups, near_links, near_pairs
from .origin import file_origins, not_handwritten
from .secrets import redacted, secret_lines
from .spans import shared_share, span_pairs
from .splitting import oversized, split_texts
from .subjects import corpus_composition, subjects_found
from .tokens import encoded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the function below as query ``name``, and ``sql`` as its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(table(spark, folder, "chunks"), "chunk_id", "file_id", "text")


@query("p2_groups")
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "chunks"), "chunk_id", "text")


@query("p2_links")
def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_links(table(spark, folder, "chunks"), "chunk_id", "text")


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return span_pairs(table(spark, folder, "chunks"), "chunk_id", "file_id", "text")


@query("p5_shared")
def p5_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_share(table(spark, folder, "chunks"), "chunk_id", "file_id", "text")


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return secret_lines(table(spark, folder, "source_files"))


@query("p4_redacted")
def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(table(spark, folder, "source_files"), table(spark, folder, "chunks"), "chunk_id", "text")


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(table(spark, folder, "source_files"))


@query("p6_origins")
def p6_origins(spark: SparkSession, folder: str) -> DataFrame:
    return file_origins(table(spark, folder, "source_files"))


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return function_docs(table(spark, folder, "source_files")).select("file_id", "name", "line").distinct()


@query("p3_pairs")
def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return function_docs(table(spark, folder, "source_files"))


@query(
    "p7_found",
    """
    SELECT c.chunk_id FROM chunks c LEFT JOIN chunk_limits l ON lower(trim(c.language)) = l.language CROSS JOIN (SELECT max_chars FROM chunk_limits WHERE language = 'default') d
    WHERE length(c.text) > coalesce(l.max_chars, d.max_chars)
    """,
)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized(table(spark, folder, "chunks"), table(spark, folder, "chunk_limits"))


@query("p7_pieces")
def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "chunks"), table(spark, folder, "chunk_limits"))


@query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"), "doc_id", "text")


@query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return short_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query("p9_mix")
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_documents(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return reached_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects_found(table(spark, folder, "documents"), table(spark, folder, "subject_areas"), table(spark, folder, "subject_labels"))


@query("p10_composition")
def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_composition(table(spark, folder, "documents"), table(spark, folder, "subject_areas"), table(spark, folder, "subject_labels"))
