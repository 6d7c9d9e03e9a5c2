"""Deterministic text embeddings by hashed term frequencies, encoded once per distinct text.

Null texts have no embedding; texts without terms have the zero vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

DIM = 64


def embedded(docs: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """key, embedding ARRAY<FLOAT> of unit length: signed counts of the terms, placed among ``dim`` by the first 8 digits of their MD5, signed by the ninth.

    Equal texts are encoded once: only hashes are exchanged, one text of each is encoded, and keys are joined back.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.md5(F.col(text)).alias("h"), F.col(text).alias("t"))
    keep = rows.groupBy("h").agg(F.min("k").alias("k"))
    one = rows.join(keep, ["h", "k"], "left_semi").select("h", tokens(F.col("t")).alias("w")).dropDuplicates(["h"])
    terms = one.select("h", F.explode_outer("w").alias("w")).withColumn("m", F.md5("w"))
    terms = terms.select("h", F.coalesce(F.conv(F.substring("m", 1, 8), 16, 10).cast("bigint") % dim, F.lit(0)).cast("int").alias("at"), F.when(F.col("w").isNull(), 0).when(F.substring("m", 9, 1) < "8", 1).otherwise(-1).alias("s"))
    places = terms.groupBy("h", "at").agg(F.sum("s").alias("s")).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("at", "s"))).alias("m"))  # at most ``dim`` places each
    size = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda n, x: n + x * x).cast("double"))
    places = places.filter("h IS NOT NULL").withColumn("size", F.when(size > 0, size).otherwise(1.0))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("size")).cast("float"))
    return rows.select("k", "h").join(places.select("h", vector.alias("embedding")), "h").select(F.col("k").alias(key), "embedding")


def encoding_stats(docs: DataFrame, text: str) -> DataFrame:
    """texts, encoded, hits, rate: how many texts there are, how many have to be encoded, and how many a cache of encoded texts serves."""
    by = docs.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count("*").alias("encoded"))
    return by.select("texts", "encoded", (F.col("texts") - F.col("encoded")).alias("hits"), F.round((F.col("texts") - F.col("encoded")) / F.greatest(F.col("texts"), F.lit(1)), 6).alias("rate"))
