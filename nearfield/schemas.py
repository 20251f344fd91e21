"""Explicit schemas of every table that the engine keeps."""

from __future__ import annotations

from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("image_id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("ext", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("added_at", T.TimestampType()),
])

FEATURES = T.StructType([
    T.StructField("image_id", T.LongType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
    T.StructField("feature_type", T.StringType()),
    T.StructField("shard_id", T.IntegerType()),
])

MANIFEST = T.StructType([
    T.StructField("feature_type", T.StringType(), False),
    T.StructField("shard_id", T.IntegerType(), False),
    T.StructField("feature_dim", T.IntegerType(), False),
    T.StructField("feature_dtype", T.StringType(), False),
    T.StructField("shard_size", T.LongType(), False),
    T.StructField("created_at", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
])

DISTANCES = "query_id long, feature string, image_id long, distance double"
SCORES = "query_id long, rank long, image_id long, score double"
PILOT = "position long, image_id long"
COMPARISON = "query_id long, k_candidates int, exact_ms double, approx_ms double, overlap double, self_rank_exact long, self_rank_approx long"
COORDINATES = "image_id long, x double, y double, z double"
PROFILE = "file string, function string, label string, ncalls long, tottime double, cumtime double"
