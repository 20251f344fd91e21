"""Exact search: one query against a table of features (image_id, vector)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import distances as D


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError(f"k must be a positive whole number, not {k!r}")
    return k


def canonical_ids(features: DataFrame) -> DataFrame:
    """The ids, which must not repeat."""
    assert_unique(features, "image_id")
    return features.select("image_id")


def duplicate_ids(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(rows: DataFrame, *keys: str) -> None:
    worst = duplicate_ids(rows, *keys).first()
    if worst:
        raise ValueError(f"{', '.join(keys)} repeats: {worst.asDict()}")


def distance_to(vector: Column, query: Sequence[float], metric: str | D.Distance = "cosine") -> Column:
    """The distance of a vector column from a literal query; what is not finite is +infinity.

    A vector of another length than the query's stops the job.
    """
    values = D.check_query(query, nonzero=metric in ("cosine", "angular"))
    d = D.folded(D.metric(metric)(D.vector(values), D.doubles(vector)))
    wrong = F.raise_error(F.format_string("image %s has %d values, the query %d", F.col("image_id").cast("string"), F.size(vector), F.lit(len(values))))
    return F.when(F.size(vector) == len(values), d).otherwise(wrong.cast("double"))


def all_distances(features: DataFrame, query: Sequence[float], metric: str | D.Distance = "cosine") -> DataFrame:
    """image_id, distance of every row: a projection of one scan."""
    return features.select("image_id", distance_to(F.col("vector"), query, metric).alias("distance"))


def ranked(rows: DataFrame, value: str, by: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """rank (from 1, by value, then image_id) within `by`; the first k only, if k is given."""
    w = Window.partitionBy(*by).orderBy(value, "image_id")
    out = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if k is None else out.filter(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int, value: str = "distance", on_short: str = "clamp") -> DataFrame:
    """rank, image_id and the value of the k least, ties by id; fewer are an error or, with "clamp", all.

    Each partition keeps k rows, so k rows of each meet in the end.
    """
    check_k(k)
    best = scored.orderBy(value, "image_id").limit(k)
    if on_short == "error":
        n = best.count()
        if n < k:
            raise ValueError(f"only {n} of {k} results are there")
    elif on_short != "clamp":
        raise ValueError("on_short is error or clamp")
    return best.select(F.row_number().over(Window.orderBy(value, "image_id")).cast("long").alias("rank"), "image_id", value)


def search(features: DataFrame, query: Sequence[float], k: int, metric: str | D.Distance = "cosine", on_short: str = "error") -> DataFrame:
    """The k nearest rows whose distance is finite."""
    check_k(k)
    return top_k(all_distances(features, query, metric).filter(D.is_finite(F.col("distance"))), k, on_short=on_short)


def clamp_k(k: int, n: int) -> int:
    check_k(k)
    if k > n:
        warnings.warn(f"k = {k} is more than the {n} rows there are", stacklevel=2)
    return min(k, n)


def nonzero(features: DataFrame) -> DataFrame:
    """Without zero vectors, which no angle orders."""
    return features.filter(F.aggregate(D.doubles(F.col("vector")), F.lit(0.0), lambda s, x: s + x * x) > 0)


def vector_stats(features: DataFrame) -> DataFrame:
    """Counts of rows, of zero vectors and of vectors with values that are not finite, least and greatest size."""
    v = D.doubles(F.col("vector"))
    odd = F.exists(v, lambda x: ~D.is_finite(x))
    return features.agg(F.count(F.lit(1)).alias("n"), F.count_if(D.norm(v) == 0).alias("n_zero"), F.count_if(odd).alias("n_invalid"), F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"))


def distances_to(features: DataFrame, queries: DataFrame, metric: str | D.Distance) -> DataFrame:
    """query_id, image_id, distance of every pair; queries (query_id, vector) are few: see `check_queries`."""
    d = D.folded(D.metric(metric)(F.col("_q"), D.doubles(F.col("vector"))))
    few = queries.select("query_id", D.doubles(F.col("vector")).alias("_q"))
    return features.crossJoin(F.broadcast(few)).select("query_id", "image_id", d.alias("distance"))


MAX_QUERIES = 10_000


def check_queries(queries: DataFrame) -> DataFrame:
    """Query tables are broadcast, so their size is checked; larger ones go through `knn`."""
    n = queries.limit(MAX_QUERIES + 1).count()
    if n > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; use nearfield.operators.knn")
    return queries


def custom(distance: D.Distance) -> D.Distance:
    """A distance of the user's own, whose result must be a column."""

    def call(a: Column, b: Column) -> Column:
        out = distance(a, b)
        if not isinstance(out, Column):
            raise ValueError("a distance function takes two columns and returns one")
        return out

    return call
