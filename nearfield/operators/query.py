"""Queries over several features: from images or vectors to ranked results.

A feature store here is a dict from feature name to a table (image_id,
vector), or `Wide`, where the features are columns of one table; a query is a
dict from feature name to a vector. All queries' distances are columns of one
row for each image, so a table is read once for them, and the rows of separate
tables meet in joins of ids and distances, never of vectors.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.functions import images as I
from nearfield.operators import fusion, search
from nearfield.sources import images

K_CANDIDATES = 10_000
Store = dict[str, DataFrame]
Query = dict[str, Sequence[float]]


class Wide(dict):
    """A store whose features are columns of one table: image_id and a vector column for each name."""

    def __init__(self, frame: DataFrame, features: Sequence[str]):
        super().__init__({n: frame.select("image_id", F.col(n).alias("vector")) for n in features})
        self.frame = frame


def select_features(available: Sequence[str], wanted: Sequence[str] | None = None, query: Query | None = None) -> list[str]:
    """Wanted features that the store, and the query, have; unknown ones are warned about."""
    names = sorted(available)
    if wanted is not None:
        for name in wanted:
            if name not in D.FEATURE_METRICS and name not in available:
                warnings.warn(f"unknown feature {name!r}", stacklevel=2)
        names = [n for n in names if n in wanted]
    if query is not None:
        names = [n for n in names if n in query]
    if not names:
        raise ValueError("no feature is left to compare")
    return names


def require_features(used: Sequence[str], wanted: Sequence[str]) -> None:
    if set(used) != set(wanted):
        raise ValueError(f"asked for {sorted(wanted)}, compared {sorted(used)}")


def _metric(name: str, metrics: dict | None) -> str | D.Distance:
    return (metrics or {}).get(name) or D.FEATURE_METRICS.get(name, "euclidean")


def feature_distances(store: Store, query: Query, features: Sequence[str] | None = None, *, query_id: int = 0, metrics: dict | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(query_id, feature, image_id, distance) for all rows, or for those of ids.

    A feature whose query vector is invalid is left out with a warning, as
    long as another one is left. With ids (candidates), only ids that every
    feature has are compared.
    """
    parts = []
    shared = None if ids is None else common_ids(store, select_features(list(store), features, query), ids)
    for name in select_features(list(store), features, query):
        table = store[name] if shared is None else store[name].join(shared, "image_id", "left_semi")
        try:
            d = search.all_distances(table, query[name], _metric(name, metrics))
        except ValueError as e:
            if ids is not None:
                raise
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
            continue
        parts.append(d.select(F.lit(query_id).cast("long").alias("query_id"), F.lit(name).alias("feature"), "image_id", "distance"))
    if not parts:
        raise ValueError("no feature could be compared")
    return reduce(DataFrame.unionByName, parts)


def common_ids(store: Store, features: Sequence[str], ids: DataFrame) -> DataFrame:
    """Candidate ids that every feature has."""
    return reduce(lambda left, name: left.join(store[name].select("image_id"), "image_id", "left_semi"), features, ids.select("image_id").distinct())


def wide_distances(store: Store, queries: Sequence[Query], features: Sequence[str] | None = None, *, metrics: dict | None = None, ids: DataFrame | None = None, more: str | None = None) -> tuple[DataFrame, list[dict[str, str]]]:
    """One row for each image with the distances of all queries, and for each query its feature's columns.

    An invalid query vector leaves its feature out with a warning, as long as
    another is left; with ids it is an error. An image that a feature lacks is an
    error, or, with ids, left out. `more` names a feature that the first query
    needs a column `_near` of.
    """
    wide = isinstance(store, Wide)
    used: list[dict[str, str]] = [{} for _ in queries]
    wanted: dict[str, list[Column]] = {}
    for i, q in enumerate(queries):
        for j, name in enumerate(select_features(list(store), features, q)):
            try:
                d = search.distance_to(F.col(name if wide else "vector"), q[name], _metric(name, metrics))
            except ValueError as e:
                if ids is not None or more:
                    raise
                warnings.warn(f"{name} is left out: {e}", stacklevel=3)
                continue
            used[i][name] = f"d{i}_{j}"
            wanted.setdefault(name, []).append(d.alias(f"d{i}_{j}"))
        if not used[i]:
            raise ValueError("no feature could be compared")
    if more:
        wanted.setdefault(more, []).append(search.distance_to(F.col(more if wide else "vector"), queries[0][more], _metric(more, metrics)).alias("_near"))
    if wide:
        rows = store.frame if ids is None else store.frame.join(ids.select("image_id").distinct(), "image_id", "left_semi")
        return rows.select("image_id", *[c for columns in wanted.values() for c in columns]), used
    parts = [store[n].select("image_id", *columns) for n, columns in wanted.items()]
    if ids is not None:
        few = ids.select("image_id").distinct()
        return reduce(lambda a, b: a.join(b, "image_id"), [p.join(few, "image_id", "left_semi") for p in parts]), used
    rows = reduce(lambda a, b: a.join(b, "image_id", "full"), parts)
    if len(parts) > 1:
        names = [c for c in rows.columns if c != "image_id"]
        lacks = F.raise_error(F.concat(F.lit("a feature lacks image "), F.col("image_id").cast("string"))).cast("double")
        rows = rows.withColumns({c: F.coalesce(F.col(c), lacks) for c in names})
    return rows, used


def scores(store: Store, query: Query, features: Sequence[str] | None = None, weights: dict[str, float] | None = None, *, query_id: int = 0, metrics: dict | None = None, ids: DataFrame | None = None, strict: bool = False, check: bool = False) -> DataFrame:
    """query_id, image_id, score of every row, or of the candidates, of which one at least must be in every feature."""
    if check:
        fusion.assert_aligned(feature_distances(store, query, features, query_id=query_id, metrics=metrics, ids=ids))
    rows, used = wide_distances(store, [query], features, metrics=metrics, ids=ids)
    if ids is not None and rows.isEmpty():
        raise ValueError("no candidate id is in every feature")
    return fusion.fuse_wide(rows, used, weights, strict=strict).select(F.lit(query_id).cast("long").alias("query_id"), "image_id", F.col("s0").alias("score"))


def nearest(store: Store, query: Query, k: int, *, k_candidates: int = K_CANDIDATES, metrics: dict | None = None, feature: str = "embedding", index=None) -> DataFrame:
    """Candidate ids for a query by one feature: from an index, or exactly."""
    _candidate_feature(store, query, feature)
    if index is not None:
        return index.search(query[feature], k_candidates).select("image_id")
    found = search.all_distances(store[feature], query[feature], _metric(feature, metrics)).filter(D.is_finite(F.col("distance")))
    return found.orderBy("distance", "image_id").limit(max(k, k_candidates)).select("image_id")


def _candidate_feature(store: Store, query: Query, feature: str) -> None:
    if feature not in query or feature not in store:
        raise ValueError(f"candidates need the feature {feature!r}")


def _scored(store: Store, queries: Sequence[Query], k: int, features, weights, backend: str, k_candidates: int, index, metrics, feature: str, strict: bool) -> DataFrame:
    """image_id and each query's score, of all rows or of the candidates for the first query."""
    if backend == "exact":
        rows, used = wide_distances(store, queries, features, metrics=metrics)
        return fusion.fuse_wide(rows, used, weights, strict=strict)
    if backend != "candidates":
        raise ValueError("backend is exact or candidates")
    _candidate_feature(store, queries[0], feature)
    if index is None and isinstance(store, Wide):  # one scan finds and scores them
        rows, used = wide_distances(store, queries, features, metrics=metrics, more=feature)
        rows = rows.filter(D.is_finite(F.col("_near"))).orderBy("_near", "image_id").limit(max(k, k_candidates))
    else:
        ids = nearest(store, queries[0], k, k_candidates=k_candidates, metrics=metrics, feature=feature, index=index)
        rows, used = wide_distances(store, queries, features, metrics=metrics, ids=ids)
    return fusion.fuse_wide(rows, used, weights, strict=strict, few=True)


def single_query(store: Store, query: Query, k: int, *, features: Sequence[str] | None = None, weights: dict[str, float] | None = None, backend: str = "exact", k_candidates: int = K_CANDIDATES, index=None, metrics: dict | None = None, candidate_feature: str = "embedding", strict: bool = False) -> DataFrame:
    """rank, image_id, score of the k best; fewer if there are no more.

    backend "exact" scores every row; "candidates" re-ranks the nearest by one
    feature (by the index if one is given). Scores are scaled within the rows
    compared, so the two backends' scores are not to be compared.
    """
    found = _scored(store, [query], k, features, weights, backend, k_candidates, index, metrics, candidate_feature, strict)
    return search.top_k(found.withColumnRenamed("s0", "score"), k, "score")


def multi_query(store: Store, queries: Sequence[Query], k: int, *, features: Sequence[str] | None = None, weights: dict[str, float] | None = None, backend: str = "exact", k_candidates: int = K_CANDIDATES, index=None, metrics: dict | None = None, candidate_feature: str = "embedding", strict: bool = False) -> DataFrame:
    """rank, image_id, score: the mean of two or more queries' scores.

    With "candidates" the first query chooses them for all, so order matters.
    """
    if len(queries) < 2:
        raise ValueError("a multi-query has two queries at least")
    used = {tuple(select_features(list(store), features, q)) for q in queries}
    if len(used) > 1:
        raise ValueError("queries must have the same features")
    found = _scored(store, queries, k, features, weights, backend, k_candidates, index, metrics, candidate_feature, strict)
    mean = sum((F.col(f"s{i}") for i in range(len(queries))), F.lit(0.0)) / len(queries)
    return search.top_k(found.select("image_id", mean.alias("score")), k, "score")


def from_images(spark: SparkSession, paths: Sequence[str], features: Sequence[str] | None = None, extractors: dict[str, Callable[[Column], Column]] | None = None) -> list[Query]:
    """A query for each image file, which need not be in the store: its features, by the extractors that made the store.

    A feature that can't be extracted, or that no extractor has, is left out
    with a warning; a file that isn't there or isn't an image, and a query
    without any feature, are errors.
    """
    known = extractors or I.extractors()
    for name in features or ():
        if name not in known:
            warnings.warn(f"no extractor for feature {name!r}", stacklevel=2)
    names = sorted(n for n in known if features is None or n in features)
    if not names:
        raise ValueError("no feature to extract")
    out = []
    for path in paths:  # a few images
        try:
            row = spark.read.format("image").option("dropInvalid", "false").load(path)
        except AnalysisException as e:
            raise ValueError(f"cannot load {path}: missing") from e
        state = row.select(images.status(F.col("image"), F.lit(True))).first()
        if state is None or state[0] != "ok":
            raise ValueError(f"cannot load {path}: {state[0] if state else 'missing'}")
        query = {}
        for name in names:
            try:
                vector = row.select(known[name](F.col("image")).alias("v")).first()["v"]
            except Exception as e:  # whatever the extractor raises
                warnings.warn(f"{name} of {path} is left out: {str(e)[:200]}", stacklevel=2)
                continue
            if vector is None:
                warnings.warn(f"{name} of {path} is left out: it has no value", stacklevel=2)
            else:
                query[name] = list(vector)
        if not query:
            raise ValueError(f"no feature of {path} could be extracted")
        out.append(query)
    return out


def by_images(spark: SparkSession, store: Store, paths: Sequence[str], k: int, *, features: Sequence[str] | None = None, extractors: dict | None = None, **how) -> DataFrame:
    """rank, image_id, score of the best matches of one image file, or of several together."""
    queries = from_images(spark, paths, [n for n in features if n in store] if features else list(store), extractors)
    if len(queries) == 1:
        return single_query(store, queries[0], k, **how)
    shared = set.intersection(*(set(q) for q in queries))
    if not shared:
        raise ValueError("the images share no feature")
    return multi_query(store, [{n: q[n] for n in shared} for q in queries], k, **how)


def timed_query(store: Store, query: Query, k: int, **how) -> tuple[list, dict[str, float]]:
    """Rows of `single_query` and milliseconds for planning and running."""
    begin = time.perf_counter()
    plan = single_query(store, query, k, **how)
    planned = time.perf_counter()
    rows = plan.collect()  # k rows
    done = time.perf_counter()
    return rows, {"plan_ms": (planned - begin) * 1e3, "run_ms": (done - planned) * 1e3, "total_ms": (done - begin) * 1e3}


class Session:
    """A store, an index and settings kept for many queries; tables may be cached."""

    def __init__(self, store: Store, index=None, *, cache: bool = False, **how):
        if isinstance(store, Wide):
            self.store = Wide(store.frame.cache(), list(store)) if cache else store
        else:
            self.store = {n: t.cache() for n, t in store.items()} if cache else dict(store)
        self.index, self.how = index, how

    def ask(self, queries: Query | Sequence[Query], k: int, **how) -> DataFrame:
        how = self.how | how | {"index": self.index}
        if isinstance(queries, dict):
            return single_query(self.store, queries, k, **how)
        return single_query(self.store, queries[0], k, **how) if len(queries) == 1 else multi_query(self.store, queries, k, **how)

    def close(self) -> None:
        for table in [self.store.frame] if isinstance(self.store, Wide) else self.store.values():
            table.unpersist()
