"""Evaluation: agreement of result lists, ranks, timings and their summaries."""

from __future__ import annotations

import cProfile
import pstats
import statistics
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import schemas
from nearfield.functions import scalars as S
from nearfield.operators import query as Q
from nearfield.operators import search


def overlap_at_k(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """query_id, overlap: the share of the first list's top k that the second's top k has."""
    a, b = (x.filter(F.col("rank") <= k).select("query_id", "image_id") for x in (first, second))
    n = a.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    both = a.join(b, ["query_id", "image_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("both"))
    return n.join(both, "query_id", "left").select("query_id", (F.coalesce("both", F.lit(0)) / F.col("n")).alias("overlap"))


def rank_of(scored: DataFrame, targets: DataFrame, value: str = "score") -> DataFrame:
    """query_id, image_id, rank (from 1; null if it is absent) of one target a query.

    A rank is one more than the number of better rows, so nothing is sorted.
    """
    mine = targets.select("query_id", "image_id").join(scored.select("query_id", "image_id", F.col(value).alias("_mine")), ["query_id", "image_id"], "left")
    t = mine.select("query_id", F.col("image_id").alias("_target"), "_mine")
    better = (F.col(value) < F.col("_mine")) | ((F.col(value) == F.col("_mine")) & (F.col("image_id") < F.col("_target")))
    n = scored.join(t, "query_id").groupBy("query_id").agg(F.count_if(better).alias("_n"))
    return mine.join(n, "query_id", "left").select("query_id", "image_id", F.when(F.col("_mine").isNotNull(), F.col("_n") + 1).alias("rank"))


def backend_summary(rows: DataFrame) -> DataFrame:
    """By k_candidates: mean and least overlap, mean times, and how many times faster candidates are."""
    out = rows.groupBy("k_candidates").agg(F.avg("overlap").alias("avg_overlap"), F.min("overlap").alias("min_overlap"), F.avg("exact_ms").alias("avg_exact_ms"), F.avg("approx_ms").alias("avg_approx_ms"))
    return out.withColumn("speedup", F.when(F.col("avg_approx_ms") > 0, F.col("avg_exact_ms") / F.col("avg_approx_ms")).otherwise(F.lit(float("inf"))))


def timing_summary(times: DataFrame, query: str = "query_id", value: str = "ms", by: Sequence[str] = ()) -> DataFrame:
    """The median over repeats of each query, then mean, median, least and greatest of these."""
    per = times.groupBy(*by, query).agg(F.percentile(value, 0.5).alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.percentile("m", 0.5).alias("median"), F.min("m").alias("min"), F.max("m").alias("max"))


def stage_breakdown(times: DataFrame, stage: str = "stage", value: str = "ms") -> DataFrame:
    """Mean by stage and its share of the sum of means in percent, the largest first."""
    mean = times.groupBy(stage).agg(F.avg(value).alias("mean"))
    whole = mean.agg(F.sum("mean").alias("_all"))  # one row
    return mean.crossJoin(F.broadcast(whole)).select(stage, "mean", (100 * F.col("mean") / F.col("_all")).alias("percent")).orderBy(F.desc("percent"), stage)


def draw_ids(ids: Sequence[int], n: int, seed: int = 42) -> list[int]:
    """n ids without replacement by numpy's generator, for evaluation queries."""
    ids = sorted(ids)
    if n > len(ids):
        raise ValueError(f"{n} of {len(ids)} ids can't be drawn")
    return [int(i) for i in np.random.default_rng(seed).choice(ids, size=n, replace=False)]


def query_vectors(store: Q.Store, ids: Sequence[int]) -> dict[int, Q.Query]:
    """Each id's vectors in every feature; an id that one lacks is an error. For a few ids."""
    out: dict[int, Q.Query] = {i: {} for i in ids}
    if isinstance(store, Q.Wide):  # one scan has them all
        rows = {r["image_id"]: r for r in store.frame.filter(F.col("image_id").isin(list(ids))).collect()}
        lost = sorted(set(ids) - set(rows))
        if lost:
            raise ValueError(f"the store lacks the ids {lost}")
        return {i: {name: list(rows[i][name]) for name in store} for i in ids}
    for name, table in store.items():
        found = {r["image_id"]: list(r["vector"]) for r in table.filter(F.col("image_id").isin(list(ids))).collect()}
        lost = sorted(set(ids) - set(found))
        if lost:
            raise ValueError(f"{name} lacks the ids {lost}")
        for i in ids:
            out[i][name] = found[i]
    return out


def compare_backends(store: Q.Store, ids: Sequence[int], ks: Sequence[int] = (50, 200, 1000, 10_000), k: int = 5, *, index=None, metrics: dict | None = None, candidate_feature: str = "embedding") -> DataFrame:
    """One row a query and k_candidates (schemas.COMPARISON): times, overlap@k and self-ranks of both backends."""
    spark = next(iter(store.values())).sparkSession
    rows = []
    for i, vectors in query_vectors(store, ids).items():
        exact, t0 = Q.timed_query(store, vectors, k, metrics=metrics)
        want = [r["image_id"] for r in exact]
        for n in ks:
            near, t1 = Q.timed_query(store, vectors, k, backend="candidates", k_candidates=n, index=index, metrics=metrics, candidate_feature=candidate_feature)
            got = [r["image_id"] for r in near]
            place = lambda x: x.index(i) + 1 if i in x else None  # noqa: B023, E731
            rows.append((i, n, t0["total_ms"], t1["total_ms"], len(set(want) & set(got)) / max(1, len(want)), place(want), place(got)))
    return spark.createDataFrame(rows, schemas.COMPARISON)


def repeat(run: Callable[[], object], repeats: int = 3, warmups: int = 0) -> dict[str, float]:
    """Milliseconds of a callable: mean, median, min, max."""
    for _ in range(warmups):
        run()
    times = []
    for _ in range(repeats):
        begin = time.perf_counter()
        run()
        times.append((time.perf_counter() - begin) * 1e3)
    return {"mean": statistics.fmean(times), "median": statistics.median(times), "min": min(times), "max": max(times)}


def profile(run: Callable, *args, output: str | None = None, **kwargs):
    """The callable's result and its profile."""
    p = cProfile.Profile()
    result = p.runcall(run, *args, **kwargs)
    if output:
        p.dump_stats(output)
    return result, pstats.Stats(p)


def profile_rows(spark: SparkSession, stats: pstats.Stats, within: str = "") -> DataFrame:
    """Functions whose file's name holds `within`, those with the most cumulative time first."""
    rows = []
    for (file, line, function), (calls, _, own, whole, _) in stats.stats.items():
        if within in file:
            rows.append((file, function, f"{file.rsplit('/', 1)[-1]}:{line}:{function}", int(calls), float(own), float(whole)))
    return spark.createDataFrame(rows, schemas.PROFILE).orderBy(F.desc("cumtime"), "label")


def hot_spots(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n rows with the most cumulative time, with a colour from green to red."""
    check = search.check_k(n)
    top = rows.orderBy(F.desc("cumtime"), "label").limit(check)
    ends = top.agg(F.min("cumtime").alias("_low"), F.max("cumtime").alias("_high"))
    return top.crossJoin(F.broadcast(ends)).withColumn("colour", S.heat_colour(F.col("cumtime"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
