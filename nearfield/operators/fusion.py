"""Fusion of several features' distances into one score.

Distances come as rows (query_id, feature, image_id, distance). Alignment is a
join on ids, never on positions. Only finite distances make a feature's range;
rows that are not finite get 1.0, the worst. With strict=True a feature that
has any such row is dropped for that query instead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import distances as D

CONSTANT = 1e-6


def check_weights(weights: dict[str, float], features: set[str]) -> dict[str, float]:
    if set(weights) != set(features):
        raise ValueError(f"weights name {sorted(weights)}, the distances {sorted(features)}")
    for name, w in weights.items():
        if isinstance(w, bool) or not isinstance(w, int | float) or not math.isfinite(w) or w < 0:
            raise ValueError(f"the weight of {name} must be a number from 0 up, not {w!r}")
    if not math.isclose(sum(weights.values()), 1.0, rel_tol=1e-6):
        raise ValueError(f"weights must sum to 1, not {sum(weights.values())}")
    return weights


def normalised(distances: DataFrame) -> DataFrame:
    """Adds norm, the distance scaled to [0, 1] by the query's and feature's least and greatest, and that range.

    The ranges are a small aggregate (a row for each query and feature) that
    partial sums make; no window has to gather a whole feature in one task.
    """
    d = F.when(D.is_finite(F.col("distance")), F.col("distance"))
    ranges = distances.groupBy("query_id", "feature").agg(F.min(d).alias("_low"), F.max(d).alias("_high"), F.count_if(~D.is_finite(F.col("distance"))).alias("_odd"))
    rows = distances.join(ranges, ["query_id", "feature"])
    width = F.col("_high") - F.col("_low")
    scaled = F.when(~D.is_finite(F.col("distance")), 1.0).when(width > 0, (F.col("distance") - F.col("_low")) / width).otherwise(0.0)
    # the range of the scaled values: 1 where they differ, however little
    reach = F.when(F.coalesce(width, F.lit(0.0)) > 0, 1.0).otherwise(0.0)
    return rows.withColumn("norm", scaled).withColumn("norm_range", F.when(F.col("_odd") > 0, F.greatest(reach, F.when(F.col("_low").isNotNull(), 1.0).otherwise(0.0))).otherwise(reach)).drop("_low", "_high")


def informative(rows: DataFrame, epsilon: float = CONSTANT, strict: bool = False) -> DataFrame:
    """Without features whose normalised distances hardly differ."""
    kept = rows.filter(F.col("norm_range") >= epsilon)
    return kept.filter("_odd = 0") if strict else kept


def fuse(distances: DataFrame, weights: dict[str, float] | None = None, *, strict: bool = False, features: set[str] | None = None) -> DataFrame:
    """query_id, image_id, score: the (weighted) mean of the informative features; 0 without any.

    Weights are renormalised over the features that are left. Give the names of
    the features if they are known; else weights cost a job that reads them.
    """
    rows = normalised(distances)
    kept = informative(rows, strict=strict)
    if weights is None:
        part = kept.groupBy("query_id", "image_id").agg(F.avg("norm").alias("_s"))
    else:
        names = features or {r[0] for r in distances.select("feature").distinct().collect()}  # a few feature names
        check_weights(weights, names)
        w = F.coalesce(*[F.when(F.col("feature") == n, F.lit(float(x))) for n, x in weights.items()])
        kept = kept.withColumn("_w", w)
        lost = F.when(F.sum("_w") > 0, F.sum(F.col("_w") * F.col("norm")) / F.sum("_w")).otherwise(F.raise_error(F.lit("all weights of the features left are 0")).cast("double"))
        part = kept.groupBy("query_id", "image_id").agg(lost.alias("_s"))
    spine = distances.select("query_id", "image_id").distinct()
    return spine.join(part, ["query_id", "image_id"], "left").select("query_id", "image_id", F.coalesce("_s", F.lit(0.0)).alias("score"))


def fuse_wide(rows: DataFrame, columns: list[dict[str, str]], weights: dict[str, float] | None = None, *, strict: bool = False, few: bool = False) -> DataFrame:
    """image_id and a score for each query, s0, s1, ...: what `fuse` gives, for rows that have a column for each distance.

    columns: for each query a dict from feature to its distance column. The
    ranges are one row, the aggregate of all rows, joined to each; with `few`
    (rows that a limit bounds, in one partition) a window over them, so that
    what lies before is read once. Expressions are SQL texts: one call to the
    JVM each, not one for each operator.
    """
    names = sorted({c for query in columns for c in query.values()})
    finite = {c: f"coalesce(not isnan({c}) and abs({c}) < double('infinity'), false)" for c in names}
    ranges = [x for c, ok in finite.items() for x in ((f"min(case when {ok} then {c} end)", f"{c}_low"), (f"max(case when {ok} then {c} end)", f"{c}_high"), (f"count_if(not {ok})", f"{c}_odd"))]
    if few:
        rows = rows.selectExpr("*", *[f"{x} over (partition by 0) as {n}" for x, n in ranges])
    else:
        rows = rows.crossJoin(F.broadcast(rows.selectExpr(*[f"{x} as {n}" for x, n in ranges])))  # one row
    norm = {c: f"case when not {ok} then 1.0D when {c}_high > {c}_low then ({c} - {c}_low) / ({c}_high - {c}_low) else 0.0D end" for c, ok in finite.items()}
    kept = {c: f"(coalesce({c}_high > {c}_low, false) or ({c}_odd > 0 and {c}_low is not null))" + (f" and {c}_odd = 0" if strict else "") for c in names}

    def score(query: dict[str, str]) -> str:
        share = check_weights(weights, set(query)) if weights else dict.fromkeys(query, 1.0)
        total = " + ".join(f"case when {kept[c]} then {float(share[n])!r}D else 0.0D end" for n, c in sorted(query.items()))
        value = " + ".join(f"case when {kept[c]} then {float(share[n])!r}D * ({norm[c]}) else 0.0D end" for n, c in sorted(query.items()))
        left = " or ".join(f"({kept[c]})" for c in query.values())
        return f"case when {total} > 0 then ({value}) / ({total}) when {left} then cast(raise_error('all weights of the features left are 0') as double) else 0.0D end"

    return rows.selectExpr("image_id", *[f"{score(q)} as s{i}" for i, q in enumerate(columns)])


def fuse_queries(scores: DataFrame, n: int | None = None) -> DataFrame:
    """image_id, score: the mean over n queries (counted, if not told); each must have scored the same images."""
    n = n or scores.select("query_id").distinct().count()
    mean = scores.groupBy("image_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    missing = F.raise_error(F.lit("queries scored different images")).cast("double")
    return mean.select("image_id", F.when(F.col("_n") == n, F.col("score")).otherwise(missing).alias("score"))


def assert_aligned(distances: DataFrame) -> None:
    """Every feature of a query has the same ids, each once."""
    n = Window.partitionBy("query_id")
    per = distances.groupBy("query_id", "feature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("ids"))
    worst = per.withColumn("most", F.max("n").over(n)).filter("n <> ids or n <> most").first()
    if worst:
        raise ValueError(f"ids repeat or are missing: {worst.asDict()}")
    features = distances.groupBy("query_id").agg(F.count_distinct("feature").alias("f"))
    gap = distances.groupBy("query_id", "image_id").agg(F.count(F.lit(1)).alias("n")).join(features, "query_id").filter("n <> f").first()
    if gap:
        raise ValueError(f"an id is missing in a feature: {gap.asDict()}")


def aligned(canonical: DataFrame, found: DataFrame) -> DataFrame:
    """position, image_id, distance: the found distances in canonical order (position, image_id); ids must agree."""
    for rows in (canonical, found):
        worst = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
        if worst:
            raise ValueError(f"id {worst['image_id']} repeats")
    both = canonical.join(found.withColumn("_there", F.lit(True)), "image_id", "full")
    gap = both.filter("position is null or _there is null").first()
    if gap:
        raise ValueError(f"id {gap['image_id']} is only in one of the two")
    return both.select("position", "image_id", "distance")
