"""Two- and three-dimensional maps of features, and the data behind an explorer."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.operators.knn import knn
from nearfield.operators.search import assert_unique

_AXES = ("x", "y", "z")


def project(features: DataFrame, dims: int = 2, *, sample: int | None = None, seed: int = 42, method: str = "pca") -> DataFrame:
    """image_id, x, y[, z]: principal components of the unit vectors.

    This is PCA, not UMAP: a linear map that a cluster can compute. With
    sample, that many rows, chosen by a hash of the id and the seed.
    """
    if dims not in (2, 3):
        raise ValueError("dims is 2 or 3")
    if method != "pca":
        raise ValueError("the only method is pca")
    if sample is not None and sample <= 0:
        raise ValueError("sample must be positive")
    rows = features if sample is None else features.orderBy(F.xxhash64("image_id", F.lit(seed)), "image_id").limit(sample)
    rows = rows.select("image_id", array_to_vector(D.unit(D.doubles(F.col("vector")))).alias("unit"))
    if len(rows.limit(dims + 1).collect()) <= dims:
        raise ValueError(f"{dims} dimensions need more than {dims} rows")
    model = PCA(k=dims, inputCol="unit", outputCol="at").fit(rows)
    at = model.transform(rows).select("image_id", vector_to_array("at").alias("at"))
    # components have no sign of their own: the largest loading is made positive
    pc = model.pc.toArray()
    sign = [1.0 if abs(pc[:, i].max()) >= abs(pc[:, i].min()) else -1.0 for i in range(dims)]
    return at.select("image_id", *[(F.get("at", i) * F.lit(sign[i])).alias(_AXES[i]) for i in range(dims)])


def check_coordinates(coords: DataFrame, dims: int = 2) -> DataFrame:
    """Coordinates with whole ids that don't repeat and finite values."""
    axes = list(_AXES[:dims])
    if [c for c in coords.columns if c != "image_id"] != axes:
        raise ValueError(f"coordinates have the columns image_id, {', '.join(axes)}")
    if dict(coords.dtypes)["image_id"] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids must be whole numbers")
    assert_unique(coords, "image_id")
    bad = ~D.is_finite(F.col(axes[0]))
    for a in axes[1:]:
        bad = bad | ~D.is_finite(F.col(a))
    if not coords.filter(bad).isEmpty():
        raise ValueError("coordinates must be finite")
    return coords


def placed_vectors(coords: DataFrame, features: DataFrame) -> DataFrame:
    """Coordinates with their vectors; a coordinate without a vector is an error."""
    out = coords.join(features.select("image_id", "vector"), "image_id", "left")
    lost = F.raise_error(F.concat(F.lit("no vector for image "), F.col("image_id").cast("string")))
    return out.withColumn("vector", F.coalesce("vector", lost.cast("array<float>")))


def neighbours_of(features: DataFrame, k: int) -> DataFrame:
    """The k nearest others of every row by Euclidean distance."""
    return knn(features, k, "euclidean", include_self=False)
