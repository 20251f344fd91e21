"""Small interchange files: pilot lists, comparison tables, id maps, coordinates."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import schemas
from nearfield.operators import catalog as C


def write_pilot(ids: Sequence[int], path: str) -> None:
    """One id a line, in order."""
    with open(path, "w") as out:
        out.writelines(f"{int(i)}\n" for i in ids)


def read_pilot(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """position, image_id in file order; blank lines don't count.

    Order lies in the file, so it is read as one text and numbered there; a
    pilot list is some thousands of lines.
    """
    if start < 0 or (stop is not None and stop < start):
        raise ValueError(f"a slice needs 0 <= start <= stop, not {start} and {stop}")
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = whole.select(F.posexplode(lines).alias("position", "id")).select(F.col("position").cast("long").alias("position"), F.col("id").cast("long").alias("image_id"))
    out = out.filter(F.col("position") >= start)
    return out if stop is None else out.filter(F.col("position") < stop)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMPARISON).option("header", "true").csv(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """image_id, path of a file with one JSON object."""
    return C.id_map(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def read_coordinates(spark: SparkSession, coords: str, ids: str, dims: int = 2) -> DataFrame:
    """image_id, x, y[, z] from a .npy of coordinates and ids from .npy, a JSON list, or {"ids": [...]}."""
    at = np.load(coords)
    if ids.endswith(".npy"):
        names = np.load(ids)
    else:
        with open(ids) as f:
            told = json.load(f)
        names = np.asarray(told["ids"] if isinstance(told, dict) else told)
    if not np.issubdtype(names.dtype, np.integer):
        raise ValueError("ids must be whole numbers")
    if at.ndim != 2 or at.shape[1] != dims or len(at) != len(names):
        raise ValueError(f"{len(names)} ids need as many rows of {dims} coordinates, not {at.shape}")
    schema = ", ".join(["image_id long", *(f"{a} double" for a in "xyz"[:dims])])
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(names, at, strict=True)], schema)


def write_coordinates(coords: DataFrame, folder: str, **about) -> None:
    """coords_<dims>d.npy, its ids and metadata, on the driver's disk; a map is for looking at, so it is small."""
    axes = [c for c in coords.columns if c != "image_id"]
    rows = coords.orderBy("image_id").collect()
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/coords_{len(axes)}d"
    np.save(f"{name}.npy", np.array([[r[a] for a in axes] for r in rows], dtype=np.float32))
    np.save(f"{name}_ids.npy", np.array([r["image_id"] for r in rows], dtype=np.int64))
    with open(f"{name}.json", "w") as out:
        json.dump({"dims": len(axes), "n": len(rows)} | about, out, sort_keys=True, indent=2)
