"""Feature shards: Parquet partitioned by feature and shard, with a manifest row for each complete shard.

A shard is written by replacing its partition, then noted in the manifest; a
shard without a manifest row is not complete, so readers leave it out and a
later run writes it again. Single shards can be exchanged as .npy folders.
"""

from __future__ import annotations

import datetime
import json
import os
import tempfile
import warnings
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import schemas
from nearfield.operators import catalog as C

#: The keys of a shard's metadata, its version, and the features' dimensions and types.
META_KEYS = {"feature_type", "feature_dim", "feature_dtype", "shard_size", "created_at", "version"}
META_VERSION = 1
KNOWN = {"hsv": (432, "float32"), "phash": (64, "uint8"), "embedding": (None, "float32")}
SHARD_SIZE, PILOT_SHARD_SIZE = 5000, 200


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def manifest(self) -> DataFrame:
        path = f"{self.root}/manifest"
        if not self._exists(path):
            return self.spark.createDataFrame([], schemas.MANIFEST)
        return self.spark.read.schema(schemas.MANIFEST).parquet(path).dropDuplicates(["feature_type", "shard_id"])

    def features(self) -> list[str]:
        """Features with complete shards."""
        return sorted(r[0] for r in self.manifest().select("feature_type").distinct().collect())

    def write(self, rows: DataFrame, feature: str) -> DataFrame:
        """Writes rows (image_id, vector, shard_id), checks them, and notes their shards; returns what was noted."""
        path = f"{self.root}/features"
        typed = rows.select(F.col("image_id").cast("long").alias("image_id"), F.col("vector").cast("array<float>").alias("vector"), F.col("shard_id").cast("int").alias("shard_id"), F.lit(feature).alias("feature_type"))
        typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_type", "shard_id").parquet(path)
        done = [r[0] for r in rows.select("shard_id").distinct().collect()]  # shard numbers
        written = self.read(feature, complete=False).filter(F.col("shard_id").isin(done))
        found = validated(written, feature)
        found.write.mode("append").parquet(f"{self.root}/manifest")
        return found

    def read(self, feature: str, *, complete: bool = True) -> DataFrame:
        """image_id, vector, shard_id of a feature's complete shards; others are warned about."""
        path = f"{self.root}/features"
        if not self._exists(path):
            raise FileNotFoundError(f"no features in {self.root}")
        rows = self.spark.read.schema(schemas.FEATURES).parquet(path).filter(F.col("feature_type") == feature).drop("feature_type")
        if not complete:
            return rows
        shards = self.shards(feature)
        if not shards:
            raise FileNotFoundError(f"no complete shard of {feature} in {self.root}")
        open_ = [r[0] for r in rows.select("shard_id").distinct().filter(~F.col("shard_id").isin(shards)).collect()]
        if open_:
            warnings.warn(f"incomplete shards of {feature} are left out: {sorted(open_)}", stacklevel=2)
        return rows.filter(F.col("shard_id").isin(shards))

    def shards(self, feature: str) -> list[int]:
        return sorted(r[0] for r in self.manifest().filter(F.col("feature_type") == feature).select("shard_id").collect())

    def pending(self, feature: str, n: int) -> DataFrame:
        """shard_id of those below n that are not complete."""
        if n < 0:
            raise ValueError("n must not be negative")
        return pending_shards(self.spark, self.manifest().filter(F.col("feature_type") == feature), n)

    def store(self, features: Sequence[str] | None = None) -> dict[str, DataFrame]:
        return {f: self.read(f).select("image_id", "vector") for f in (features or self.features())}

    def extract(self, images: DataFrame, feature: str, extract: Callable[[Column], Column], *, shard_size: int = SHARD_SIZE, start: int = 0, stop: int | None = None) -> list[int]:
        """Computes a feature of images (image_id, image) shard by shard; returns the shards written.

        Shards hold `shard_size` images in id order. Complete shards, and those
        outside start to stop, are left alone, so a run that broke off goes on.
        """
        total = images.count()
        if not total:
            return []
        n = -(-total // shard_size)
        low, high = max(0, start), min(n, n if stop is None else stop)
        if low >= high:
            raise ValueError(f"no shard in {start} to {stop} of {n}")
        todo = [r[0] for r in self.pending(feature, n).filter((F.col("shard_id") >= low) & (F.col("shard_id") < high)).collect()]
        if not todo:
            return []
        rows = C.fixed_shards(images.select("image_id"), shard_size).filter(F.col("shard_id").isin(todo))
        rows = images.join(rows, "image_id").select("image_id", extract(F.col("image")).alias("vector"), "shard_id").filter("vector is not null")
        return sorted(r[0] for r in self.write(rows, feature).select("shard_id").collect())


def pending_shards(spark: SparkSession, done: DataFrame, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("shard_id")).join(done.select("shard_id"), "shard_id", "left_anti")


def shard_stats(rows: DataFrame) -> DataFrame:
    """By shard: rows, distinct ids, least and greatest dimension, vectors with nulls or values that aren't finite."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("n_ids"), F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"), F.count_if(odd).alias("n_invalid"))


def validated(rows: DataFrame, feature: str) -> DataFrame:
    """Manifest rows of shards that hold up; a shard that doesn't is an error."""
    dim, dtype = KNOWN.get(feature, (None, "float32"))
    stats = shard_stats(rows).collect()  # a row for each shard written
    for r in stats:
        if r["n"] != r["n_ids"]:
            raise ValueError(f"shard {r['shard_id']} of {feature}: ids repeat")
        if r["min_dim"] != r["max_dim"] or (dim and r["min_dim"] != dim):
            raise ValueError(f"shard {r['shard_id']} of {feature}: dimensions {r['min_dim']} to {r['max_dim']}" + (f", not {dim}" if dim else ""))
        if r["n_invalid"]:
            raise ValueError(f"shard {r['shard_id']} of {feature}: {r['n_invalid']} vectors are not finite")
    made = now()
    return rows.sparkSession.createDataFrame([(feature, r["shard_id"], r["min_dim"], dtype, r["n"], made, META_VERSION) for r in stats], schemas.MANIFEST)


def memory_bytes(rows: DataFrame) -> int:
    """Bytes of the vectors as 32-bit floats."""
    return rows.agg(F.sum(F.size("vector").cast("long") * 4)).first()[0] or 0


def check_meta(meta: dict, features: np.ndarray, ids: np.ndarray, feature: str) -> None:
    if features.ndim != 2 or ids.ndim != 1 or len(ids) != len(features):
        raise ValueError("features need two dimensions, ids one, and as many of both")
    if set(meta) != META_KEYS:
        raise ValueError(f"metadata has the keys {sorted(meta)}, not {sorted(META_KEYS)}")
    want = {"version": META_VERSION, "feature_type": feature, "feature_dim": features.shape[1], "feature_dtype": str(features.dtype), "shard_size": len(features)}
    for key, value in want.items():
        if meta[key] != value:
            raise ValueError(f"metadata says {key} = {meta[key]!r}, the shard {value!r}")


def shard_folder(root: str, feature: str, shard: int) -> str:
    if shard < 0:
        raise ValueError("a shard's number must not be negative")
    return os.path.join(root, feature, f"shard_{shard:04d}")


def _atomic(path: str, write: Callable) -> None:
    """Writes beside the target, then renames: readers see all or nothing."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".new-")
    try:
        with os.fdopen(handle, "wb") as out:
            write(out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def export_npy(rows: DataFrame, root: str, feature: str, shard: int) -> str:
    """One shard (image_id, vector; a few thousand rows) as features.npy, ids.npy, meta.json and a marker, on the driver's disk."""
    found = rows.select("image_id", "vector").orderBy("image_id").collect()
    dtype = KNOWN.get(feature, (None, "float32"))[1]
    features, ids = np.array([r["vector"] for r in found], dtype=dtype), np.array([r["image_id"] for r in found], dtype=np.int64)
    meta = {"feature_type": feature, "feature_dim": int(features.shape[1]) if features.ndim == 2 else 0, "feature_dtype": dtype, "shard_size": len(ids), "created_at": now(), "version": META_VERSION}
    check_meta(meta, features, ids, feature)
    folder = shard_folder(root, feature, shard)
    os.makedirs(folder, exist_ok=True)
    _atomic(f"{folder}/features.npy", lambda out: np.save(out, features))
    _atomic(f"{folder}/ids.npy", lambda out: np.save(out, ids))
    _atomic(f"{folder}/meta.json", lambda out: out.write(json.dumps(meta, sort_keys=True, indent=2).encode()))
    _atomic(f"{folder}/_SUCCESS", lambda out: None)
    return folder


def import_npy(spark: SparkSession, root: str, feature: str, shard: int) -> DataFrame:
    """image_id, vector, shard_id of one exchanged shard, checked."""
    folder = shard_folder(root, feature, shard)
    lost = [n for n in ("_SUCCESS", "features.npy", "ids.npy", "meta.json") if not os.path.exists(f"{folder}/{n}")]
    if lost:
        raise FileNotFoundError(f"{folder} lacks {', '.join(lost)}")
    try:
        features, ids = np.load(f"{folder}/features.npy"), np.load(f"{folder}/ids.npy")
        with open(f"{folder}/meta.json") as f:
            meta = json.load(f)
    except (ValueError, OSError, EOFError) as e:
        raise ValueError(f"{folder} can't be read: {e}") from e
    if not isinstance(meta, dict):
        raise ValueError(f"{folder}: metadata is no object")
    check_meta(meta, features, ids, feature)
    rows = [(int(i), [float(x) for x in v], shard) for i, v in zip(ids, features, strict=True)]
    return spark.createDataFrame(rows, "image_id long, vector array<float>, shard_id int")


def discover_npy(root: str, feature: str) -> list[int]:
    """Numbers of the exchanged shards of a feature."""
    at = os.path.join(root, feature)
    names = os.listdir(at) if os.path.isdir(at) else []
    found = sorted(int(n[6:]) for n in names if n.startswith("shard_") and n[6:].isdigit() and len(n) >= 10)
    if not found:
        raise FileNotFoundError(f"no shard in {at}")
    return found
