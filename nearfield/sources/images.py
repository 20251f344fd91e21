"""Image files: scans, decoding with an error for each bad file, and iteration by catalog, pilot list or folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import scalars as S
from nearfield.operators import catalog as C

_EMPTY = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def local_path(uri: Column) -> Column:
    """Without the scheme of a local file."""
    return F.regexp_replace(uri, "^file:/+", "/")


def scan(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """path, bytes, modified, ext of all files below a folder that have an extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(root)
    out = files.select(local_path(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    out = out.withColumn("ext", S.extension(F.col("path")))
    return out if extensions is None else out.filter(S.has_extension(F.col("path"), extensions))


def decode(spark: SparkSession, root: str) -> DataFrame:
    """path, image of all files below a folder; the height is -1 for what isn't an image that the JVM can read."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    return found.select(local_path(F.col("image.origin")).alias("path"), "image")


def status(image: Column, present: Column) -> Column:
    """ok, or why there is no image: missing, unreadable, shape."""
    channels = image["nChannels"].isin(1, 3, 4)
    return F.when(~present, "missing").when(image["height"] <= 0, "unreadable").when(~channels, "shape").otherwise("ok")


def load(paths: DataFrame, images: DataFrame, policy: str = "skip") -> DataFrame:
    """The rows of paths (path, ...) with image and status.

    policy: "skip" keeps what is ok; "raise" stops at a bad file, naming it and
    why; "keep" keeps all.
    """
    if policy not in ("skip", "raise", "keep"):
        raise ValueError("policy is skip, raise or keep")
    there = images.select("path", "image", F.lit(True).alias("_there"))
    out = paths.join(there, "path", "left").withColumn("status", status(F.col("image"), F.coalesce("_there", F.lit(False)))).drop("_there")
    if policy == "skip":
        return out.filter("status = 'ok'")
    if policy == "raise":
        bad = F.raise_error(F.concat(F.lit("cannot load "), F.col("path"), F.lit(": "), F.col("status")))
        return out.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(bad.cast("string")))
    return out


def failures(paths: DataFrame, images: DataFrame) -> DataFrame:
    """path and status of what can't be loaded: the log of a skipping run."""
    return load(paths, images, "keep").filter("status <> 'ok'").select("path", "status")


def samples(spark: SparkSession, root: str, extensions=("jpg", "jpeg", "png"), limit: int | None = None) -> DataFrame:
    """image_id (rank by name, from 0), path, name of the files right in a folder."""
    files = spark.read.format("binaryFile").load(root).select(local_path(F.col("path")).alias("path"))
    files = files.filter(S.has_extension(F.col("path"), extensions)).withColumn("name", S.file_name(F.col("path")))
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        files = files.orderBy("name").limit(limit)
    return C.numbered(files, "name").select(F.col("position").alias("image_id"), "path", "name")


def catalog_rows(images: DataFrame, files: DataFrame) -> DataFrame:
    """Rows to ingest: path, width, height, ext, bytes, added_at of readable images."""
    good = images.filter(F.col("image.height") > 0).select("path", F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    return files.join(good, "path").select("path", "width", "height", "ext", "bytes", F.current_timestamp().alias("added_at"))


def from_catalog(catalog: DataFrame, images: DataFrame, start: int = 0, stop: int | None = None, policy: str = "skip") -> DataFrame:
    """image_id, path, image, status of a slice of the catalog in id order."""
    return load(C.slice_by_id(catalog.select("image_id", "path"), start, stop), images, policy)


def from_pilot(pilot: DataFrame, catalog: DataFrame, images: DataFrame, start: int = 0, stop: int | None = None, policy: str = "skip") -> DataFrame:
    """position, image_id, path, image, status of pilot ids at positions start to stop."""
    if start < 0 or (stop is not None and stop < start):
        raise ValueError(f"a slice needs 0 <= start <= stop, not {start} and {stop}")
    chosen = pilot.filter(F.col("position") >= start)
    if stop is not None:
        chosen = chosen.filter(F.col("position") < stop)
    return load(C.pilot_rows(chosen, catalog, policy), images, policy)


def from_samples(spark: SparkSession, root: str, policy: str = "skip", start: int = 0, stop: int | None = None) -> DataFrame:
    """image_id, path, name, image, status of the files of a folder."""
    listed = samples(spark, root).filter(F.col("image_id") >= start)
    if stop is not None:
        listed = listed.filter(F.col("image_id") < stop)
    return load(listed, decode(spark, root), policy)
