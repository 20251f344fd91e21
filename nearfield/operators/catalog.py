"""The catalog of items: versioned Parquet, one row for each path.

A write makes a new version folder and then a pointer file, so readers see
whole versions only, and the path being read is never overwritten. Ids are
never given twice: the greatest id ever given is kept beside the version.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield import schemas
from nearfield.functions import scalars as S

_DATA = ("width", "height", "ext", "bytes", "added_at")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.root}/versions/{n}/state/_SUCCESS")))

    def init(self) -> Catalog:
        """Makes an empty catalog if there is none."""
        if not self.versions():
            self._write(self.spark.createDataFrame([], schemas.CATALOG), 0)
        return self

    def _write(self, rows: DataFrame, high: int) -> None:
        version = max(self.versions(), default=0) + 1
        folder = f"{self.root}/versions/{version}"
        rows.select(*schemas.CATALOG.names).write.mode("overwrite").parquet(f"{folder}/rows")
        # the state's commit makes the version count
        self.spark.createDataFrame([(high,)], "high long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state")

    def _at(self, version: int | None = None) -> str:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no catalog in {self.root}")
        return f"{self.root}/versions/{version or versions[-1]}"

    def rows(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(schemas.CATALOG).parquet(f"{self._at(version)}/rows")

    def _high(self) -> int:
        return self.spark.read.schema("high long").parquet(f"{self._at()}/state").first()["high"]

    def upsert(self, items: DataFrame) -> None:
        """Inserts paths that are new and updates those that are known, whose ids stay."""
        high = self._high()
        rows = upserted(self.rows(), items, high)
        self._write(rows, max(high, rows.agg(F.max("image_id")).first()[0] or 0))

    def ingest(self, found: DataFrame) -> int:
        """Adds paths not seen before; known rows stay as they are. Returns how many."""
        fresh = new_paths(found, self.rows()).cache()
        n = fresh.count()
        if n:
            self.upsert(fresh)
        fresh.unpersist()
        return n

    def delete(self, *, ids: Sequence[int] = (), paths: Sequence[str] = ()) -> None:
        """What is not there is no error."""
        high = self._high()
        self._write(deleted(self.rows(), ids=ids, paths=paths), high)

    def count(self) -> int:
        return self.rows().count()

    def by_id(self, image_id: int) -> dict | None:
        row = self.rows().filter(F.col("image_id") == image_id).first()
        return row.asDict() if row else None

    def by_path(self, path: str) -> dict | None:
        row = self.rows().filter(F.col("path") == path).first()
        return row.asDict() if row else None

    def path_of(self, image_id: int) -> str | None:
        row = self.rows().filter(F.col("image_id") == image_id).select("path").first()
        return row["path"] if row else None

    def any_path(self) -> str | None:
        row = self.rows().select("path").limit(1).first()
        return row["path"] if row else None

    def ids(self) -> DataFrame:
        return self.rows().select("image_id")

    def paths(self) -> DataFrame:
        return self.rows().select("path")

    def slice(self, start: int = 0, stop: int | None = None) -> DataFrame:
        return slice_by_id(self.rows().select("image_id", "path"), start, stop)


def upserted(known: DataFrame, items: DataFrame, high: int) -> DataFrame:
    """Known rows with the items' values by path; new paths get ids above `high` in path order.

    Of items that repeat a path one stays. Columns that items lack become null.
    """
    have = set(items.columns)
    fields = {f.name: f.dataType for f in schemas.CATALOG}
    items = items.select("path", *[(F.col(c) if c in have else F.lit(None)).cast(fields[c]).alias(f"_{c}") for c in _DATA]).withColumn("_new", F.lit(True)).dropDuplicates(["path"])
    both = known.join(items, "path", "full")
    take = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _DATA]
    old = both.filter("image_id is not null").select("image_id", "path", *take)
    fresh = both.filter("image_id is null").select("path", *take)
    return old.unionByName(numbered(fresh, "path", high + 1).withColumnRenamed("position", "image_id"))


def numbered(rows: DataFrame, order: str, first: int = 0) -> DataFrame:
    """position: `first`, `first` + 1, ... in order.

    Rows are dealt into ranges, numbered within each, and moved up by the
    counts of the ranges before, which are few; no task gets all rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    dealt = dealt.persist()
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, first
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    if not counts:
        return rows.withColumn("position", F.lit(0).cast("long")).limit(0)
    base = F.create_map(*[x for p, b in before.items() for x in (F.lit(p), F.lit(b))])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("position", (F.element_at(base, F.col("_part")) + place).cast("long")).drop("_part")


def deleted(rows: DataFrame, *, ids: Sequence[int] = (), paths: Sequence[str] = ()) -> DataFrame:
    out = rows
    if ids:
        out = out.filter(~F.col("image_id").isin(list(ids)))
    if paths:
        out = out.filter(~F.col("path").isin(list(paths)))
    return out


def new_paths(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("path"), "path", "left_anti")


def slice_by_id(rows: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Positions start to stop (exclusive) in id order."""
    if start < 0 or (stop is not None and stop < start):
        raise ValueError(f"a slice needs 0 <= start <= stop, not {start} and {stop}")
    out = rows.orderBy("image_id").offset(start)
    return out if stop is None else out.limit(stop - start)


def resolved(results: DataFrame, paths: DataFrame, *, missing: str = "error") -> DataFrame:
    """Results (rank, image_id, ...) with their paths, null or an error where there is none."""
    out = results.join(paths.select("image_id", "path"), "image_id", "left")
    if missing == "error":
        lost = F.raise_error(F.concat(F.lit("no path for image "), F.col("image_id").cast("string")))
        return out.withColumn("path", F.coalesce("path", lost.cast("string")))
    return out


def id_map(text: DataFrame) -> DataFrame:
    """image_id, path from rows of JSON objects {"id": "name"}."""
    return text.select(F.explode(S.json_map(F.col("json"))).alias("k", "path")).select(F.col("k").cast("long").alias("image_id"), "path")


def missing_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.join(known.select("image_id"), "image_id", "left_anti")


def pilot_rows(pilot: DataFrame, catalog: DataFrame, policy: str = "skip") -> DataFrame:
    """position, image_id, path of pilot ids; ids without a row are skipped or an error."""
    out = pilot.join(catalog.select("image_id", "path"), "image_id", "left")
    if policy == "skip":
        return out.filter("path is not null").select("position", "image_id", "path")
    if policy != "raise":
        raise ValueError("policy is skip or raise")
    lost = F.raise_error(F.concat(F.lit("no row for image "), F.col("image_id").cast("string")))
    return out.select("position", "image_id", F.coalesce("path", lost.cast("string")).alias("path"))


def sample_ids(catalog: DataFrame, n: int, seed: int = 42) -> list[int]:
    """n ids by the standard library's generator over the ids in order; ids are collected, so for small catalogs."""
    ids = [r[0] for r in catalog.select("image_id").orderBy("image_id").collect()]
    if n > len(ids):
        raise ValueError(f"{n} of {len(ids)} ids can't be drawn")
    return random.Random(seed).sample(ids, n)


def sample_by_hash(catalog: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows, always the same for a seed, whatever the catalog's size."""
    return catalog.orderBy(F.xxhash64("image_id", F.lit(seed)), "image_id").limit(n)


def even_split(rows: DataFrame, parts: int, order: str = "image_id") -> DataFrame:
    """part, start, stop of contiguous parts whose sizes differ by one at most; empty ones too."""
    if parts <= 0:
        raise ValueError("parts must be positive")
    n = rows.count()
    size, more = divmod(n, parts)
    i = F.col("id")
    return rows.sparkSession.range(parts).select(i.cast("int").alias("part"), (i * size + F.least(i, F.lit(more))).alias("start"), ((i + 1) * size + F.least(i + 1, F.lit(more))).alias("stop"))


def split_range(items: int, parts: int, index: int) -> tuple[int, int]:
    """The same for one part, by arithmetic alone."""
    if items < 0 or parts <= 0 or not 0 <= index < parts:
        raise ValueError(f"no part {index} of {parts} of {items} items")
    size, more = divmod(items, parts)
    start = index * size + min(index, more)
    return start, start + size + (index < more)


def fixed_shards(rows: DataFrame, size: int, order: str = "image_id") -> DataFrame:
    """Adds shard_id: position in order, divided by the size."""
    if size <= 0:
        raise ValueError("a shard's size must be positive")
    return numbered(rows, order).withColumn("shard_id", F.floor(F.col("position") / size).cast("int")).drop("position")
