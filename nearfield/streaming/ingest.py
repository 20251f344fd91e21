"""Streaming extensions: files that arrive become catalog rows; queries that arrive get answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.functions import distances as D
from nearfield.functions import scalars as S
from nearfield.operators import search
from nearfield.operators.catalog import Catalog
from nearfield.operators.search import ranked
from nearfield.sources.images import local_path

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, extensions=S.IMAGE_EXTENSIONS) -> DataFrame:
    """path, bytes, ext, added_at of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(root)
    out = files.select(local_path(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.current_timestamp().alias("added_at"))
    return out.withColumn("ext", S.extension(F.col("path"))).filter(S.has_extension(F.col("path"), extensions))


def ingest_stream(files: DataFrame, catalog: Catalog, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Adds unseen paths to the catalog; a batch that is sent again adds nothing."""
    catalog.init()
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: catalog.ingest(rows) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()


def answer_stream(queries: DataFrame, features: DataFrame, k: int, checkpoint: str, sink, metric: str = "cosine", *, once: bool = True) -> StreamingQuery:
    """For each batch of queries (query_id, vector): sink(rows of query_id, rank, image_id, distance, batch number).

    A batch of more than `MAX_QUERIES` is dealt into parts by a hash of the
    id, a scan of the features for each, so a scan broadcasts about `MAX_QUERIES` queries.
    """

    def answer(batch: DataFrame, number: int) -> None:
        parts = max(1, -(-batch.count() // search.MAX_QUERIES))
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        scans = [search.distances_to(features, batch.filter(part == i) if parts > 1 else batch, metric) for i in range(parts)]
        rows = reduce(DataFrame.unionByName, scans).filter(D.is_finite(F.col("distance")))
        sink(ranked(rows, "distance", ["query_id"], k).select("query_id", "rank", "image_id", "distance"), number)

    writer = queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    return (writer.trigger(availableNow=True) if once else writer).start()
