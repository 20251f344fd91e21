"""Token counts kept as delta-maintained rollups.

Totals by (source, lang, tokenizer version) are sums, so every change is a
signed row: an insert adds a document's counts, a delete subtracts them, a
revision subtracts the old and adds the new. `Rollup.commit` folds a batch's
signed rows into a few rows by group and writes them as one Parquet folder
named by the batch; the folder counts from the moment its job commits, so a
batch is there wholly or not at all, and a batch that is sent again is left as
it is. `compact` folds committed batches into a base table that names them.

Nulls and others: a null text has 0 tokens; null sources and languages are
groups of their own; repeated rows count each time; groups whose documents
and tokens are all gone are left out of `totals`; empty batches commit.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import word_count
from .tokens import PieceEncoder
from .words import batches

GROUP = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
WORDS = "words"


def count_tokens(docs: DataFrame, version: str, path: str | None = None, *, text: str = "text") -> DataFrame:
    """doc_id, source, lang, version, tokens of every row.

    path: a tokenizer file of the tokenizers library whose pre-tokenizer drops
    white space; None counts words `[^\\x20\\x09-\\x0D]+`.
    """
    few = docs.select("doc_id", "source", "lang", F.col(text).alias("text"))
    if path is None:
        return few.select("doc_id", "source", "lang", F.lit(version).alias("version"), word_count(F.col("text")).alias("tokens"))

    def count(stream):
        encoder = PieceEncoder.of(path)
        for whole in stream:
            for batch in batches(whole, "text", 8 << 20):
                tokens = encoder.counts(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([version] * len(batch)), pa.array(tokens)], ["doc_id", "source", "lang", "version", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(count, f"doc_id {kind}, source string, lang string, version string, tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as signed rows by group: +1 for inserts, -1 for deletes."""
    return counts.groupBy(*GROUP).agg((F.count(F.lit(1)) * sign).alias("docs"), (F.sum("tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change from old counts to new ones; documents need not be matched."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{folder}/_SUCCESS"))

    def _folders(self, kind: str) -> dict[str, str]:
        """Committed folders of a kind, by name."""
        at = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(at):
            return {}
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return {n: f"{self.root}/{kind}/{n}" for n in sorted(names) if self._done(f"{self.root}/{kind}/{n}")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch's signed rows once; False if the batch was there before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch id has letters, digits, _, . and - only: {batch!r}")
        folder = f"{self.root}/delta/{batch}"
        if self._done(folder) or batch in self._compacted()[1]:
            return False
        rows = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rows.filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(folder)
        return True

    def _compacted(self) -> tuple[str | None, set[str]]:
        bases = self._folders("base")
        if not bases:
            return None, set()
        last = bases[max(bases, key=lambda n: int(n))]
        names = self.spark.read.schema("batch string").parquet(f"{last}/batches") if self._fs.exists(self._path(f"{last}/batches")) else None
        return f"{last}/totals", {r[0] for r in names.collect()} if names else set()

    def batches(self) -> list[str]:
        """Committed batches, compacted ones included."""
        return sorted({*self._folders("delta"), *self._compacted()[1]})

    def _rows(self) -> tuple[DataFrame, set[str]]:
        base, inside = self._compacted()
        deltas = self._folders("delta")
        paths = [*([base] if base else []), *(p for n, p in deltas.items() if n not in inside)]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows, inside | set(deltas)

    def totals(self) -> DataFrame:
        rows, _ = self._rows()
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into a new base; readers keep the old one until it is complete."""
        _, inside = self._rows()
        bases = self._folders("base")
        folder = f"{self.root}/base/{max(map(int, bases), default=0) + 1}"
        self.totals().write.mode("overwrite").parquet(f"{folder}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(inside)], "batch string").write.mode("overwrite").parquet(f"{folder}/batches")
        self._fs.create(self._path(f"{folder}/_SUCCESS"), True).close()


def distinct_lines(text: Column) -> Column:
    """The text with each line once, in first order."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
