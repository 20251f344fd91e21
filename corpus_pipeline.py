"""From raw documents to token files: five stages, each a table that the next one reads.

Every stage but the last returns the columns of documents; what a stage
rejects is gone for those after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import quality as classifier
from nearfield.llm.common import Scratch, read_table
from nearfield.llm.decontaminate import decontaminated
from nearfield.llm.minhash import one_of_each
from nearfield.llm.mixing import mix_copies, source_targets
from nearfield.llm.queries import tokenizer_path
from nearfield.llm.tokenfile import write_and_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, does not reject."""
    model = classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return classifier.good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by id, null ids last.

    A row is known by its id and text: rows without an id, and different texts
    of one id, are documents of their own; rows that repeat both are one.
    """
    return one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, a row for each copy."""
    mixed = mix_copies(docs, targets_of=lambda sums: [source_targets(sums[0])])
    copies = mixed.columns[-1]
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias("_copy")).drop("_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: doc_id, start, n_tokens, ids_crc32."""
    return write_and_read(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't express the classifier, the templates or the coder. tests/llm/test_pipeline.py holds the stages against plain
#: Python: all but decontamination (verbatim items only) and the mix (copies near the rate, words near the target) exactly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
