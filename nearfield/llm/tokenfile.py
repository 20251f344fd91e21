"""Token ids of a corpus in compressed files, in the order of document ids.

Documents are dealt into ranges of (id, hash of the text), as many as there
are shuffle partitions, and more where a range would have over `FILE_BYTES` of
text; each range is one task and one file, sorted, encoded and written as it
streams by. So rows of one id, or of null ids, don't meet in one task. A file:
magic and version; blocks of the range coder (see idcoder), each independent
and checksummed; the documents' ids and lengths (a zstd frame); the frame's
place and size, the number of blocks, and the magic again. Blocks do not stop
at documents' ends; lengths tell the documents apart.

Tasks write under names of their own attempt, and the table of files, written
once by Spark, names only those of attempts that succeeded.

Nulls and others: a null text is empty and has the end id only; rows with a
null id come last; rows with one id are ordered by a hash of the text, then by
the text; an empty table gives an empty result; other columns are not read.
Token ids are below 2^32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release
from .idcoder import BLOCK, HEAD, HEAD_SIZE, decode_block, encode_block
from .tokens import PieceEncoder
from .words import batches

MAGIC, VERSION = b"NFIDFILE", 1
_FOOT = "<QQI8s"
_FOOT_SIZE = 28
END = 2
#: Bytes of text that a file holds on average, at most.
FILE_BYTES = 128 << 20
#: Bytes of text that are encoded at once.
SLICE = 2 << 20


class FileWriter:
    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.parts: list[np.ndarray] = []
        self.held, self.at, self.blocks = 0, 0, 0
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self._write(MAGIC + struct.pack("<I", VERSION))

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents (ids int64, the least int64 for null), their lengths, and all their token ids."""
        self.docs.append(docs.astype(np.int64))
        self.sizes.append(sizes.astype(np.uint32))
        self.parts.append(ids)
        self.held += len(ids)
        while self.held >= self.block:
            self._flush(self.block)

    def _flush(self, n: int) -> None:
        whole = np.concatenate(self.parts)
        self._write(encode_block(whole[:n]))
        self.blocks += 1
        self.parts, self.held = [whole[n:]], len(whole) - n

    def close(self) -> None:
        import zstandard

        if self.held:
            self._flush(self.held)
        docs, sizes = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((self.docs, np.int64), (self.sizes, np.uint32)))
        place, index = self.at, zstandard.compress(struct.pack("<Q", len(docs)) + np.diff(docs, prepend=0).astype("<i8").tobytes() + sizes.astype("<u4").tobytes())
        self._write(index + struct.pack(_FOOT, place, len(index), self.blocks, MAGIC))
        self.out.close()


def read_file(source):
    """Yields (documents, sizes, ids) of a run of whole documents; every block's checksum is checked."""
    import zstandard

    end = source.size()
    source.seek(end - _FOOT_SIZE)
    place, size, blocks, magic = struct.unpack(_FOOT, source.read(_FOOT_SIZE))
    source.seek(0)
    if magic != MAGIC or source.read(len(MAGIC) + 4) != MAGIC + struct.pack("<I", VERSION):
        raise ValueError("not a file of token ids")
    source.seek(place)
    index = zstandard.decompress(source.read(size))
    (count,) = struct.unpack_from("<Q", index)
    docs = np.cumsum(np.frombuffer(index, dtype="<i8", count=count, offset=8))
    sizes = np.frombuffer(index, dtype="<u4", count=count, offset=8 + 8 * count).astype(np.int64)
    ends, done, taken, held = np.cumsum(sizes), 0, 0, np.zeros(0, dtype=np.uint32)
    source.seek(len(MAGIC) + 4)
    for _ in range(blocks):
        head = source.read(HEAD_SIZE)
        held = np.concatenate([held, decode_block(head + source.read(struct.unpack(HEAD, head)[2]))])
        upto = int(np.searchsorted(ends, taken + len(held), side="right"))
        if upto > done:
            n = int(ends[upto - 1]) - taken
            yield docs[done:upto], sizes[done:upto], held[:n]
            held, taken, done = held[n:], taken + n, upto
    if done != count or len(held):
        raise ValueError("a file's lengths are wrong")


_NULL = np.iinfo(np.int64).min


def write_tokens(docs: DataFrame, path: str, folder: str, scratch: Scratch, *, key: str = "doc_id", text: str = "text", end: int = END) -> list[tuple[str, int, int]]:
    """Writes the files; returns (name, documents, ids) of each, in order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    held = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))
    order = [F.col("k").asc_nulls_last(), "h"]
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "t").drop("h")

    def write(stream):
        encoder = PieceEncoder.of(path)
        task = TaskContext.get()
        place, base = pafs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        writer, docs, total = FileWriter(place.open_output_stream(f"{base}/{name}", compression=None)), 0, 0
        for whole in stream:
            for batch in batches(whole, "t", SLICE):
                ids, offsets = encoder.encode(batch.column("t"))
                sizes = np.diff(offsets) + 1
                ended = np.full(int(sizes.sum()), end, dtype=np.uint32)
                inside = np.ones(len(ended), dtype=bool)
                inside[np.cumsum(sizes) - 1] = False
                ended[inside] = ids
                keys = batch.column("k").fill_null(_NULL).to_numpy(zero_copy_only=False)
                writer.add(keys, sizes, ended)
                docs, total = docs + len(batch), total + len(ended)
        writer.close()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "name", "docs", "ids"])

    files = scratch.table(dealt.mapInArrow(write, "part int, name string, docs long, ids long"), "files")
    return [(r["name"], r["docs"], r["ids"]) for r in sorted(files.collect(), key=lambda r: r["part"])]


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]], folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files; one task for each."""
    starts = np.concatenate(([0], np.cumsum([n for _, _, n in files]))).tolist()
    names = [n for n, _, _ in files]

    def read(stream):
        place, base = pafs.FileSystem.from_uri(folder)
        for batch in stream:
            for i in batch.column("id").to_pylist():
                start = starts[i]
                with place.open_input_file(f"{base}/{names[i]}") as source:
                    for docs, sizes, ids in read_file(source):
                        ends = np.cumsum(sizes)
                        raw = ids.astype("<u4").tobytes()
                        crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        keys = pa.array(docs, mask=docs == _NULL)
                        yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += len(ids)
        release()

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = f"{scratch.root}/ids"
    files = write_tokens(docs, path, folder, scratch)
    return read_tokens(docs.sparkSession, files, folder)
