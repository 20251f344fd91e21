"""Approximate search: candidates from an index, then exact distances.

`SignKeys` is a forest of random-hyperplane signatures: T tables, each with
`depth` hyperplanes; a vector's key in a table is which side of each it lies
on. Equal keys are an equi-join on (table, key). `Cells` are k-means cells, of
which the nearest few are read: a partition column, so cells not asked for
are not scanned. `BucketedLSH` is the one that ships with Spark, as a baseline.

Many queries go by blocks: vectors are packed where they lie, and every part of
the queries meets every part of the rows in one task. A row is a candidate of a
query if it has a key that the query asks for. Keys follow from vectors, so
tasks make them; as a matrix product is cheaper than a join on keys that most
pairs share, a task first leaves out the pairs farther than the k candidates it
has, and then joins the others on keys. It keeps k rows a query, whatever number
of blocks it reads: candidate pairs and keys are never rows of a table.

Indexes are Parquet folders with a manifest; an index whose parameters or
input shards changed is built anew by `refresh`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.operators.knn import _kernel
from nearfield.operators.search import check_k, nonzero, ranked, top_k

#: Values of a block of vectors, rows of it at most, queries compared at once, pairs compared exactly at once.
VALUES, ROWS, STEP, PAIRS = 1 << 19, 8192, 2048, 1 << 15
#: Rows and queries of a matrix product that stays in a core's cache.
TILE, WIDE = 256, 512
#: Rows are dealt into so many parts, fewer if many queries make `TASKS` anyhow, and more where a part would have over `DEPTH` blocks.
ROW_PARTS, TASKS, DEPTH = 16, 96, 128
#: Of more than `MANY` rows about `FIRST` are met before the others, so that tasks know from the start how near a row has to be.
MANY, FIRST = 1 << 17, 1 << 14


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class _Index:
    kind = ""

    def __init__(self, features: DataFrame, metric: str, **params):
        if metric not in D.INDEX_METRICS:
            raise ValueError(f"an index takes one of {D.INDEX_METRICS}, not {metric!r}")
        self.spark, self.metric, self.params = features.sparkSession, metric, params
        self.rejected = 0
        self.given, self.features = features, nonzero(features)
        self.shards: list = []

    def manifest(self) -> dict:
        return {"kind": self.kind, "metric": self.metric, "dim": self.dim, "num_vectors": self.num_vectors, "shards": self.shards} | self.params

    def build(self, shards: Sequence = ()):
        """Rows with zero vectors stay out; `rejected` counts them."""
        self.shards = sorted(shards)
        row = self.features.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
        self.num_vectors, self.dim = row["n"], row["d"] or 0
        if not self.num_vectors:
            raise ValueError("there is no vector to index")
        return self

    def save(self, path: str) -> None:
        """The index table, then the manifest: without one the folder does not count."""
        self.table.write.mode("overwrite").partitionBy(*self.partitions).parquet(f"{path}/table")
        self.spark.createDataFrame([(json.dumps(self.manifest(), sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        self.table = self.spark.read.schema(self.table.schema).parquet(f"{path}/table")

    def stale(self, path: str, shards: Sequence = ()) -> bool:
        if not _exists(self.spark, f"{path}/manifest/_SUCCESS"):
            return True
        said = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])
        mine = {"kind": self.kind, "metric": self.metric, "shards": sorted(shards)} | self.params
        return any(said.get(k) != v for k, v in json.loads(json.dumps(mine)).items())

    def refresh(self, path: str, shards: Sequence = ()) -> bool:
        """Loads the saved index, or builds and saves it; True if it was built."""
        if self.stale(path, shards):
            self.build(shards).save(path)
            return True
        said = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])
        self.shards, self.dim, self.num_vectors = said["shards"], said["dim"], said["num_vectors"]
        self.load(path)
        return False

    def load(self, path: str) -> None:
        self.table = self.spark.read.parquet(f"{path}/table")

    def search(self, query: Sequence[float], k: int, on_short: str = "clamp") -> DataFrame:
        """rank, image_id, distance of the k nearest candidates."""
        if check_k(k) > self.num_vectors and on_short == "error":
            raise ValueError(f"k = {k} is more than the {self.num_vectors} vectors in the index")
        values = D.check_query(query, self.dim)
        rows = self.features.join(self.candidates(values), "image_id", "left_semi")
        d = D.metric(self.metric)(D.vector(values), D.doubles(F.col("vector")))
        return top_k(rows.select("image_id", d.alias("distance")), k, on_short=on_short)

    def _coders(self) -> tuple[Callable, Callable]:
        """Two functions from vectors (a matrix) to codes, one row for each vector: those a row has, those a query asks for."""
        raise NotImplementedError

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, image_id, distance of the k nearest candidates of each row of a table (query_id, vector), block by block."""
        check_k(k)
        size = max(1, min(ROWS, VALUES // max(1, self.dim)))
        parts, blocks = max(1, -(-queries.count() // size)), -(-self.num_vectors // size)
        # queries are dealt evenly, then packed, then each part is moved as a whole
        asking = _blocks(queries.withColumnRenamed("query_id", "image_id").repartition(parts), size)
        asking = asking.select(*[F.col(c).alias(f"q_{c}") for c in asking.columns], F.lit(b"").alias("q_edges"))
        (has, asks), metric, dim = self._coders(), self.metric, self.dim

        def nearest(qi, qv, qe):
            ids, q = _unpacked(qi, qv, dim)
            edges = np.frombuffer(qe.as_buffer()) if len(qe.as_buffer()) else np.full(len(ids), np.inf)
            parts = [slice(at, at + STEP) for at in range(0, len(ids), STEP)]
            return [_Nearest(ids[some], q[some].astype(float), asks(q[some].astype(float)), k, metric, edges[some]) for some in parts]

        def meet(stream):
            """The queries (ids, vectors), and those nearest to them in all row blocks of the stream."""
            held: dict[bytes, tuple] = {}
            last = rows = None
            for batch in stream:
                for ci, cv, qi, qv, qe in zip(*batch.columns, strict=True):
                    if (name := qi.as_py()) not in held:
                        held[name] = qv.as_py(), nearest(qi, qv, qe)
                    if rows is None or last != (ci, cv):
                        last, rows = (ci, cv), _Rows(*_unpacked(ci, cv, dim), has, metric)
                    for some in held[name][1]:
                        some.add(rows)
            return held

        if self.num_vectors > MANY:
            first = nonzero(self.given.filter(F.pmod(F.xxhash64("image_id"), F.lit(self.num_vectors // FIRST)) == 0))

            def edges(stream):
                for name, (vectors, parts) in meet(stream).items():
                    edge = np.concatenate([part.edge for part in parts])
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (name, vectors, edge.tobytes())], ["q_ids", "q_vectors", "q_edges"])

            asking = _blocks(first, size).repartition(1).crossJoin(asking).mapInArrow(edges, "q_ids binary, q_vectors binary, q_edges binary")
        # a part for each block, whether they lie in one partition or in many
        asking = asking.repartitionById(parts, ((F.spark_partition_id() + F.monotonically_increasing_id() % (1 << 33)) % parts).cast("int"))
        # rows are the left side, which a task reads as a stream; it holds the right side
        pairs = _blocks(self.features, size).repartition(max(1, min(ROW_PARTS, blocks, -(-TASKS // parts)), -(-blocks // DEPTH))).crossJoin(asking)

        def run(stream):
            for _, some in meet(stream).values():
                for part in some:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in part.found()], ["query_id", "image_id", "distance"])

        found = pairs.mapInArrow(run, "query_id long, image_id long, distance double")
        return ranked(found, "distance", ["query_id"], k).select("query_id", "rank", "image_id", "distance")

    def admitted(self, query: Sequence[float]) -> float:
        """The share of rows that a query's candidates are."""
        return self.candidates(D.check_query(query, self.dim)).count() / self.num_vectors


def _code(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A table and a key in it as one number."""
    return (table << 48) + key


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """ids, vectors: rows (image_id, vector) packed where they lie, vectors as floats if that loses nothing."""

    def pack(stream):
        ids, vectors, held = [], [], 0

        def out(n):
            nonlocal ids, vectors, held
            i, v = np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [i[n:]], [v[n:]], held - n
            i, v = i[:n], v[:n]
            with np.errstate(over="ignore", invalid="ignore"):
                short = v.astype(np.float32)
            if np.array_equal(short, v, equal_nan=True):
                v = short
            return pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["ids", "vectors"])

        for batch in stream:
            if len(batch):
                ids.append(batch.column("image_id").to_numpy(zero_copy_only=False))
                vectors.append(_matrix(batch.column("vector")))
                held += len(batch)
                while held >= size:
                    yield out(size)
        if held:
            yield out(held)

    known = rows.filter("image_id is not null and vector is not null").select(F.col("image_id").cast("long").alias("image_id"), D.doubles(F.col("vector")).alias("vector"))
    return known.mapInArrow(pack, "ids binary, vectors binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unpacked(ids: pa.BinaryScalar, vectors: pa.BinaryScalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, as they were packed."""
    i, raw = np.frombuffer(ids.as_buffer(), dtype=np.int64), vectors.as_buffer()
    return i, np.frombuffer(raw, dtype=np.float32 if raw.size == 4 * dim * len(i) else float).reshape(len(i), dim)


def _meet(qi, qv, qc, qn, ci, cv, cc, cn, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row, distance of the k nearest rows that share a code with a query, ties by id: ids, vectors, codes and counts of both, one block each."""
    if not len(qi) or not len(ci):
        return qi[:0], ci[:0], np.zeros(0)
    has, asked = _rectangle(cc, cn, -1), _rectangle(qc, qn, -2)
    rows = _Rows(ci, cv.reshape(len(ci), -1), None, metric, has)
    q = qv.reshape(len(qi), -1)
    parts = [_Nearest(qi[at : at + STEP], q[at : at + STEP], asked[at : at + STEP], k, metric) for at in range(0, len(qi), STEP)]
    for part in parts:
        part.add(rows)
    return tuple(np.concatenate(x) for x in zip(*(part.found() for part in parts), strict=True))


def _rectangle(codes: np.ndarray, counts: np.ndarray, none: int) -> np.ndarray:
    """One row of codes for each count, filled up with a code that is none."""
    out = np.full((len(counts), max(1, int(counts.max(initial=0)))), none, dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < counts[:, None]] = codes
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size != 0)


class _Rows:
    """A block of rows: ids, vectors, and of those asked for the codes and the sizes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Callable | None, metric: str, codes: np.ndarray | None = None):
        self.ids, self.coder, self.codes = ids, coder, codes
        self.known = np.full(len(ids), codes is not None)
        if metric == "angular":
            self.vectors, self.unit, self.size = vectors, _short_unit(vectors), np.zeros(len(ids))
            self.sized = np.zeros(len(ids), dtype=bool)
            self.room = np.empty(TILE * WIDE, dtype=np.float32)
        else:
            self.vectors = vectors.astype(float)
            self.largest = _largest(self.vectors)

    def codes_of(self, some: np.ndarray) -> np.ndarray:
        """Made when first asked for; the rows in some differ."""
        new = some[~self.known[some]]
        if len(new):
            codes = self.coder(self.vectors[new].astype(float))
            if self.codes is None:
                self.codes = np.zeros((len(self.ids), codes.shape[1]), dtype=np.int64)
            self.codes[new], self.known[new] = codes, True
        return self.codes[some]

    def sizes_of(self, some: np.ndarray) -> np.ndarray:
        new = np.unique(some[~self.sized[some]])
        self.size[new], self.sized[new] = _sizes(self.vectors[new].astype(float)), True
        return self.size[some]


def _short_unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1 as floats; zeros stay zeros."""
    with np.errstate(all="ignore"):
        size = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=float))[:, None]
        return np.divide(m, np.where(size == 0, 1.0, size)).astype(np.float32)


def _largest(m: np.ndarray) -> float:
    with np.errstate(over="ignore", invalid="ignore"):
        return float(np.sqrt(np.max((m * m).sum(1), where=np.isfinite(m).all(1), initial=0.0)))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.nonzero, for masks with few that are true: eight at once are looked at first."""
    if mask.size % 8:
        return np.nonzero(mask)
    flat = mask.reshape(-1)
    eights = np.flatnonzero(flat.view(np.uint64))
    eight, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(eights[eight] * 8 + place, max(1, mask.shape[1]))


class _Nearest:
    """Queries, and of all rows added the k nearest that share a code with each, ties by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int, metric: str, edge: np.ndarray | None = None):
        """edge: distances within which k candidates of each are known to be, if any are."""
        self.ids, self.q, self.k, self.metric = ids, vectors, k, metric
        self.seen = 0 if edge is None or np.isinf(edge).all() else FIRST
        self.codes, at = np.unique(asked, return_inverse=True)
        # which codes a query asks for; the last column stands for all codes that none asks for
        self.asks = np.zeros((len(ids), len(self.codes) + 1), dtype=bool)
        self.asks[np.arange(len(ids))[:, None], at.reshape(asked.shape)] = True
        self.x, self.y, self.d = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.edge = np.full(len(ids), np.inf) if edge is None else edge.copy()
        if metric == "angular":
            # turned, as the product with a tile then has a row of it for each row and its maxima go by columns
            unit = _short_unit(vectors)
            self.turned = [np.ascontiguousarray(unit[low : low + WIDE].T) for low in range(0, len(unit), WIDE)]
            self.size = _sizes(vectors)
        else:
            self.kernel, self.largest = _kernel(metric), _largest(vectors)

    def add(self, rows: _Rows) -> None:
        at = 0
        while at < len(rows.ids):
            # few at first: they tell how near the others have to be
            upto = min(len(rows.ids), at + max(16, self.seen))
            x, y = self._near(rows, slice(at, upto))
            for low in range(0, len(x), PAIRS):
                self._take(rows, x[low : low + PAIRS], y[low : low + PAIRS] + at)
            self.seen += upto - at
            at = upto

    def _near(self, rows: _Rows, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be nearer than the k-th; the matrix product rounds in other ways than the distance itself, so what is about that near stays in the running."""
        with np.errstate(all="ignore"):
            if self.metric == "angular":
                return self._alike(rows, part)
            far = self.kernel(self.q, rows.vectors[part]) > (self.edge + 1e-6 * max(1.0, self.largest, rows.largest))[:, None]
        return _places(~far)

    def _alike(self, rows: _Rows, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """By tiles that stay in the cache: most queries' nearest row of a tile is too far already, so only the others' columns are looked at."""
        rounding = 3e-7 * (self.q.shape[1] + 8)
        least = (1 - self.edge * self.edge / 2 - rounding).astype(np.float32)
        xs, ys = [], []
        for i, turned in enumerate(self.turned):
            low, n = i * WIDE, turned.shape[1]
            for at in range(part.start, part.stop, TILE):
                unit = rows.unit[at : min(at + TILE, part.stop)]
                alike = np.matmul(unit, turned, out=rows.room[: len(unit) * n].reshape(len(unit), n))
                some = np.flatnonzero(~(alike.max(axis=0) < least[low : low + n]))
                if len(some):
                    x, y = np.nonzero(~(alike[:, some].T < least[low + some, None]))
                    xs.append(low + some[x])
                    ys.append(y + (at - part.start))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *xs]), np.concatenate([none, *ys])

    def _take(self, rows: _Rows, x: np.ndarray, y: np.ndarray) -> None:
        own, place = np.unique(y, return_inverse=True)
        codes = rows.codes_of(own)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at[self.codes[at] != codes] = len(self.codes)
        met = self.asks[x[:, None], at[place]].any(1)
        x, y = x[met], y[met]
        if not len(x):
            return
        with np.errstate(all="ignore"):
            sizes = self.size[x] * rows.sizes_of(y) if self.metric == "angular" else None
        d = _exact(self.metric, self.q[x], rows.vectors[y], sizes)
        changed = np.zeros(len(self.ids), dtype=bool)
        changed[x] = True
        old = changed[self.x]
        held = [z[~old] for z in (self.x, self.y, self.d)]
        x, y, d = np.concatenate([self.x[old], x]), np.concatenate([self.y[old], rows.ids[y]]), np.concatenate([self.d[old], d])
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        last = rank == self.k - 1
        self.edge[x[last]] = np.minimum(self.edge[x[last]], d[last])
        self.x, self.y, self.d = (np.concatenate([h, z[rank < self.k]]) for h, z in zip(held, (x, y, d), strict=True))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.x], self.y, self.d


def _total(term: Callable, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One value after the other, which a running sum does and a plain one does not."""
    return np.cumsum(term(x, y), axis=1, dtype=float)[:, -1]


def _sizes(m: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(_total(np.multiply, m, m))


def _exact(metric: str, a: np.ndarray, b: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Of rows of a and b, as the column expressions add: one value after the other, so equal vectors tie; sizes: the norms' products, for angles."""
    terms = {"euclidean": lambda x, y: (x - y) * (x - y), "manhattan": lambda x, y: np.abs(x - y), "hamming": lambda x, y: (x != y).astype(float)}.get(metric, np.multiply)
    with np.errstate(all="ignore"):
        out = _total(terms, a, b)
        if metric == "euclidean":
            return np.sqrt(out)
        if metric == "dot":
            return -out
        if metric == "angular":
            return np.where(sizes == 0, np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * out / sizes)))
    return out


def _planes(dim: int, tables: int, depth: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, tables * depth))


def _sign_keys(vectors: np.ndarray, planes: np.ndarray, tables: int, depth: int) -> np.ndarray:
    sides = (vectors @ planes > 0).reshape(len(vectors), tables, depth)
    return sides @ (1 << np.arange(depth))


class SignKeys(_Index):
    kind, partitions = "signkeys", ["table"]

    def __init__(self, features: DataFrame, metric: str = "angular", tables: int = 32, depth: int = 6, seed: int = 42):
        super().__init__(features, metric, tables=tables, depth=depth, seed=seed)

    def keys(self, features: DataFrame) -> DataFrame:
        """image_id, table, key."""
        tables, depth, seed = (self.params[x] for x in ("tables", "depth", "seed"))

        def run(stream):
            for batch in stream:
                if len(batch):
                    v = np.asarray(batch.column("vector").to_pylist(), dtype=float)
                    keys = _sign_keys(v, _planes(v.shape[1], tables, depth, seed), tables, depth)
                    yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["image_id", "keys"])

        packed = features.select("image_id", "vector").mapInArrow(run, "image_id long, keys array<long>")
        return packed.select("image_id", F.posexplode("keys").alias("table", "key"))

    def build(self, shards: Sequence = ()):
        super().build(shards)
        self.table = self.keys(self.features)
        return self

    def candidates(self, query: list[float]) -> DataFrame:
        tables, depth, seed = (self.params[x] for x in ("tables", "depth", "seed"))
        keys = _sign_keys(np.array([query]), _planes(len(query), tables, depth, seed), tables, depth)[0].tolist()
        mine = self.spark.createDataFrame([(t, int(k)) for t, k in enumerate(keys)], "table int, key long")
        return self.table.join(F.broadcast(mine), ["table", "key"], "left_semi").select("image_id").distinct()

    def _coders(self) -> tuple[Callable, Callable]:
        """A query asks for its own key of a table and for those across one hyperplane."""
        tables, depth, seed = (self.params[x] for x in ("tables", "depth", "seed"))
        planes = _planes(self.dim, tables, depth, seed)
        probes = np.concatenate(([0], 1 << np.arange(depth)))

        def has(v):
            return _code(np.arange(tables), _sign_keys(v, planes, tables, depth))

        return has, lambda v: (has(v)[:, :, None] ^ probes).reshape(len(v), -1)


class Cells(_Index):
    kind, partitions = "cells", ["cell"]

    def __init__(self, features: DataFrame, metric: str = "angular", cells: int = 16, probes: int = 8, seed: int = 42):
        super().__init__(features, metric, cells=cells, probes=probes, seed=seed)

    def build(self, shards: Sequence = ()):
        super().build(shards)
        unit = self.features.select("image_id", array_to_vector(D.unit(D.doubles(F.col("vector")))).alias("unit"))
        model = KMeans(k=self.params["cells"], seed=self.params["seed"], featuresCol="unit", predictionCol="cell", maxIter=20).fit(unit)
        self.centers = [c.tolist() for c in model.clusterCenters()]
        self.table = model.transform(unit).select("image_id", "cell")
        return self

    def manifest(self) -> dict:
        return super().manifest() | {"centers": self.centers}

    def load(self, path: str) -> None:
        super().load(path)
        self.centers = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])["centers"]

    def candidates(self, query: list[float]) -> DataFrame:
        q = np.array(query) / np.linalg.norm(query)
        order = np.argsort(((np.array(self.centers) - q) ** 2).sum(1), kind="stable")
        return self.table.filter(F.col("cell").isin(order[: self.params["probes"]].tolist())).select("image_id")

    def _coders(self) -> tuple[Callable, Callable]:
        """A query asks for the nearest cells, a row is in the nearest."""
        centers, probes = np.array(self.centers), self.params["probes"]

        def nearest(v, n):
            unit = _unit(v)
            away = sum(np.square(unit[:, j, None] - centers[None, :, j]) for j in range(unit.shape[1]))
            return np.argsort(away, axis=1, kind="stable")[:, :n]

        return lambda v: nearest(v, 1), lambda v: nearest(v, probes)


class BucketedLSH(_Index):
    kind, partitions = "lsh", ["table"]

    def __init__(self, features: DataFrame, metric: str = "angular", bucket: float = 0.05, tables: int = 8, seed: int = 42):
        super().__init__(features, metric, bucket=bucket, tables=tables, seed=seed)

    def build(self, shards: Sequence = ()):
        super().build(shards)
        self._fit()
        self.table = self._hashes(self.features)
        return self

    def _fit(self) -> None:
        """The hyperplanes follow from the dimension and the seed alone."""
        self.model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=self.params["bucket"], numHashTables=self.params["tables"], seed=self.params["seed"]).fit(self._unit(self.features.limit(1)))

    def load(self, path: str) -> None:
        super().load(path)
        self._fit()

    def _unit(self, rows: DataFrame) -> DataFrame:
        return rows.select("image_id", array_to_vector(D.unit(D.doubles(F.col("vector")))).alias("unit"))

    def _hashes(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        hashed = self.model.transform(self._unit(rows)).select("image_id", F.posexplode("hashes").alias("table", "h"))
        return hashed.select("image_id", "table", F.get(vector_to_array("h"), 0).cast("long").alias("key"))

    def candidates(self, query: list[float]) -> DataFrame:
        one = self.spark.createDataFrame([(0, query)], "image_id long, vector array<double>")
        return self.table.join(self._hashes(one).drop("image_id"), ["table", "key"], "left_semi").select("image_id").distinct()

    def _coders(self) -> tuple[Callable, Callable]:
        planes, bucket = np.array(list(self.model._java_obj.randMatrix().toArray())).reshape(self.dim, self.params["tables"]), self.params["bucket"]

        def has(v):
            return _code(np.arange(planes.shape[1]), np.floor(_unit(v) @ planes / bucket).astype(np.int64))

        return has, has
