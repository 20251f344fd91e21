"""The engine's registered queries over the driver's tables.

`embeddings` is the feature store: the vector itself (cosine), its absolute
values scaled to sum 1 (chi-squared), and which values exceed the vector's
median (Hamming) stand for an image's three features. `documents`, `pages`,
`labels` and `events` stand for catalogs, id lists and timings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.functions import scalars as S
from nearfield.operators import ann, evaluate, fusion, knn, project, query, search
from nearfield.operators import catalog as C
from nearfield.sources import shards

QUERY, SECOND = 0, 1
K, CANDIDATES = 5, 50
METRICS = {"embedding": "cosine", "hist": "chi2", "bits": "hamming"}
WEIGHTS = {"embedding": 0.5, "hist": 0.3, "bits": 0.2}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, e, h, b: the vector, its histogram and its bits."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), D.doubles(F.col("embedding")).alias("e"))
    return rows.select("image_id", "e", D.l1_normalised(F.col("e")).alias("h"), D.above(F.col("e"), D.median(F.col("e"))).cast("array<double>").alias("b"))


def store(spark: SparkSession, sf: str) -> query.Store:
    f = features(spark, sf)
    return query.Wide(f.select("image_id", F.col("e").alias("embedding"), F.col("h").alias("hist"), F.col("b").alias("bits")), list(METRICS))


def vectors(s: query.Store, image_id: int) -> query.Query:
    return evaluate.query_vectors(s, [image_id])[image_id]


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _topk(feature: str, metric: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = store(spark, sf)
        return six(search.search(s[feature], vectors({feature: s[feature]}, QUERY)[feature], K, metric, "clamp"), "distance")

    return run


def all_distances(spark, sf):
    s = store(spark, sf)
    return six(query.feature_distances(s, vectors(s, QUERY), metrics=METRICS), "distance")


def minmax_normalized(spark, sf):
    s = store(spark, sf)
    d = query.feature_distances(s, vectors(s, QUERY), metrics=METRICS)
    return six(fusion.normalised(d).select("query_id", "feature", "image_id", "norm"), "norm")


def fused_mean_topk(spark, sf):
    s = store(spark, sf)
    return six(query.single_query(s, vectors(s, QUERY), K, metrics=METRICS), "score")


def fused_weighted_topk(spark, sf):
    s = store(spark, sf)
    return six(query.single_query(s, vectors(s, QUERY), K, weights=WEIGHTS, metrics=METRICS), "score")


def fused_with_constant_feature(spark, sf):
    s = store(spark, sf)
    s = query.Wide(s.frame.withColumn("constant", F.array(F.lit(1.0))), [*s, "constant"])
    q = vectors({n: s[n] for n in METRICS}, QUERY) | {"constant": [1.0]}
    return six(query.single_query(s, q, K, metrics=METRICS | {"constant": "euclidean"}), "score")


def multi_query_mean(spark, sf):
    s = store(spark, sf)
    both = evaluate.query_vectors(s, [QUERY, SECOND])
    return six(query.multi_query(s, [both[QUERY], both[SECOND]], K, metrics=METRICS), "score")


def candidate_rerank(spark, sf):
    s = store(spark, sf)
    return six(query.single_query(s, vectors(s, QUERY), K, backend="candidates", k_candidates=CANDIDATES, metrics=METRICS), "score")


def multi_query_candidate(spark, sf):
    s = store(spark, sf)
    both = evaluate.query_vectors(s, [QUERY, SECOND])
    return six(query.multi_query(s, [both[QUERY], both[SECOND]], K, backend="candidates", k_candidates=CANDIDATES, metrics=METRICS), "score")


def _knn(metric: str, include_self: bool, feature: str = "embedding") -> Callable:
    return lambda spark, sf: six(knn.knn(store(spark, sf)[feature], K, metric, include_self=include_self), "distance")


def _query_table(spark, sf):
    """Queries: every image whose id is divisible by 20, against all."""
    return store(spark, sf)["embedding"].filter("image_id % 20 = 0").withColumnRenamed("image_id", "query_id")


def overlap_at_k(spark, sf):
    """Agreement of the cosine and the bits ranking."""
    s = store(spark, sf)
    lists = [knn.knn(s[f], K, m) for f, m in (("embedding", "cosine"), ("bits", "hamming"))]
    return six(evaluate.overlap_at_k(*lists, K), "overlap")


def self_rank(spark, sf):
    """The rank of image 1 among all by their score for image 0."""
    s = store(spark, sf)
    scored = query.scores(s, vectors(s, QUERY), metrics=METRICS)
    target = spark.createDataFrame([(0, SECOND)], "query_id long, image_id long")
    return evaluate.rank_of(scored, target).select("query_id", "image_id", F.col("rank").cast("long").alias("rank"))


def backend_summary(spark, sf):
    """Overlap of candidate re-ranking with exact results for several k_candidates (times come from events)."""
    s = store(spark, sf)
    v = vectors(s, QUERY)
    exact = {r["image_id"] for r in query.single_query(s, v, K, metrics=METRICS).collect()}
    rows = []
    for n in (50, 200):
        got = {r["image_id"] for r in query.single_query(s, v, K, backend="candidates", k_candidates=n, metrics=METRICS).collect()}
        rows.append((n, len(exact & got) / K))
    overlap = spark.createDataFrame(rows, "k_candidates int, overlap double")
    times = table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, 50).otherwise(200).alias("k_candidates"), F.col("value").alias("exact_ms"), (F.col("value") / 2 + 1).alias("approx_ms"))
    return six(evaluate.backend_summary(times.join(overlap, "k_candidates")), "avg_overlap", "min_overlap", "avg_exact_ms", "avg_approx_ms", "speedup")


def aligned_distances(spark, sf):
    s = store(spark, sf)
    found = search.all_distances(s["embedding"], vectors({"embedding": s["embedding"]}, QUERY)["embedding"])
    canonical = C.numbered(search.canonical_ids(s["embedding"]), "image_id")
    return six(fusion.aligned(canonical, found), "distance")


def subset_intersection(spark, sf):
    """Candidates with an id in every feature, where the histogram lacks ids divisible by 7 and the bits those by 5."""
    s = store(spark, sf)
    s["hist"], s["bits"] = s["hist"].filter("image_id % 7 <> 0"), s["bits"].filter("image_id % 5 <> 0")
    wanted = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id")).filter("image_id < 200")
    return query.common_ids(s, ["embedding", "hist", "bits"], wanted)


def duplicate_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    return search.duplicate_ids(rows, "image_id").select("image_id", F.col("n").cast("long").alias("n"))


def _with_zeros(spark, sf):
    """Vectors of the even ids, zeros for the odd ones."""
    e = store(spark, sf)["embedding"]
    return e.select("image_id", F.when(F.col("image_id") % 2 == 0, F.col("vector")).otherwise(F.transform("vector", lambda x: x * 0.0)).alias("vector"))


def zero_norm_filter(spark, sf):
    return search.nonzero(_with_zeros(spark, sf)).select("image_id")


def invalid_counters(spark, sf):
    return search.vector_stats(_with_zeros(spark, sf))


def zero_norm_distances(spark, sf):
    """A zero vector's distance is infinite; it gets the worst norm and its feature stays."""
    rows = _with_zeros(spark, sf)
    s = {"embedding": rows}
    d = query.feature_distances(s, vectors(s, QUERY), metrics=METRICS)
    return six(fusion.normalised(d).select("image_id", "norm"), "norm")


def vector_norm_stats(spark, sf):
    return six(store(spark, sf)["embedding"].select("image_id", D.norm(F.col("vector")).alias("norm")), "norm")


def bit_signature(spark, sf):
    rows = features(spark, sf).select("image_id", D.packed(F.transform("b", lambda x: x.cast("long"))).alias("signature"))
    return rows.withColumn("ones", F.bit_count("signature").cast("long"))


def packed_hamming_topk(spark, sf):
    rows = bit_signature(spark, sf).select("image_id", "signature")
    q = rows.filter(F.col("image_id") == QUERY).first()["signature"]
    return search.top_k(rows.select("image_id", D.hamming_bits(F.lit(q), F.col("signature")).alias("distance")), K)


def _documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("image_id"), F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"), F.col("n_chars").alias("bytes"))


def catalog_slice(spark, sf):
    return C.slice_by_id(_documents(spark, sf).select("image_id", "path"), 10, 30)


def catalog_lookup(spark, sf):
    return _documents(spark, sf).filter((F.col("image_id") == 7) | (F.col("path") == "/src3/3.fr"))


def catalog_count(spark, sf):
    return _documents(spark, sf).agg(F.count(F.lit(1)).alias("n"))


def catalog_upsert(spark, sf):
    """Known: every document; items: those divisible by 10 with a new size, and a new path for each label."""
    known = _documents(spark, sf).select("image_id", "path", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), S.extension(F.col("path")).alias("ext"), "bytes", F.lit(None).cast("timestamp").alias("added_at"))
    fresh = table(spark, sf, "labels").select(F.concat(F.lit("/new/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.lit(1).cast("long").alias("bytes"))
    items = known.filter("image_id % 10 = 0").select("path", (F.col("bytes") + 1000).alias("bytes")).unionByName(fresh)
    high = known.agg(F.max("image_id")).first()[0]
    return C.upserted(known, items, high).select("image_id", "path", "bytes")


def catalog_delete(spark, sf):
    return C.deleted(_documents(spark, sf), ids=[1, 2, 3, 99_999_999], paths=["/src4/4.fr", "/none"]).select("image_id", "path")


def catalog_new_paths(spark, sf):
    """Pages whose url is new, if pages with ids below 100 are known."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return C.new_paths(pages, pages.filter("page_id < 100")).select("page_id", "path")


def missing_ids(spark, sf):
    """Documents without a label."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    return C.missing_ids(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("image_id")))


def resolve_paths(spark, sf):
    s = store(spark, sf)
    best = search.search(s["embedding"], vectors({"embedding": s["embedding"]}, QUERY)["embedding"], K, "cosine", "clamp")
    return six(C.resolved(best, _documents(spark, sf)).select("rank", "image_id", "path", "distance"), "distance")


def pilot_join(spark, sf):
    """Toxic documents as an ordered list, the last id first."""
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("image_id"), (-F.col("doc_id")).alias("_order"))
    return C.pilot_rows(C.numbered(toxic, "_order").drop("_order"), _documents(spark, sf))


def extension_filter(spark, sf):
    """Hosts whose last label is com or net."""
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return table(spark, sf, "pages").select("page_id", host.alias("host")).withColumn("ext", S.extension(F.col("host"))).filter(S.has_extension(F.col("host"), ["COM", ".net"]))


def string_functions(spark, sf):
    d = _documents(spark, sf).select("image_id", "path")
    return d.select("image_id", S.extension(F.col("path")).alias("ext"), S.file_name(F.col("path")).alias("name"), S.stem(F.col("path")).alias("stem"), S.safe_name(F.col("path")).alias("safe"), S.shard_name(F.col("image_id")).alias("shard"), F.size(S.parts(F.concat(F.col("path"), F.lit("; ;x")))).cast("long").alias("n_parts"))


def even_split(spark, sf):
    return C.even_split(_documents(spark, sf), 7)


def fixed_shards(spark, sf):
    return C.fixed_shards(_documents(spark, sf).select("image_id"), 64)


def pending_shards(spark, sf):
    done = table(spark, sf, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("shard_id")).distinct()
    return shards.pending_shards(spark, done, 6)


def shard_validation(spark, sf):
    rows = store(spark, sf)["embedding"].withColumn("shard_id", F.floor(F.col("image_id") / 100).cast("int"))
    out = shards.shard_stats(rows)
    return out.select("shard_id", *[F.col(c).cast("long").alias(c) for c in ("n", "n_ids", "min_dim", "max_dim", "n_invalid")])


def memory_estimate(spark, sf):
    return spark.createDataFrame([(shards.memory_bytes(store(spark, sf)["embedding"]),)], "bytes long")


def json_id_map(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(S.json_map(F.col("props"))).alias("key", "value"))
    return e


def timing_summary(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", F.col("value").alias("ms"))
    return six(evaluate.timing_summary(e, "user_id", "ms", ["event_type"]), "mean", "median", "min", "max")


def stage_breakdown(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return six(evaluate.stage_breakdown(e), "mean", "percent")


def hot_spots(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("label")).agg(F.sum("value").alias("cumtime"))
    return six(evaluate.hot_spots(e, 10).select("label", "cumtime"), "cumtime")


def label_knn_vote(spark, sf):
    """Each embedding's label by vote of its nearest others."""
    near = knn.knn(store(spark, sf)["embedding"], K, "cosine", include_self=False)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    votes = near.join(labels, "image_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "label", F.col("votes").cast("long").alias("votes"))


def placed_vectors(spark, sf):
    """The sum of each map point's vector, joined by id."""
    e = store(spark, sf)["embedding"]
    coords = e.select("image_id", F.get("vector", 0).alias("x"), F.get("vector", 1).alias("y"))
    return six(project.placed_vectors(coords, e).select("image_id", "x", "y", D.total(F.col("vector")).alias("total")), "x", "y", "total")


def _letter_counts(stream):
    """image_id and how often each of a to z is in a lower-cased text, by its bytes."""
    for batch in stream:
        texts = batch.column("t").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        counts = np.zeros((len(texts), 26))
        for i, (begin, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            counts[i] = np.bincount(raw[begin:end], minlength=256)[97:123]
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), 26).cast(pa.list_(pa.float64()))], ["image_id", "counts"])


def document_letters_topk(spark, sf):
    """Documents nearest to document 0 by the shares of their letters (chi-squared)."""

    def shares(documents: DataFrame) -> DataFrame:
        texts = documents.select(F.col("doc_id").alias("image_id"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
        counts = texts.mapInArrow(_letter_counts, "image_id long, counts array<double>")
        return counts.select("image_id", D.l1_normalised(F.col("counts")).alias("vector"))

    documents = table(spark, sf, "documents")
    q = shares(documents.filter(F.col("doc_id") == QUERY)).first()["vector"]
    return six(search.search(shares(documents), q, K, "chi2", "clamp"), "distance")


def _index(make: Callable) -> Callable:
    """The index holds every row; queries are the images with an id divisible by 20."""

    def run(spark, sf):
        e = store(spark, sf)["embedding"]
        return six(make(e).build().search_many(_query_table(spark, sf), K), "distance")

    return run


def signkey_knn(spark, sf):
    e = store(spark, sf)["embedding"]
    return six(ann.SignKeys(e, "angular", tables=32, depth=6).build().search_many(_query_table(spark, sf), K), "distance")


def ann_rerank(spark, sf):
    s = store(spark, sf)
    index = ann.SignKeys(s["embedding"], "angular").build()
    return six(query.single_query(s, vectors(s, QUERY), K, backend="candidates", k_candidates=200, index=index, metrics=METRICS), "score")


def pca_2d(spark, sf):
    return six(project.project(store(spark, sf)["embedding"], 2), "x", "y")


def pca_3d(spark, sf):
    return six(project.project(store(spark, sf)["embedding"], 3), "x", "y", "z")


def backend_comparison(spark, sf):
    s = store(spark, sf)
    return evaluate.compare_backends(s, [QUERY, SECOND], (50, 200), K, metrics=METRICS).select("query_id", "k_candidates", "overlap", "self_rank_exact", "self_rank_approx")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "cosine_topk": _topk("embedding", "cosine"),
        "chi2_topk": _topk("hist", "chi2"),
        "hamming_topk": _topk("bits", "hamming"),
        "euclidean_topk": _topk("embedding", "euclidean"),
        "manhattan_topk": _topk("embedding", "manhattan"),
        "dot_topk": _topk("embedding", "dot"),
        "angular_topk": _topk("embedding", "angular"),
        "knn_self_included": _knn("cosine", True),
        "knn_self_excluded": _knn("euclidean", False),
        "knn_chi2": _knn("chi2", True, "hist"),
        "knn_hamming": _knn("hamming", True, "bits"),
        "signkey_topk": _index(lambda e: ann.SignKeys(e, "angular")),
        "cell_topk": _index(lambda e: ann.Cells(e, "angular", probes=10)),
        "lsh_topk": _index(lambda e: ann.BucketedLSH(e, "angular", bucket=0.25)),
    } | {f.__name__: f for f in (
        all_distances, minmax_normalized, fused_mean_topk, fused_weighted_topk, fused_with_constant_feature, multi_query_mean, candidate_rerank,
        multi_query_candidate, overlap_at_k, self_rank, backend_summary, aligned_distances, subset_intersection, duplicate_ids, zero_norm_filter,
        invalid_counters, zero_norm_distances, vector_norm_stats, bit_signature, packed_hamming_topk, catalog_slice, catalog_lookup, catalog_count,
        catalog_upsert, catalog_delete, catalog_new_paths, missing_ids, resolve_paths, pilot_join, extension_filter, string_functions, even_split,
        fixed_shards, pending_shards, shard_validation, memory_estimate, json_id_map, timing_summary, stage_breakdown, hot_spots, label_knn_vote,
        placed_vectors, document_letters_topk, signkey_knn, ann_rerank, pca_2d, pca_3d, backend_comparison,
    )}
