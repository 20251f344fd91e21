"""Command line: python -m nearfield.cli <command>."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from nearfield.functions import images as I
from nearfield.operators import evaluate, project, query
from nearfield.operators.ann import SignKeys
from nearfield.operators.catalog import Catalog, resolved, sample_ids
from nearfield.operators.knn import knn, self_match
from nearfield.session import session
from nearfield.sources import files, images
from nearfield.sources.shards import PILOT_SHARD_SIZE, SHARD_SIZE, FeatureStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nearfield")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, about: str, *options):
        s = sub.add_parser(name, help=about)
        for flags, how in options:
            s.add_argument(*flags, **how)
        s.set_defaults(run=run)

    root = (["--root"], {"required": True, "help": "folder of images"})
    catalog = (["--catalog"], {"required": True})
    run_dir = (["--run-dir"], {"required": True, "help": "folder of the feature store"})
    k = (["-k"], {"type": int, "default": 5})
    feature = (["--feature"], {"choices": ["hsv", "phash", "embedding"], "default": "embedding"})
    asks = [run_dir, catalog, (["--image-id"], {"type": int, "action": "append", "default": [], "help": "an image of the store; may repeat"}), (["--image-path"], {"action": "append", "default": [], "help": "an image file, in the store or not; may repeat"}), (["--weights"], {"default": "", "help": "like embedding=0.5;hsv=0.3;phash=0.2"}), k, (["--features"], {"default": ""}), (["--backend"], {"choices": ["exact", "candidates", "index"], "default": "exact"}), (["--k-candidates"], {"type": int, "default": query.K_CANDIDATES})]
    add("list-samples", list_samples, "files of a folder", root, (["--ext"], {"default": "jpg;jpeg;png"}), (["--limit"], {"type": int}))
    add("ingest", ingest, "add new images to the catalog", root, catalog)
    add("make-pilot", make_pilot, "draw ids", catalog, (["-n"], {"type": int, "default": 1000}), (["--seed"], {"type": int, "default": 42}), (["--out"], {"required": True}))
    add("extract", extract, "compute features", root, catalog, run_dir, feature, (["--pilot"], {}), (["--shard-size"], {"type": int}), (["--shard-start"], {"type": int, "default": 0}), (["--shard-stop"], {"type": int}))
    for name in ("hsv", "phash", "embedding"):
        add(f"{name}-on-samples", on_samples(name), f"neighbours by {name}", root, k)
    add("map-embeddings", map_embeddings, "a map of features", run_dir, feature, (["--dims"], {"type": int, "choices": [2, 3], "default": 2}), (["--sample"], {"type": int}), (["--out"], {"required": True}))
    add("query", ask, "the best matches of one or more images", *asks)
    add("query-loop", loop, "queries from standard input, ids or paths separated by ;", *asks[:2], *asks[4:])
    add("profile-query", profile_query, "where a query's time goes", *asks)
    return p


def _names(text: str) -> list[str] | None:
    return [x.strip() for x in text.split(";") if x.strip()] or None


def list_samples(spark, a) -> int:
    for r in images.samples(spark, a.root, _names(a.ext) or (), a.limit).orderBy("image_id").collect():
        print(r["image_id"], r["path"])
    return 0


def ingest(spark, a) -> int:
    rows = images.catalog_rows(images.decode(spark, a.root), images.scan(spark, a.root))
    print(Catalog(spark, a.catalog).init().ingest(rows), "new images")
    return 0


def make_pilot(spark, a) -> int:
    try:
        files.write_pilot(sample_ids(Catalog(spark, a.catalog).rows(), a.n, a.seed), a.out)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def extract(spark, a) -> int:
    known, decoded = Catalog(spark, a.catalog).rows(), images.decode(spark, a.root)
    if a.pilot:
        rows = images.from_pilot(files.read_pilot(spark, a.pilot), known, decoded)
    else:
        rows = images.from_catalog(known, decoded)
    size = a.shard_size or (PILOT_SHARD_SIZE if a.pilot else SHARD_SIZE)
    done = FeatureStore(spark, a.run_dir).extract(rows.select("image_id", "image"), a.feature, I.extractors()[a.feature], shard_size=size, start=a.shard_start, stop=a.shard_stop)
    print("shards written:", *done)
    return 0


def on_samples(name: str):
    metric = {"hsv": "chi2", "phash": "hamming", "embedding": "cosine"}[name]

    def run(spark, a) -> int:
        rows = images.from_samples(spark, a.root).select("image_id", I.extractors()[name](F.col("image")).alias("vector")).cache()
        found = knn(rows, a.k, metric).orderBy("query_id", "rank").collect()
        for r in found:
            print(r["query_id"], r["rank"], r["image_id"], round(r["distance"], 6))
        odd = self_match(spark.createDataFrame(found, "query_id long, rank long, image_id long, distance double"), 1e-6 if name == "embedding" else None).count() if found else 0
        return 1 if odd else 0

    return run


def map_embeddings(spark, a) -> int:
    rows = FeatureStore(spark, a.run_dir).read(a.feature)
    files.write_coordinates(project.project(rows, a.dims, sample=a.sample), a.out, feature=a.feature, method="pca")
    return 0


def _session(spark, a) -> query.Session:
    wanted = _names(a.features) if hasattr(a, "features") else None
    store = FeatureStore(spark, a.run_dir).store()
    how = {"features": wanted, "k_candidates": a.k_candidates, "backend": "exact" if a.backend == "exact" else "candidates"}
    index = None
    if a.backend == "index":
        index = SignKeys(store["embedding"])
        index.refresh(f"{a.run_dir}/index", FeatureStore(spark, a.run_dir).shards("embedding"))
    if wanted:
        query.require_features([n for n in store if n in wanted], wanted)
    return query.Session(store, index, **how)


def _weights(text: str) -> dict[str, float] | None:
    return {n.strip(): float(w) for n, _, w in (x.partition("=") for x in _names(text) or ())} or None


def _answer(spark, a, s: query.Session, ids: list[int], paths: list[str]) -> list:
    wanted = s.how.get("features")
    vectors = evaluate.query_vectors(s.store, ids) if ids else {}
    asked = [vectors[i] for i in ids] + query.from_images(spark, paths, wanted or list(s.store))
    if not asked:
        raise ValueError("give an --image-id or an --image-path")
    shared = set.intersection(*(set(q) for q in asked))
    found = s.ask([{n: v for n, v in q.items() if n in shared} for q in asked], a.k, weights=_weights(a.weights))
    return resolved(found, Catalog(spark, a.catalog).rows()).orderBy("rank").collect()


def ask(spark, a) -> int:
    for r in _answer(spark, a, _session(spark, a), a.image_id, a.image_path):
        print(r["rank"], r["path"], round(r["score"], 6))
    return 0


def loop(spark, a, lines=None) -> int:
    s = _session(spark, a)
    for line in lines if lines is not None else sys.stdin:
        if line.strip() in ("exit", "quit"):
            break
        try:
            asked = _names(line) or []
            ids, paths = [int(x) for x in asked if x.isdecimal()], [x for x in asked if not x.isdecimal()]
            for r in _answer(spark, a, s, ids, paths) if asked else []:
                print(r["rank"], r["path"], round(r["score"], 6))
        except ValueError as e:
            print(e, file=sys.stderr)
    return 0


def profile_query(spark, a) -> int:
    _, stats = evaluate.profile(lambda: _answer(spark, a, _session(spark, a), a.image_id, a.image_path))
    evaluate.hot_spots(evaluate.profile_rows(spark, stats, "nearfield")).show(truncate=False)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())
