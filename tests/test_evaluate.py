import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import cli
from nearfield.functions import distances as D
from nearfield.functions import images as I
from nearfield.operators import evaluate, project, query
from nearfield.operators.catalog import Catalog
from nearfield.schemas import COMPARISON
from nearfield.sources import files, shards
from nearfield.streaming import ingest
from tests.test_sources import folder, png  # noqa: F401


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, image_id long")


def test_overlap_and_rank(spark):
    a = ranked(spark, [(0, 1, 5), (0, 2, 6), (1, 1, 7)])
    b = ranked(spark, [(0, 1, 6), (0, 2, 9), (1, 1, 8)])
    assert {(r[0], r[1]) for r in evaluate.overlap_at_k(a, b, 2).collect()} == {(0, 0.5), (1, 0.0)}
    s = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.1), (0, 3, 0.5)], "query_id long, image_id long, score double")
    t = lambda i: spark.createDataFrame([(0, i)], "query_id long, image_id long")
    assert evaluate.rank_of(s, t(2)).first()["rank"] == 1
    assert evaluate.rank_of(s, t(3)).first()["rank"] == 3
    assert evaluate.rank_of(s, t(9)).first()["rank"] is None


def test_summaries(spark, tmp_path):
    rows = spark.createDataFrame([(0, 50, 10.0, 5.0, 0.4, 1, 1), (1, 50, 20.0, 10.0, 0.2, 1, None), (0, 200, 9.0, 0.0, 1.0, 1, 1)], COMPARISON)
    got = {r["k_candidates"]: r for r in evaluate.backend_summary(rows).collect()}
    assert got[50]["avg_overlap"] == pytest.approx(0.3) and got[50]["speedup"] == 2 and got[200]["speedup"] == float("inf")
    files.write_csv(rows, str(tmp_path / "c"))
    assert files.read_comparison(spark, str(tmp_path / "c")).count() == 3
    times = spark.createDataFrame([(0, 1.0), (0, 9.0), (0, 2.0), (1, 4.0)], "query_id long, ms double")
    assert tuple(evaluate.timing_summary(times).first()) == (3, 3, 2, 4)
    stages = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 6.0)], "stage string, ms double")
    assert [(r["stage"], r["percent"]) for r in evaluate.stage_breakdown(stages).collect()] == [("b", 75), ("a", 25)]


def test_timing_and_profile(spark):
    assert set(evaluate.repeat(lambda: None, 3, 1)) == {"mean", "median", "min", "max"}
    result, stats = evaluate.profile(sorted, [3, 1])
    assert result == [1, 3]
    rows = spark.createDataFrame([("f", "g", str(i), 1, 0.0, float(i)) for i in range(5)], "file string, function string, label string, ncalls long, tottime double, cumtime double")
    top = evaluate.hot_spots(rows, 2).orderBy(F.desc("cumtime")).collect()
    assert [r["label"] for r in top] == ["4", "3"] and top[0]["colour"] == "#ff0000"
    assert evaluate.draw_ids(range(100), 5) == evaluate.draw_ids(range(100), 5)
    with pytest.raises(ValueError):
        evaluate.draw_ids([1], 2)


def test_query_vectors_and_comparison(spark):
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "image_id long, vector array<double>")
    with pytest.raises(ValueError):
        evaluate.query_vectors({"embedding": e}, [99])
    rows = evaluate.compare_backends({"embedding": e}, [0, 5], (3, 100), 2).collect()
    assert len(rows) == 4 and all(r["self_rank_exact"] == 1 for r in rows)
    assert [r["overlap"] for r in rows if r["k_candidates"] == 100] == [1, 1]


def test_projection(spark):
    r = np.random.default_rng(2)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(30, 8)))], "image_id long, vector array<float>")
    a, b = (project.project(e, 2).orderBy("image_id").collect() for _ in range(2))
    assert a == b and len(a) == 30
    assert project.project(e, 3, sample=10).count() == 10
    for bad in ({"dims": 4}, {"sample": 0}, {"method": "umap"}):
        with pytest.raises(ValueError):
            project.project(e, **bad)
    with pytest.raises(ValueError):
        project.project(e.limit(2), 2)
    coords = project.check_coordinates(project.project(e, 2))
    assert project.placed_vectors(coords, e).count() == 30
    with pytest.raises(Exception, match="no vector"):
        project.placed_vectors(coords, e.filter("image_id < 9")).collect()
    for bad in (coords.withColumnRenamed("x", "z"), coords.withColumn("image_id", F.col("image_id") + 0.5), coords.union(coords), coords.withColumn("x", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            project.check_coordinates(bad)
    assert project.neighbours_of(e, 3).filter("query_id = image_id").isEmpty()


def test_command_line(spark, folder, tmp_path, capsys):  # noqa: F811
    run = lambda *a: cli.main([str(x) for x in a], spark)
    catalog, store = tmp_path / "catalog", tmp_path / "run"
    assert run("list-samples", "--root", folder, "--limit", 2) == 0
    assert "a.png" in capsys.readouterr().out
    assert run("ingest", "--root", folder, "--catalog", catalog) == 0
    assert run("make-pilot", "--catalog", catalog, "-n", 2, "--out", tmp_path / "p.csv") == 0
    assert run("make-pilot", "--catalog", catalog, "-n", 50, "--out", tmp_path / "q.csv") == 1
    for f in ("hsv", "phash", "embedding"):
        assert run("extract", "--root", folder, "--catalog", catalog, "--run-dir", store, "--feature", f, "--shard-size", 2) == 0
    capsys.readouterr()
    assert run("query", "--run-dir", store, "--catalog", catalog, "--image-id", 1, "-k", 2) == 0
    assert capsys.readouterr().out.startswith(f"1 {Catalog(spark, str(catalog)).path_of(1)} 0.0")
    with pytest.raises(ValueError):
        run("query", "--run-dir", store, "--catalog", catalog, "--image-id", 1, "--features", "hsv;none")
    args = cli.parser().parse_args(["query-loop", "--run-dir", str(store), "--catalog", str(catalog), "--backend", "index"])
    assert cli.loop(spark, args, ["1;2", "x", "99", "exit", "3"]) == 0
    said = capsys.readouterr()
    assert said.out.startswith("1 ") and "99" in said.err  # an index may leave few candidates, never the query out
    assert run("phash-on-samples", "--root", folder, "-k", 1) == 0


def test_streaming(spark, folder, tmp_path):  # noqa: F811
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    for _ in range(2):
        q = ingest.ingest_stream(ingest.stream_files(spark, folder, ["png"]), catalog, str(tmp_path / "checkpoint"))
        q.awaitTermination()
        assert catalog.count() == 4
    png(tmp_path / "images" / "z.png", np.zeros((4, 4, 3)))
    ingest.ingest_stream(ingest.stream_files(spark, folder, ["png"]), catalog, str(tmp_path / "checkpoint")).awaitTermination()
    assert catalog.count() == 5
    features = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "image_id long, vector array<double>")
    spark.createDataFrame([(7, [1.0, 3.0])], "query_id long, vector array<double>").write.parquet(str(tmp_path / "asked"))
    asked = spark.readStream.schema("query_id long, vector array<double>").parquet(str(tmp_path / "asked"))
    got = []
    ingest.answer_stream(asked, features, 2, str(tmp_path / "answers"), lambda rows, n: got.extend(rows.collect())).awaitTermination()
    assert [(r["query_id"], r["rank"], r["image_id"]) for r in sorted(got, key=lambda r: r["rank"])][0] == (7, 1, 3)


def test_large_batches_of_queries_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest.search, "MAX_QUERIES", 2)
    features = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "image_id long, vector array<double>")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "query_id long, vector array<double>").write.parquet(str(tmp_path / "asked"))
    asked = spark.readStream.schema("query_id long, vector array<double>").parquet(str(tmp_path / "asked"))
    got = []
    ingest.answer_stream(asked, features, 1, str(tmp_path / "answers"), lambda rows, n: got.extend(rows.collect())).awaitTermination()
    assert sorted((r["query_id"], r["image_id"]) for r in got) == [(i, i) for i in range(1, 6)]


def test_nan_never_wins(spark):
    v = spark.range(1).select(D.cosine(D.vector([1, float("nan")]), D.vector([1, 2])).alias("d")).first()["d"]
    assert v != v


def test_query_by_image_files(spark, folder, tmp_path, capsys):  # noqa: F811
    run = lambda *a: cli.main([str(x) for x in a], spark)
    catalog, store, asked = tmp_path / "catalog", tmp_path / "run", tmp_path / "asked"
    run("ingest", "--root", folder, "--catalog", catalog)
    for f in ("hsv", "phash", "embedding"):
        run("extract", "--root", folder, "--catalog", catalog, "--run-dir", store, "--feature", f)
    known = Catalog(spark, str(catalog)).path_of(1)
    asked.mkdir()
    copy = asked / ("q." + known.rsplit(".", 1)[-1])  # a file that the store doesn't have
    copy.write_bytes(open(known, "rb").read())
    (asked / "bad.png").write_bytes(b"not an image")
    capsys.readouterr()
    where = ("query", "--run-dir", store, "--catalog", catalog, "-k", 2)
    assert run(*where, "--image-path", copy, "--weights", "embedding=0.5;hsv=0.3;phash=0.2") == 0
    assert capsys.readouterr().out.startswith(f"1 {known} 0.0")
    assert run(*where, "--image-path", copy, "--image-id", 1, "--backend", "candidates") == 0
    assert capsys.readouterr().out.startswith(f"1 {known} 0.0")
    for bad in (asked / "bad.png", asked / "none.png"):
        with pytest.raises(ValueError, match="cannot load"):
            run(*where, "--image-path", bad)
    with pytest.raises(ValueError, match="give an"):
        run(*where)
    s = query.Session(shards.FeatureStore(spark, str(store)).store()).store
    assert query.by_images(spark, s, [str(copy)], 1).first()["image_id"] == 1
    assert query.by_images(spark, s, [str(copy), known], 1).first()["image_id"] == 1

    def broken(image):
        raise RuntimeError("no")

    with pytest.warns(UserWarning, match="hsv of .* is left out"):
        got = query.from_images(spark, [str(copy)], extractors={"hsv": broken, "phash": I.extractors()["phash"]})
    assert set(got[0]) == {"phash"}
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="could be extracted"):
        query.from_images(spark, [str(copy)], extractors={"hsv": broken})
    with pytest.warns(UserWarning, match="no extractor"), pytest.raises(ValueError):
        query.from_images(spark, [str(copy)], ["other"])
    with pytest.raises(ValueError, match="no candidate id"):
        query.scores(s, got[0], ids=spark.createDataFrame([(999,)], "image_id long"))
