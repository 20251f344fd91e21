import datetime

import pytest
from pyspark.sql import functions as F

from nearfield.operators import catalog as C


@pytest.fixture
def catalog(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path / "catalog")).init()
    rows = [(f"images/sample_{i}.jpg", 100 + i, 200 + i, "jpg", 1234 + i, datetime.datetime(2024, 1, 1)) for i in range(5)]
    c.upsert(spark.createDataFrame(rows, "path string, width int, height int, ext string, bytes long, added_at timestamp"))
    return c


def test_lookups(catalog):
    assert catalog.count() == 5
    assert [r["path"] for r in catalog.slice(1, 3).collect()] == ["images/sample_1.jpg", "images/sample_2.jpg"]
    assert catalog.slice(1).count() == 4 and catalog.slice(1, 1).count() == 0
    for bounds in ((-1, 2), (3, 1)):
        with pytest.raises(ValueError):
            catalog.slice(*bounds)
    one = catalog.by_path("images/sample_2.jpg")
    assert catalog.by_id(one["image_id"]) == one and catalog.path_of(one["image_id"]) == one["path"]
    assert catalog.by_id(99) is None and catalog.by_path("x") is None and catalog.path_of(99) is None
    assert catalog.any_path().startswith("images/")
    assert catalog.ids().count() == catalog.paths().count() == 5


def test_upsert_keeps_ids(spark, catalog):
    before = catalog.by_path("images/sample_1.jpg")
    item = spark.createDataFrame([("images/sample_1.jpg", 512)], "path string, width int")
    for _ in range(2):
        catalog.upsert(item)
    after = catalog.by_path("images/sample_1.jpg")
    assert after["image_id"] == before["image_id"] and after["width"] == 512 and after["height"] is None
    assert catalog.count() == 5


def test_ids_are_never_given_twice(spark, catalog):
    last = max(r[0] for r in catalog.ids().collect())
    catalog.delete(ids=[last], paths=["nothing"])
    assert catalog.count() == 4
    catalog.upsert(spark.createDataFrame([("new.jpg",)], "path string"))
    assert catalog.by_path("new.jpg")["image_id"] == last + 1


def test_ingest_adds_new_paths_only(spark, catalog):
    found = spark.createDataFrame([("images/sample_0.jpg", 9), ("a.jpg", 7)], "path string, width int")
    assert catalog.ingest(found) == 1 and catalog.ingest(found) == 0
    assert catalog.by_path("images/sample_0.jpg")["width"] == 100
    assert len(catalog.versions()) == 3 and catalog.rows(catalog.versions()[0]).count() == 0


def test_missing_catalog(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        C.Catalog(spark, str(tmp_path / "none")).rows()


def test_samples(catalog):
    a, b = C.sample_ids(catalog.rows(), 3, 42), C.sample_ids(catalog.rows(), 3, 42)
    assert a == b and len(set(a)) == 3
    with pytest.raises(ValueError):
        C.sample_ids(catalog.rows(), 6)
    draw = lambda s: [r["image_id"] for r in C.sample_by_hash(catalog.rows(), 4, s).collect()]
    assert draw(1) == draw(1) and len(set(draw(1))) == 4


def test_resolve(spark, catalog):
    top = spark.createDataFrame([(1, 1, 0.1), (2, 2, 0.2)], "rank long, image_id long, score double")
    paths = catalog.rows()
    assert [r["path"] for r in C.resolved(top, paths).orderBy("rank").collect()] == ["images/sample_0.jpg", "images/sample_1.jpg"]
    lost = spark.createDataFrame([(1, 21, 0.1)], "rank long, image_id long, score double")
    with pytest.raises(Exception, match="no path for image 21"):
        C.resolved(lost, paths).collect()
    assert C.resolved(lost, paths, missing="null").first()["path"] is None
    names = C.id_map(spark.createDataFrame([('{"0": "a.jpg", "1": "b.jpg"}',)], "json string"))
    assert {(r["image_id"], r["path"]) for r in names.collect()} == {(0, "a.jpg"), (1, "b.jpg")}


def test_pilot(spark, catalog):
    pilot = spark.createDataFrame([(0, 3), (1, 9999), (2, 1)], "position long, image_id long")
    got = C.pilot_rows(pilot, catalog.rows()).orderBy("position").collect()
    assert [r["image_id"] for r in got] == [3, 1]
    with pytest.raises(Exception, match="9999"):
        C.pilot_rows(pilot, catalog.rows(), "raise").collect()
    assert [r["image_id"] for r in C.missing_ids(pilot, catalog.ids()).collect()] == [9999]


@pytest.mark.parametrize("items,parts", [(1000, 4), (0, 3), (6, 1), (2, 5), (10, 4)])
def test_even_split(spark, items, parts):
    got = [(r["start"], r["stop"]) for r in C.even_split(spark.range(items).withColumnRenamed("id", "image_id"), parts).orderBy("part").collect()]
    assert got == [C.split_range(items, parts, i) for i in range(parts)]
    sizes = [b - a for a, b in got]
    assert sum(sizes) == items and max(sizes) - min(sizes) <= 1
    assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_bad_splits():
    for bad in ((-1, 3, 2), (10, 0, 2), (10, 2, -2), (10, 2, 2)):
        with pytest.raises(ValueError):
            C.split_range(*bad)


def test_numbered_and_shards(spark):
    rows = spark.range(0, 100).select((F.col("id") * 37 % 101).alias("image_id"))
    got = C.numbered(rows, "image_id").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(100)) and [r["image_id"] for r in got] == sorted(r["image_id"] for r in got)
    assert C.numbered(rows.limit(0), "image_id").count() == 0
    per = C.fixed_shards(rows, 30).groupBy("shard_id").count().orderBy("shard_id").collect()
    assert [r["count"] for r in per] == [30, 30, 30, 10]
