import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import images as I
from nearfield.operators.catalog import Catalog
from nearfield.sources import files, images, shards


def png(path, pixels):
    a = np.asarray(pixels, dtype=np.uint8)
    kind = {1: 0, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "images"
    (at / "deep").mkdir(parents=True)
    r = np.random.default_rng(0)
    png(at / "b.png", r.integers(0, 256, (10, 15, 3)))
    png(at / "a.png", r.integers(0, 256, (8, 8)))
    png(at / "deep" / "c.PNG", r.integers(0, 256, (20, 10, 4)))
    (at / "bad.png").write_bytes(b"\0\0NOT_A_REAL_IMAGE")
    (at / "note.txt").write_text("text")
    (at / "plain").write_text("no extension")
    return str(at)


def test_scan_and_samples(spark, folder):
    assert {os.path.basename(r["path"]) for r in images.scan(spark, folder).collect()} == {"a.png", "b.png", "c.PNG", "bad.png", "note.txt"}
    assert images.scan(spark, folder, ["png"]).count() == 4
    got = images.samples(spark, folder).orderBy("image_id").collect()
    assert [(r["image_id"], r["name"]) for r in got] == [(0, "a.png"), (1, "b.png"), (2, "bad.png")]
    assert images.samples(spark, folder, limit=1).count() == 1
    with pytest.raises(ValueError):
        images.samples(spark, folder, limit=-1)


def test_decode_and_policies(spark, folder):
    decoded = images.decode(spark, folder)
    paths = spark.createDataFrame([(1, f"{folder}/a.png"), (2, f"{folder}/bad.png"), (3, f"{folder}/gone.png")], "image_id long, path string")
    assert [r["image_id"] for r in images.load(paths, decoded).collect()] == [1]
    assert {(r["path"].rsplit("/")[-1], r["status"]) for r in images.failures(paths, decoded).collect()} == {("bad.png", "unreadable"), ("gone.png", "missing")}
    with pytest.raises(Exception, match="cannot load"):
        images.load(paths, decoded, "raise").collect()
    with pytest.raises(ValueError):
        images.load(paths, decoded, "none")
    assert images.from_samples(spark, folder).count() == 2


def test_ingest_pilot_extract_resume(spark, folder, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog")).init()
    rows = images.catalog_rows(images.decode(spark, folder), images.scan(spark, folder))
    assert catalog.ingest(rows) == 3 and catalog.ingest(rows) == 0
    known = catalog.by_path(f"{folder}/deep/c.PNG")
    assert (known["width"], known["height"], known["ext"]) == (10, 20, "png") and known["bytes"] > 0
    files.write_pilot([2, 99, 1], str(tmp_path / "pilot.csv"))
    pilot = files.read_pilot(spark, str(tmp_path / "pilot.csv"))
    got = images.from_pilot(pilot, catalog.rows(), images.decode(spark, folder)).orderBy("position").collect()
    assert [r["image_id"] for r in got] == [2, 1]
    store = shards.FeatureStore(spark, str(tmp_path / "run"))
    loaded = images.from_catalog(catalog.rows(), images.decode(spark, folder)).select("image_id", "image")
    for name, extract in I.extractors(16).items():
        assert store.extract(loaded, name, extract, shard_size=2, stop=1) == [0]
        assert store.extract(loaded, name, extract, shard_size=2) == [1]
        assert store.extract(loaded, name, extract, shard_size=2) == []
    assert store.features() == ["embedding", "hsv", "phash"]
    assert store.read("hsv").count() == 3
    assert store.read("hsv").select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("s")).agg(F.min("s")).first()[0] == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        store.extract(loaded, "hsv", I.extractors()["hsv"], shard_size=2, start=5)
    assert store.extract(loaded.limit(0), "hsv", I.extractors()["hsv"]) == []


def test_pilot_lists(spark, tmp_path):
    (tmp_path / "p.csv").write_text("42\n67\n\n 11\n\n")
    read = lambda *a: [r["image_id"] for r in files.read_pilot(spark, str(tmp_path / "p.csv"), *a).orderBy("position").collect()]
    assert read() == [42, 67, 11] and read(1) == [67, 11] and read(0, 1) == [42]
    with pytest.raises(ValueError):
        read(-1)


def test_shards(spark, tmp_path):
    store = shards.FeatureStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (3, [3.0, 4.0], 2)], "image_id long, vector array<float>, shard_id int")
    store.write(rows, "x")
    assert store.shards("x") == [0, 2]
    assert sorted(r[0] for r in store.pending("x", 5).collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        store.pending("x", -5)
    with pytest.raises(FileNotFoundError):
        store.read("y")
    for bad in ([(1, [1.0], 1), (1, [2.0], 1)], [(1, [1.0], 1), (2, [1.0, 2.0], 1)], [(1, [float("nan")], 1)]):
        with pytest.raises(ValueError):
            store.write(spark.createDataFrame(bad, "image_id long, vector array<float>, shard_id int"), "x")
    with pytest.warns(UserWarning, match="incomplete"):
        assert store.read("x").count() == 2
    with pytest.raises(ValueError):
        store.write(rows, "hsv")
    assert shards.memory_bytes(store.read("x", complete=False).filter("shard_id <> 1")) == 16


def test_npy_exchange(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (3, [3.0, 4.0])], "image_id long, vector array<float>")
    folder = shards.export_npy(rows, str(tmp_path), "embedding", 50)
    assert folder.endswith("embedding/shard_0050") and shards.discover_npy(str(tmp_path), "embedding") == [50]
    read = lambda: shards.import_npy(spark, str(tmp_path), "embedding", 50)
    assert [(r["image_id"], r["vector"]) for r in read().orderBy("image_id").collect()] == [(1, [1, 2]), (3, [3, 4])]
    meta = json.loads(open(f"{folder}/meta.json").read())
    assert set(meta) == shards.META_KEYS
    for change in ({"feature_dim": 1}, {"version": 2}, {"extra": 1}):
        open(f"{folder}/meta.json", "w").write(json.dumps(meta | change))
        with pytest.raises(ValueError):
            read()
    open(f"{folder}/meta.json", "w").write("[")
    with pytest.raises(ValueError):
        read()
    open(f"{folder}/meta.json", "w").write(json.dumps(meta))
    whole = open(f"{folder}/features.npy", "rb").read()
    open(f"{folder}/features.npy", "wb").write(whole[:10])
    with pytest.raises(ValueError):
        read()
    os.unlink(f"{folder}/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        read()
    with pytest.raises(FileNotFoundError):
        shards.discover_npy(str(tmp_path), "none")
    with pytest.raises(ValueError):
        shards.shard_folder(str(tmp_path), "x", -1)


def test_image_features():
    r = np.random.default_rng(1)
    rgb = r.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    h = I.hsv_histogram(rgb)
    assert h.shape == (432,) and h.sum() == pytest.approx(1, abs=1e-5)
    assert (I.hsv_histogram(rgb) == h).all()
    p = I.phash(rgb)
    assert p.shape == (64,) and p.sum() == 32
    near = np.clip(rgb.astype(int) + 1, 0, 255).astype(np.uint8)
    assert (I.phash(near) != p).sum() <= 10
    for colour, hue in (((255, 0, 0), 0), ((0, 255, 0), 60), ((0, 0, 255), 120)):
        assert I.rgb_to_hsv(np.full((1, 1, 3), colour, dtype=np.uint8))[0, 0].tolist() == [hue, 255, 255]
    m = I.dct_matrix(8)
    assert np.allclose(m @ m.T, np.eye(8))
    assert np.allclose(I.resize(np.ones((5, 7)), 3, 4), 1) and I.resize(rgb, 20, 30) == pytest.approx(rgb)
    e = I.random_embedding(32)
    assert e(rgb).shape == (32,) and (e(rgb) == I.random_embedding(32)(rgb)).all()
    assert I.thumbnail(rgb, 10).shape == (7, 10, 3)
    assert I.to_rgb(bytes([1, 2, 3]), 1, 1, 3)[0, 0].tolist() == [3, 2, 1]
    assert I.to_rgb(b"", -1, -1, -1) is None and I.to_rgb(b"12", 1, 1, 3) is None


def test_coordinates(spark, tmp_path):
    np.save(tmp_path / "c.npy", np.array([[0, 1], [2, 3]], dtype=np.float32))
    np.save(tmp_path / "i.npy", np.array([5, 6]))
    (tmp_path / "i.json").write_text('{"ids": [5, 6]}')
    (tmp_path / "l.json").write_text("[5, 6]")
    (tmp_path / "f.json").write_text("[5.5, 6]")
    (tmp_path / "s.json").write_text("[5]")
    for name in ("i.npy", "i.json", "l.json"):
        got = files.read_coordinates(spark, str(tmp_path / "c.npy"), str(tmp_path / name))
        assert [tuple(r) for r in got.orderBy("image_id").collect()] == [(5, 0, 1), (6, 2, 3)]
    for name in ("f.json", "s.json"):
        with pytest.raises(ValueError):
            files.read_coordinates(spark, str(tmp_path / "c.npy"), str(tmp_path / name))
    with pytest.raises(ValueError):
        files.read_coordinates(spark, str(tmp_path / "c.npy"), str(tmp_path / "i.npy"), 3)
    files.write_coordinates(got, str(tmp_path / "out"), feature="x")
    back = files.read_coordinates(spark, str(tmp_path / "out/coords_2d.npy"), str(tmp_path / "out/coords_2d_ids.npy"))
    assert back.count() == 2
