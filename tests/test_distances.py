import math
import random

import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hamming_golden(spark):
    v1, v2, v3, v4 = [1, 0] * 4, [1] * 8, [0] * 8, [0, 1] * 4
    for other, want in ((v2, 4), (v3, 4), (v4, 8), (v1, 0)):
        assert value(spark, D.hamming(D.vector(v1), D.vector(other))) == want
    assert value(spark, D.hamming_bits(F.lit(0b1010), F.lit(0b0101))) == 4


def test_cosine(spark):
    assert value(spark, D.cosine(D.vector([1, 2, 3]), D.vector([1, 2, 3]))) == pytest.approx(0, abs=1e-9)
    assert value(spark, D.cosine(D.vector([1, 2]), D.vector([0, 0]))) == math.inf
    a, b = D.vector([1, 0, 1]), D.vector([0, 1, 1])
    assert value(spark, D.cosine(a, b)) == value(spark, D.cosine(b, a)) == pytest.approx(0.5)
    assert value(spark, D.cosine(D.vector([1, 0]), D.vector([-1, 0]))) == 2


@pytest.mark.parametrize("name", ["chi2", "euclidean", "manhattan", "angular"])
def test_metric_laws(spark, name):
    r = random.Random(3)
    a, b = ([r.random() for _ in range(16)] for _ in range(2))
    d = D.metric(name)
    assert value(spark, d(D.vector(a), D.vector(a))) == pytest.approx(0, abs=1e-6)
    assert value(spark, d(D.vector(a), D.vector(b))) == pytest.approx(value(spark, d(D.vector(b), D.vector(a))))
    assert value(spark, d(D.vector(a), D.vector(b))) > 0


def test_chi2_definition(spark):
    want = 0.5 * sum((b - a) ** 2 / (a + b + 1e-10) for a, b in ((0.1, 0.4), (0.9, 0.6)))
    assert value(spark, D.chi_squared(D.vector([0.1, 0.9]), D.vector([0.4, 0.6]))) == pytest.approx(want)


def test_non_finite_is_infinite(spark):
    for bad in (float("nan"), math.inf, -math.inf):
        assert value(spark, D.folded(F.lit(bad))) == math.inf
        assert value(spark, D.is_finite(F.lit(bad))) is False
    assert value(spark, D.is_finite(F.lit(None).cast("double"))) is False
    assert value(spark, D.folded(F.lit(1.5))) == 1.5


def test_median_and_bits(spark):
    assert value(spark, D.median(D.vector([3, 1, 2]))) == 2
    assert value(spark, D.median(D.vector([4, 1, 2, 3]))) == 2.5
    assert value(spark, D.above(D.vector([3, 1, 2]), F.lit(2))) == [1, 0, 0]
    assert value(spark, D.packed(F.array(*[F.lit(x) for x in (1, 0, 1)]))) == 5
    assert value(spark, D.l1_normalised(D.vector([0, 0]))) == [0, 0]


def test_query_checks():
    for bad in ([], [0, 0], [1, math.nan], [math.inf], [[1]], 3):
        with pytest.raises(ValueError):
            D.check_query(bad)
    with pytest.raises(ValueError):
        D.check_query([1, 2], 3)
    assert D.check_query([0, 0], nonzero=False) == [0, 0]
    with pytest.raises(ValueError):
        D.metric("none")


def test_strings(spark):
    p = F.lit("/a/b.c/Name.v1.JPG")
    assert value(spark, S.extension(p)) == "jpg"
    assert value(spark, S.file_name(p)) == "Name.v1.JPG"
    assert value(spark, S.stem(p)) == "Name.v1"
    assert value(spark, S.extension(F.lit("/a.b/none"))) == ""
    assert value(spark, S.has_extension(p, [".Jpg"])) is True
    assert value(spark, S.parts(F.lit(" a ;; b;"))) == ["a", "b"]
    assert value(spark, S.shard_name(F.lit(7))) == "shard_0007"
    assert value(spark, S.shard_name(F.lit(12345))) == "shard_12345"
    assert value(spark, S.shard_number(F.lit("shard_0012"))) == 12
    assert value(spark, S.shard_number(F.lit("shard_x"))) is None
    assert value(spark, S.safe_name(F.lit("a b/c"))) == "a_b_c"
    assert value(spark, S.json_map(F.lit('{"0": "x.jpg"}'))) == {"0": "x.jpg"}
    assert value(spark, S.json_map(F.lit("["))) is None
    assert value(spark, S.heat_colour(F.lit(1.0), F.lit(0.0), F.lit(1.0))) == "#ff0000"
    assert value(spark, S.heat_colour(F.lit(0.0), F.lit(0.0), F.lit(1.0))) == "#00ff00"
    assert value(spark, S.close_to(F.lit(1.0), F.lit(1.0 + 1e-9))) is True
