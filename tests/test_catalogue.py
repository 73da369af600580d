import os

import pytest
from pyspark.sql import functions as F

from glyphstream.sources.catalogue import Catalogue, UnsafeView


def test_only_listed_views_and_none_before_it_is_asked_for(spark, tmp_path):
    made = []

    def make(name, df):
        return lambda: made.append(name) or df

    good = spark.createDataFrame([("ACGTAC", 1.5), ("AC", None)], "token string, share double")
    views = Catalogue({"good": make("good", good), "empty": make("empty", good.limit(0))})
    path = str(tmp_path / "out")
    with pytest.raises(KeyError, match="no such view: other"):
        views.view("other")
    with pytest.raises(KeyError):
        views.export(path, ["good", "other"])
    assert made == [] and not os.path.exists(path)
    assert views.export(path) == [("empty", 0, None), ("good", 2, 6)] and made == ["empty", "good"]
    assert sorted(map(str, views.load(spark, path, "good").collect())) == sorted(map(str, good.collect()))
    assert views.load(spark, path, "empty").count() == 0 and sorted(os.listdir(path)) == ["empty", "good"]
    assert views.export(path, ["good"]) == [("good", 2, 6)]  # again, in place of the first
    with pytest.raises(KeyError):
        views.load(spark, path, "other")
    with pytest.raises(FileNotFoundError):
        views.load(spark, str(tmp_path / "none"), "good")


@pytest.mark.parametrize("column, value, says", [("token", "ACGTACG", "a token of 7"), ("x", "ACGT" * 20, "x__run"), ("x", ">a\nACGT", "x__fasta"), ("sequence", "A", "forbidden")])
def test_unsafe_views_leave_nothing(spark, tmp_path, column, value, says):
    df = spark.createDataFrame([(value, 1), ("A", 2)], f"{column} string, n int")
    with pytest.raises(UnsafeView, match=says):
        Catalogue({"bad": lambda: df}).export(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_nested_values_are_guarded(spark, tmp_path):
    df = spark.range(1).select(F.array(F.struct(F.lit("ACGTN" * 16).alias("deep"))).alias("x"))
    with pytest.raises(UnsafeView, match="x__run"):
        Catalogue({"bad": lambda: df}).export(str(tmp_path))
