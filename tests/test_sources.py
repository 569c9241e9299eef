"""Manifests of parts, and broken files."""

import pytest

from lumenary.sources import io


def test_manifest_states(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 3, None), ("c", 4, "z"), (None, 5, "n")]
    frozen = io.manifest(spark.createDataFrame(rows, "part string, i int, t string"), "part", ["i", "t"])
    same = spark.createDataFrame(rows[::-1], "part string, i int, t string").repartition(3)
    assert {r.part: r.state for r in io.against_manifest(same, frozen, "part", ["i", "t"]).collect()} == {"a": "SAME", "b": "SAME", "c": "SAME", None: "SAME"}
    now = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 3, ""), ("d", 4, "z"), (None, 5, "n")], "part string, i int, t string")
    assert {r.part: r.state for r in io.against_manifest(now, frozen, "part", ["i", "t"]).collect()} == {"a": "CHANGED", "b": "CHANGED", "c": "MISSING", "d": "UNEXPECTED", None: "SAME"}


def test_a_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert [tuple(r) for r in io.read_json_folder(spark, str(tmp_path), "a int").collect()] == [(1, "one.json")]
    (tmp_path / "two.json").write_text('{"a": ')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        io.read_json_folder(spark, str(tmp_path), "a int").collect()
