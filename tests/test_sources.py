"""File sources and sinks on small files."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from ratewright.sources import files


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    for _ in range(2):
        files.write_json_lines(df, f"{tmp_path}/t")
    assert sorted(map(tuple, files.read_json_lines(spark, f"{tmp_path}/t", "n long, s string").collect())) == [(1, "a"), (2, None)]
    assert files.read_json_lines(spark, f"{tmp_path}/none", "n long").count() == 0
    (tmp_path / "bad.json").write_text('{"n":1}\n{"n":"x"}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_json_lines(spark, f"{tmp_path}/bad.json", "n long").collect()


def test_label_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"a","rater":"","axes":{"x":1,"y":2.5}}\n\n{"id":"b"}\n')
    good, bad = files.read_label_lines(spark, f"{tmp_path}/l.jsonl")
    (g,) = good.collect()
    assert g.id == "a" and g.rater is None and g.axes == {"x": 1.0, "y": 2.5}
    assert [r.reason for r in bad.collect()] == ["missing axes"]


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes('﻿a,b\r\n"x, ""y""\nz",1\r\n,\r\n'.encode())
    rows = files.read_csv(spark, f"{tmp_path}/c.csv").collect()
    assert rows[0].a == 'x, "y"\nz' and rows[0].b == "1"
    files.append_csv(spark.createDataFrame([('x, "y"\nz', 1), (None, 2)], "a string, b int"), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['"x, ""y"" z",1', ",2"]


def test_image_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"\xff\xd8\xff\xe0 data")
    (tmp_path / "in/b.jpg").write_bytes(b"\xff\xd8\xff\xe0 data")
    (tmp_path / "in/c.png").write_bytes(b"text")
    (tmp_path / "in/d.webp").write_bytes(b"RIFF0000WEBPVP8 ")
    (tmp_path / "in/e.jpg").write_bytes(b"\xff\xd8\xff" + b"0" * 100)
    scan = files.scan_images(spark, f"{tmp_path}/in", most=50)
    got = {r.path[-5:]: (r.mime, r.fault) for r in scan.collect()}
    assert got == {"a.jpg": ("image/jpeg", None), "b.jpg": ("image/jpeg", None), "c.png": (None, "not_an_image"), ".webp": ("image/webp", None), "e.jpg": ("image/jpeg", "too_large")}
    passed, failed = files.dead_letters(scan, "input", "path", "fault")
    assert passed.count() == 3 and failed.count() == 2
    assert files.collisions(passed, passed.where("path like '%a.jpg'")).count() == 2
