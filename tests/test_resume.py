"""Runs that go on where others stopped, tables that grow, and what is said of each image."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintframe import __main__ as command
from flintframe.options import Options
from flintframe.plans import batch
from flintframe.sources import metadata, metrics

from .test_sources import drawing, png

META = "image_id string, scale_id string, scale string"


def lines(spark, path):
    return sorted(map(str, metrics.read_csv(spark, str(path)).collect()))


def test_append_in_the_columns_that_are_there(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([("a", "Dorsal", 1.5), ("a", "scar 1", None)], "image_id string, surface_feature string, total_area double")
    metrics.append_csv(one, path)
    columns = metrics.header(spark, path)
    two = spark.createDataFrame([("b", 2.5, "new")], "image_id string, total_area double, another string")
    metrics.append_csv(two, path)
    metrics.append_csv(two, path)
    assert metrics.header(spark, path) == columns and "another" not in columns
    got = {(r.image_id, r.surface_feature): r.total_area for r in metrics.read_csv(spark, path).collect()}
    assert got == {("a", "Dorsal"): 1.5, ("a", "scar 1"): None, ("b", None): 2.5}
    metrics.append_csv(two.withColumn("total_area", F.lit(9.0)), path, replace=False)
    assert {r.total_area for r in metrics.read_csv(spark, path).where("image_id = 'b'").collect()} == {2.5}
    metrics.append_csv(one.limit(1).withColumn("total_area", F.lit(7.0)), path)
    assert [(r.surface_feature, r.total_area) for r in metrics.read_csv(spark, path).where("image_id = 'a'").collect()] == [("Dorsal", 7.0)]
    wide = spark.createDataFrame([("c", "x", 1)], "image_id string, own string, scar_count int")
    metrics.write_csv(wide, path)  # a table with a column of its own keeps it
    metrics.append_csv(spark.createDataFrame([("d", "y")], "image_id string, own string"), path)
    assert sorted(r.own for r in spark.read.option("header", True).csv(path).collect()) == ["x", "y"]


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_rows_to_be_added_are_computed_once(spark, tmp_path, codec):
    path, seen = str(tmp_path / "m"), spark.sparkContext.accumulator(0)
    metrics.write_csv(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "image_id string, total_area double"), path)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    made = lambda *ids: spark.createDataFrame([(i, 2.0) for i in ids], "image_id string, total_area double").coalesce(1).mapInPandas(counted, "image_id string, total_area double")
    metrics.append_csv(made("b", "c"), path, codec=codec)  # an image comes again
    assert seen.value == 2
    metrics.append_csv(made("d"), path, codec=codec)  # none does
    assert seen.value == 3
    assert {r.image_id: r.total_area for r in metrics.read_csv(spark, path).collect()} == {"a": 1.0, "b": 2.0, "c": 2.0, "d": 2.0}
    assert metrics.read_csv(spark, path).count() == 4 and not (tmp_path / "m.next").exists()
    assert len({p.suffix for p in (tmp_path / "m").glob("part-*")}) == 1


def test_replacement_that_stopped(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("a", 1.0)], "image_id string, total_area double")
    metrics.write_csv(rows, f"{path}.next")
    metrics.recover(spark, path)  # the old table was gone already
    assert metrics.read_csv(spark, path).count() == 1 and not (tmp_path / "m.next").exists()
    metrics.write_csv(rows.withColumn("image_id", F.lit("b")), f"{path}.next")
    metrics.recover(spark, path)  # the old table is still there: it holds
    assert metrics.read_csv(spark, path).first().image_id == "a" and not (tmp_path / "m.next").exists()
    metrics.recover(spark, path)


@pytest.fixture
def folder(tmp_path):
    own = tmp_path / "data" / "images"
    own.mkdir(parents=True)
    for k, name in enumerate("abd"):
        px = drawing()
        px[12 + k : 14 + k, 12:14] = 240
        (own / f"{name}.png").write_bytes(png(px, 300 if k else None))
    (own / "e.png").write_bytes(b"broken")
    (own / "blank.png").write_bytes(png(np.full((20, 20, 1), 240, np.uint8), 1200))
    return tmp_path / "data"


def test_a_stopped_run_goes_on(spark, folder, tmp_path, monkeypatch):
    ids = ["d", "b", "e", "missing", "a", "blank"]
    meta = spark.createDataFrame([(i, None, None) for i in ids], META)
    whole, status = batch.run(spark, str(folder / "images"), meta)
    batch.save(whole, status, str(tmp_path / "once"))
    out = str(tmp_path / "out")
    write, calls = metrics.write_manifest, []

    def stops(*given):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("stopped")
        write(*given)

    monkeypatch.setattr(metrics, "write_manifest", stops)
    with pytest.raises(RuntimeError):  # after rows are saved, before the manifest has their images
        batch.resume(spark, str(folder / "images"), meta.where("image_id in ('a', 'b')"), out)
    monkeypatch.undo()
    again = batch.resume(spark, str(folder / "images"), meta, out)
    assert again["failed"] == 1 and again["images"] == 5 and again["contours"] > 0
    assert lines(spark, f"{out}/processed_metrics") == lines(spark, tmp_path / "once" / "processed_metrics") != []
    plain = lambda f: sorted((r.image_id, r.ok, r.dpi, r.reason) for r in metrics.read_manifest(spark, str(f)).collect())
    assert plain(f"{out}/run_summary") == plain(tmp_path / "once" / "run_summary") and len(plain(f"{out}/run_summary")) == 6
    documents = lambda f: sorted(json.dumps(json.loads(x), sort_keys=True) for p in (f / "json").rglob("part-*.json") for x in p.read_text().splitlines())
    assert documents(tmp_path / "out") == documents(tmp_path / "once")


def test_what_is_said_of_images(spark, folder, tmp_path):
    ids = ["d", "missing", "blank", "a", "e"]
    meta = spark.createDataFrame([(i, "bar" if i == "d" else None, "x" if i == "d" else None) for i in ids], META).coalesce(1)
    options = Options().update(dpi__enabled=True)
    rows, status = batch.run(spark, str(folder / "images"), meta, options=options)
    got = {r.image_id: r.messages for r in status.collect()}
    assert got["a"][0].startswith("the file has no resolution") and "no scale" in got["a"][1]
    assert "limited to" in got["blank"][0] and got["blank"][1] == "no contour is left after the filters"
    assert [m[:9] for m in got["d"]] == ["the scale"] and got["missing"] == [] == got["e"]
    batch.save(rows, status, str(tmp_path / "out"), options)
    body = json.loads(next((tmp_path / "out" / "run_summary").glob("part-*.json")).read_text())
    assert [m["image_id"] for m in body["messages"]] == ["d", "blank", "a"]
    back = {r.image_id: r.messages for r in metrics.read_manifest(spark, str(tmp_path / "out" / "run_summary"), True).collect()}
    assert back == {k: v for k, v in got.items()}


def test_filters_that_leave_nothing(spark, folder):
    meta = spark.createDataFrame([("b", None, None)], META)
    _, status = batch.run(spark, str(folder / "images"), meta, options=Options().update(filtering__min_area=1e9))
    assert "no contour is left after the filters" in status.first().messages


def test_command_goes_on_and_checks_folders(spark, folder, tmp_path, capsys):
    meta = tmp_path / "meta.csv"
    meta.write_text("image_id,scale_id,scale\na,,\n")
    base = ["--meta_file", str(meta), "--output_dir", str(tmp_path / "out"), "--disable_json"]
    assert command.main(["--data_dir", str(folder), *base, "--resume"]) == 0
    meta.write_text("image_id,scale_id,scale\na,,\nb,,\n")
    assert command.main(["--data_dir", str(folder), *base, "--resume", "--parts", "2"]) == 0
    said = capsys.readouterr().out
    assert said.count("1 more images measured") == 2 and "2 of 2 images measured" in said
    assert command.main(["--data_dir", str(tmp_path / "none"), *base]) == 2
    (tmp_path / "empty").mkdir()
    assert command.main(["--data_dir", str(tmp_path / "empty"), *base]) == 2 and "images is missing" in capsys.readouterr().err
    assert metadata.missing_folders(spark, str(folder)) == []
