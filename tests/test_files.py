"""Text sources: given schemas, years from paths, reports that cannot be read."""

import json

from pyspark.sql import functions as F

from heliograde.sources import files


def test_yearly_files(spark, tmp_path):
    for name, value in (("gen_2019.csv", 1.5), ("gen_2021.csv", 2.5), ("other.csv", 9.0)):
        (tmp_path / name).write_text(f"id,power\n1,{value}\n2,\n")
    got = files.read_yearly(spark, str(tmp_path), "id bigint, power double", ["power"])
    assert sorted((r.gen_year or 0, r.power or 0.0) for r in got.collect()) == [(0, 0.0), (0, 9.0), (2019, 0.0), (2019, 1.5), (2021, 0.0), (2021, 2.5)]
    assert got.columns == ["power", "gen_year"]


def test_reports(spark, tmp_path):
    rows = [{"id": 1, "folds": [{"roc": 0.5}, {"roc": 0.7}]}, {"id": 2, "folds": []}, {"id": 3}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\n{not json\n")
    got = files.read_json_reports(spark, str(tmp_path), "id bigint, folds array<struct<roc: double>>", lines=True).cache()
    assert got.filter(f"{files.BAD} IS NOT NULL").count() == 1
    up = files.roll_up(got.filter("id IS NOT NULL"), "id", "folds", [F.count("roc").alias("n"), F.max("roc").alias("best")])
    assert sorted((r.id, r.n, r.best) for r in up.collect()) == [(1, 2, 0.7), (2, 0, None), (3, 0, None)]
    one = tmp_path / "one"
    one.mkdir()
    (one / "b.json").write_text(json.dumps(rows[0], indent=2))
    assert files.read_json_reports(spark, str(one), "id bigint").count() == 1
