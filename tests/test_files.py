"""Folders of differing files, JSON arrays cut anywhere, stores by tenant and sketches by file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import estimates
from tidewell.operators.cleaning import ROW
from tidewell.session import settings
from tidewell.sources import files, store


def rows_of(df):
    return [tuple(r) for r in df.orderBy(ROW).collect()]


def test_files_that_differ(spark, tmp_path):
    """Each file is read by its own traits; columns meet by name; rows are numbered over all files."""
    (tmp_path / "a.csv").write_text("id,name\n1,Zoë\n2,\"b, c\"\n", "utf-8")
    (tmp_path / "b.csv").write_bytes("name;id;since\ncafé – x;3;\"1\n9\"\n".encode("cp1252"))
    (tmp_path / "c [1] {x}.csv").write_bytes("\ufeffid\tplace\n4\tö, ü; ß\n".encode())
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.csv").write_bytes(b"id,name\n")
    (tmp_path / "f.csv").write_bytes("id\n5\n".encode())
    got = files.read_delimited(spark, str(tmp_path))
    assert got.columns == [ROW, "id", "name", "since", "place"]
    assert rows_of(got) == [
        (0, "1", "Zoë", None, None), (1, "2", "b, c", None, None), (2, "3", "café – x", "1\n9", None),
        (3, "4", None, None, "ö, ü; ß"), (4, "5", None, None, None)]
    classes = files.file_classes(spark, str(tmp_path))
    assert [(c["delimiter"], c["encoding"], c["breaks"]) for c in classes] == [
        (",", "UTF-8", False), (";", "windows-1252", True), ("\t", "UTF-8", False), (",", "UTF-8", False)]
    assert len(classes[0]["files"]) == 2  # a and e read alike


def test_many_files_are_few_classes(spark, tmp_path):
    for i in range(40):
        mark = ",;"[i % 2]
        (tmp_path / f"{i:02}.csv").write_text(f"a{mark}b\n{i}{mark}x\n")
    assert len(files.file_classes(spark, str(tmp_path))) == 2
    assert [r[1] for r in rows_of(files.read_delimited(spark, str(tmp_path)))] == [str(i) for i in range(40)]


def test_folder_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="No data rows"):
        files.read_delimited(spark, str(tmp_path))


def test_json_arrays_cut_anywhere(spark, tmp_path):
    rnd = random.Random(4)
    texts = ["}{", '"', "\\", '\\"}', "]", "[{", "", "plain", "ü€😀", "\n\t", ",{", "}\\"]
    made = []
    for n in range(3):
        records = [{"id": f"{n}-{i}", "text": rnd.choice(texts) + rnd.choice(texts), "in": {"list": [1, {"x": rnd.choice(texts)}], "none": None}}
                   for i in range(150 if n else 0)]
        made += records
        (tmp_path / f"{n}.json").write_text(json.dumps(records, indent=n or None, ensure_ascii=n == 1))
    with settings(spark, spark__sql__files__maxPartitionBytes="2000", spark__sql__files__openCostInBytes="0"):
        found = files.array_records(spark, str(tmp_path))
        texts = {(r["file"], r["record"]): r["value"] for r in found.collect()}
        got = files.read_json_array(spark, str(tmp_path), "id string, text string, in struct<list: array<string>>").orderBy(ROW).collect()
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert [json.loads(texts[k]) for k in sorted(texts)] == made
    assert [(r[ROW], r["id"], r["text"]) for r in got] == [(i, m["id"], m["text"]) for i, m in enumerate(made)]
    assert {"id", "text", "in"} <= set(files.read_json_array(spark, str(tmp_path)).columns)


def test_only_the_folders_asked_for_are_read(spark, tmp_path):
    rows = spark.range(600).selectExpr("id", "concat('t', id % 6) as tenant", "id * 2 as v")
    path = str(tmp_path / "store")
    store.write_tenants(rows, path, files=2)
    store.write_tenants(rows.selectExpr("id + 600 as id", "tenant", "v"), path, files=2)  # appended
    with settings(spark, spark__sql__adaptive__enabled="false"):
        one = store.read_tenants(spark, path, ["t3"])
        assert one.count() == 200
        one = one.agg(F.sum("v"))
        one.collect()
        assert 1 <= store.folders_read(one) <= 4
        every = store.read_tenants(spark, path).agg(F.sum("v"))
        every.collect()
        assert store.folders_read(every) >= 12
        asked = spark.createDataFrame([("t1", 1), ("t4", 9), ("none", 1)], "tenant string, w int").where("w > 0")
        joined = store.read_tenants(spark, path, asked)
        assert sorted({r.tenant for r in joined.collect()}) == ["t1", "t4"] and joined.count() == 400
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "t3" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_sketches_of_new_files_only(spark, tmp_path):
    table, held = str(tmp_path / "t.parquet"), str(tmp_path / "sketches")
    spark.range(0, 40_000, 1, 2).selectExpr("id", "cast(id % 900 as double) as few", "cast(null as string) as none").write.parquet(table)
    columns = ["id", "few", "none"]
    assert estimates.update_sketches(spark, table, held, columns) == 2
    assert estimates.update_sketches(spark, table, held, columns) == 0
    spark.range(20_000, 60_000, 1, 1).selectExpr("id", "cast(id % 900 as double) as few", "cast(null as string) as none").write.mode("append").parquet(table)
    assert estimates.update_sketches(spark, table, held, columns) == 1
    got = {r["column"]: r["estimate"] for r in estimates.estimates(spark, table, held).collect()}
    assert abs(got["id"] / 60_000 - 1) < 0.03 and abs(got["few"] / 900 - 1) < 0.03 and got["none"] == 0
