import os

import pytest
from pyspark.sql import functions as F

from platewise.functions import text
from platewise.schema import READINGS
from platewise.sources import files, tables
from tests.conftest import rows

TREATMENT = "\n".join([",".join(f"treat{x}" for x in "AAABBBCCCDDD")] * 8) + "\n"
DOSES = "\r\n".join(",".join([d] * 12) for d in ("0", "126", "400", "1265", "4000", "8000", "12640", "16000"))


@pytest.fixture(scope="module")
def rawdata(tmp_path_factory):
    root = tmp_path_factory.mktemp("rawdata")

    def put(name, content):
        path = root / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(content)

    put("RUN_140419_Metadata_treatment.csv", TREATMENT)
    put("RUN_140419_Metadata_doses_treatment.csv", DOSES)
    put("RUN_140419_MFT_1.xls/Z 4000 Hz.csv", "Time (hrs),A1 Z,H12 Z\n0.0,10,20\n0.1,11,\n")
    put("RUN_140419_MFT_1.xls/C 64000 Hz.csv", "Time (hrs),B2 C\n0.0,1e-9\n")
    put("RUN_140419_MFT_1.xls/Comments.csv", "<New Experiment>\n<Mark> Time: 30.5\nx\nStarv\nnoise\n<Mark> Time: 46\n\nGF added\n")
    put("RUN_140419_MFT_1.xls/Details.csv", "title,\n" + "".join(f"key{i},value {i}\n" for i in range(1, 12)))
    head = [f"preamble {i}" for i in range(19)]
    head += ["Time (hrs), Rb (ohm.cm^2), Alpha", "Well, A1, A1", "", ""]
    put("RUN_140419_MFT_1_RbA.csv", "\n".join(head + ["0.5, 1.5, 2.5", "1.0, 3.5, 4.5"]) + "\n")
    put("notes.txt", "nothing")
    return str(root)


def test_list_inputs(spark, rawdata):
    kinds = {os.path.basename(p): k for p, k in rows(files.list_inputs(spark, rawdata, version=1))}
    assert kinds["RUN_140419_Metadata_treatment.csv"] == "layer"
    assert kinds["RUN_140419_MFT_1_RbA.csv"] == "modelled"
    assert "notes.txt" not in kinds
    assert files.list_inputs(spark, rawdata, "layer").count() == 2


def test_ingest_real_files(spark, rawdata):
    out = files.ingest(files.read_texts(spark, rawdata))
    assert rows(out["readings"].select("date", "well", "param", "freq", "time_h", "value")) == [
        ("140419", "A1", "Z", 4000, 0.0, 10.0), ("140419", "A1", "Z", 4000, 0.1, 11.0),
        ("140419", "B2", "C", 64000, 0.0, 1e-9),
        ("140419", "H12", "Z", 4000, 0.0, 20.0), ("140419", "H12", "Z", 4000, 0.1, None)]
    assert rows(out["marks"]) == [("140419", 30.5, "Starv"), ("140419", 46.0, "GF added")]
    assert len(rows(out["details"])) == 8 and rows(out["details"])[7] == ("140419", "key8", "value 8")
    assert rows(out["modelled"]) == [
        ("140419", "A1", "Alpha", 0.5, 2.5), ("140419", "A1", "Alpha", 1.0, 4.5),
        ("140419", "A1", "Rb (ohm.cm^2)", 0.5, 1.5), ("140419", "A1", "Rb (ohm.cm^2)", 1.0, 3.5)]
    layers = out["annotations"]
    assert layers.count() == 192
    by = {(r["layer"], r["well"]): r["value"] for r in layers.collect()}
    assert by["treatment", "A4"] == "treatB" and by["treatment", "H12"] == "treatD"
    assert by["doses_treatment", "D1"] == "1265" and by["doses_treatment", "H12"] == "16000"


def test_plate_layers_version_1(spark, rawdata):
    layers = files.read_plate_layers(spark, rawdata, 1)
    assert {r[0] for r in layers.select("layer").distinct().collect()} == {"treatment", "dosestreatment"}
    assert {r[0] for r in layers.select("date").distinct().collect()} == {"20140419"}
    wide = files.annotations_wide(layers, ["treatment", "dosestreatment"])
    assert wide.where("well = 'C1'").select("treatment", "dosestreatment").first() == ("treatA", "400")


def test_modelled_version_1_is_positional(spark):
    values = ",".join(str(float(i)) for i in range(480))
    content = "\n".join(["x"] * 23 + ["2.0," + values])
    df = spark.createDataFrame([("rawdata/RUN_140419_MFT_1_RbA.csv", content)], "path string, content string")
    got = {(r["well"], r["param"]): (r["value"], r["drift"], r["rmse"]) for r in files.read_modelled_v1(df).collect()}
    assert len(got) == 96 * 3
    assert got["A1", "Rb"] == (0.0, 3.0, 4.0)
    assert got["B1", "Alpha"] == (6.0, 8.0, 9.0)          # wells run down the columns
    assert got["A2", "CellMCap"] == (42.0, 43.0, 44.0)


def test_names_in_paths(spark):
    df = spark.createDataFrame([("/rawdata/RUN_140419_MFT_1.xls",), ("no digits",), ("/a/123456789/b",)], "p string")
    got = rows(df.select("p", text.date_from_path("p", 1).alias("a"), text.date_from_path("p", 2).alias("b")))
    assert got == [("/a/123456789/b", "20123456", "456789"), ("/rawdata/RUN_140419_MFT_1.xls", "20140419", "140419"),
                   ("no digits", None, "no digits")]


def test_reload_is_idempotent_and_dates_prune(spark, tmp_path):
    path = str(tmp_path / "readings")
    df = spark.createDataFrame([(d, "A1", "Z", 4000, float(t), 1.0) for d in ("131213", "140419") for t in range(5)], READINGS)
    tables.write_table(df, path)
    tables.write_table(df.where("date = '140419'"), path, "reload")
    back = tables.read_table(spark, path, READINGS)
    assert rows(back.select(*df.columns)) == rows(df)
    plan = back.where("date = '140419'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    tables.write_table(df, path)
    assert back.sparkSession.read.schema(READINGS).parquet(path).count() == 20
    tables.write_table(df, path, "overwrite")
    assert spark.read.schema(READINGS).parquet(path).count() == 10


def test_export_numbers_rows_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") * 2).alias("v"))
    tables.export_csv(df.repartition(7), path, ["k"])
    back = spark.read.option("header", "true").csv(path, schema="row bigint, k bigint, v bigint")
    assert all(r["row"] == r["k"] + 1 for r in back.collect()) and back.count() == 1000


def test_catalog_listing(spark):
    spark.range(3).selectExpr("id", "cast(id as string) as name").createOrReplaceTempView("listed")
    assert "listed" in {r[0] for r in rows(tables.list_tables(spark))}
    assert rows(tables.list_fields(spark, "listed")) == [(1, "id", "bigint"), (2, "name", "string")]
    assert rows(tables.preview(tables.read_table(spark, "listed"), 2, ["id"])) == [(0, "0"), (1, "1")]


def test_reload_of_workbooks(spark, tmp_path):
    path, schema = str(tmp_path / "books"), "date string, workbook string, well string, value double"
    kind = spark.createDataFrame([], schema).schema

    def load(*rows):
        tables.reload_keyed(spark.createDataFrame(list(rows), schema), path)

    def held():
        return sorted(map(tuple, tables.read_keyed(spark, path, kind).collect()), key=str)

    assert held() == []
    load(("1", "a", "A1", 1.0), ("1", "b", "B1", 2.0), ("1", None, "C1", 3.0), ("01", "a", "A1", 4.0))
    load(("1", "a", "A1", 9.0))  # the other workbook of the date stays, the workbook's other date goes
    assert held() == sorted([("1", "a", "A1", 9.0), ("1", "b", "B1", 2.0), ("1", None, "C1", 3.0)], key=str)
    load(("2", None, "C1", 5.0))
    after = sorted([("1", "a", "A1", 9.0), ("1", "b", "B1", 2.0), ("2", None, "C1", 5.0)], key=str)
    assert held() == after
    load(("1", "a", "A1", 9.0))  # again: nothing changes
    assert held() == after
    broken = spark.createDataFrame([("3", "b", "B1", 1.0)], schema).withColumn("value", F.expr("raise_error('no')").cast("double"))
    with pytest.raises(Exception, match="no"):
        tables.reload_keyed(broken, path)
    assert held() == after
    # rows written, but the manifest not finished: not seen, and the next load of that number says so
    tables.write_table(spark.createDataFrame([("1", "b", "B1", 7.0)], schema), f"{path}/loads/load=lost", "error")
    assert held() == after
    load()
    assert held() == after


def test_field_report(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", None), (None, "", [])], "id long, `a.b` string, tags array<string>")
    assert rows(tables.field_report(df)) == [
        (1, "id", "bigint", 2, 1), (2, "a.b", "string", 2, 1), (3, "tags", "array<string>", 2, 1)]
    assert rows(tables.field_report(df.limit(0))) == [
        (1, "id", "bigint", 0, 0), (2, "a.b", "string", 0, 0), (3, "tags", "array<string>", 0, 0)]


def test_work_on_details_is_spread(spark):
    from checks import fixtures as X
    # the customers lie in one file, which one task reads
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (X.detail_texts, X.twin_detail_texts, X.detail_rows):
        tasks = made(spark, "/root/testdata/sf0.001").rdd.glom().map(len).collect()
        assert len(tasks) == parts and max(tasks) < sum(tasks) / 2


def test_plain_lines_need_no_pattern(spark):
    lines = spark.createDataFrame([('a, b ,,c',), ('"x, y", "z" ,w',), (' "q"',), ('',), (None,)], "line string")
    got = [r[0] for r in lines.select(files._cells(F.col("line"))).collect()]
    assert got == [["a", "b", "", "c"], ["x, y", "z", "w"], ["q"], [""], None]
    plan = lines.select(files._cells(F.col("line")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE" in plan and "regexp_replace" not in plan.split("ELSE", 1)[1]


def test_ingest_reads_its_texts_once(spark):
    sheet, both = "raw/RUN_140419_MFT_1.xls/Z 4000 Hz.csv", "raw/RUN_140420_MFT_1.xls/x_Metadata_GF.csv"
    texts = spark.createDataFrame([(sheet, "Time,A1 Z\n0.5,3"), (both, "Time,B2 R\n1.5,4"), ("raw/notes.txt", "x"), (None, "y")],
                                  "path string, content string")
    out = files.ingest(texts)
    # a file whose name fits two kinds is read as both
    assert rows(out["readings"].select("date", "well", "param", "time_h", "value")) == [
        ("140419", "A1", "Z", 0.5, 3.0), ("140420", "B2", "R", 1.5, 4.0)]
    assert rows(out["annotations"].where("well in ('A1', 'B2')").select("well", "layer", "value")) == [
        ("A1", "GF", "Time"), ("B2", "GF", "4")]
    for name, df in out.items():  # each table opens the folder of its own kind
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "kind" in plan, name
