from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.sources import tables


def test_csv_columns_by_name_and_encoding(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("Name,k\nJosé,1\n".encode("latin-1"))
    row = tables.read_csv(spark, str(tmp_path / "f.csv"), ["name", "K", "absent"], "ISO-8859-1").first()
    assert tuple(row) == ("José", "1", None)


def test_year_folders(spark, tmp_path):
    for name in ("vct_2021", "vct_2022", "vct_old"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.csv").write_text("a\nx\n")
    got = tables.read_year_folders(spark, str(tmp_path), "vct", "m.csv", ["a", "b"]).orderBy("year").collect()
    assert [(r.a, r.b, r.year) for r in got] == [("x", None, 2021), ("x", None, 2022)]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    for year, text in ((2021, "Map,Team,K\nBind,Abe,3\n"), (2022, "Team,Map,Kills\nZed,Haven,4\n")):
        (tmp_path / f"vct_{year}").mkdir()
        (tmp_path / f"vct_{year}" / "m.csv").write_text(text)
    got = tables.read_year_folders(spark, str(tmp_path), "vct", "m.csv", ["Map", "Team", "K", "Kills"]).orderBy("year").collect()
    assert [tuple(r) for r in got] == [("Bind", "Abe", "3", None, 2021), ("Haven", "Zed", None, "4", 2022)]
    both = tables.read_csv(spark, [str(tmp_path / f"vct_{y}") for y in (2021, 2022)], ["Team", "Map"])
    assert sorted(map(tuple, both.collect())) == [("Abe", "Bind"), ("Zed", "Haven")]


def test_corrupt_rows_are_kept(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    got = {r.a: (r.b, r[tables.CORRUPT]) for r in tables.read_csv(spark, str(tmp_path / "f.csv"), ["a", "b"], corrupt=True).collect()}
    assert got == {"1": ("2", None), "3": (None, "3"), "4": ("5", "4,5,6")}


def test_csv_round_trip(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("x", "1"), ("y", None)], "a string, b string"), str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), ["a", "b"]).collect())) == [("x", "1"), ("y", None)]


def test_missing_table_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert tables.read_or_empty(spark, "parquet", str(tmp_path / "none"), schema).count() == 0


def test_splits_round_trip(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    tables.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 2


def test_history_store(spark, tmp_path):
    request = '{"team_a":[{"player":"p","agent":"q"}],"team_b":[]}'
    rows = spark.createDataFrame([("m", 2026, "A", 0.7, request, "{}")] * 3, "map string, cutoff_year int, winner string, probability double, request_json string, response_json string")
    tables.append_history(rows, str(tmp_path / "h"))
    store = spark.read.parquet(str(tmp_path / "h"))
    page = tables.history_page(store, 0, -5).collect()
    assert len(page) == 1 and tables.history_get(store, page[0].id).count() == 1
    assert tables.request_lists(store).first().players_a == ["p"]


def test_shallow_patch(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as doc")
    assert tables.patched(df, {"b": "3", "c": "4"}).first().doc == {"a": "1", "b": "3", "c": "4"}


def test_history_store_is_made_only_where_configured(spark, tmp_path):
    path, request = str(tmp_path / "h"), {"map": "m", "cutoff_year": 2026, "team_a": [], "team_b": []}
    response = {"winner": "A", "probability": 0.7}
    assert not tables.init_history(spark, None) and not tables.save_prediction(spark, None, request, response)
    assert tables.init_history(spark, path) and tables.init_history(spark, path) and spark.read.parquet(path).count() == 0
    assert tables.save_prediction(spark, path, request, response) and spark.read.parquet(path).first().winner == "A"


def test_baseline_documents(spark, tmp_path):
    import json

    from matchloom.operators import reports

    reports.write_baseline(spark, str(tmp_path), "2026-01-01T00:00:00Z")
    for name in ("metrics", "validation", "meta"):
        document = json.loads(spark.read.text(str(tmp_path / name)).first().value)
        assert document["test_auc"] == 0.5943 and document["feature_count"] == 421 and document["artifact_contract"] == f"baseline_reference_{name}"


def test_headers_are_found_in_a_constant_number_of_jobs(spark, tmp_path):
    """Many files of three headers, quoted and repeated names among them, an empty file and blank first lines."""
    heads = ["id,name", 'name,"id",extra', "id,name,name"]
    for i in range(60):
        (tmp_path / f"f{i:02d}.csv").write_text(("\n" if i % 5 == 0 else "") + f"{heads[i % 3]}\n" + (f"{i},n{i}\n" if i % 3 == 0 else f"n{i},{i},x\n" if i % 3 == 1 else f"{i},n{i},m{i}\n"))
    (tmp_path / "empty.csv").write_text("")
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    sc.setJobGroup("headers", "headers")
    rows = tables.read_csv(spark, f"{tmp_path}/*.csv", ["id", "name", "extra"])
    jobs = len(tracker.getJobIdsForGroup("headers"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = sorted((int(r.id), r.name, r.extra) for r in rows.collect())
    assert got == [(i, None if i % 3 == 2 else f"n{i}", "x" if i % 3 == 1 else None) for i in range(60)] and jobs <= 6
    assert tables.headers(spark, f"{tmp_path}/*.csv").count() == 60


def test_written_tables_are_read_by_many_tasks(spark):
    """A file has many row groups, so that all cores share it: 24 MB of numbers in one file."""
    from matchloom.sources.shared import written

    back = written(spark.range(0, 3_000_000, 1, 1).selectExpr("xxhash64(id) AS h"), even=False)
    held = [r["count"] for r in back.groupBy("_metadata.file_block_start").count().collect()]
    assert back.count() == 3_000_000 and len(held) >= 2 and max(held) < 3_000_000
