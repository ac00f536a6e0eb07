import gzip
from datetime import date, datetime
from decimal import Decimal

import pytest
from support import rows

from lakestrata.plans.sales import CONTRACT
from lakestrata.session import clear_scratch, scratch_dir, shared_dir, tune_for
from lakestrata.sources import lake, landing
from lakestrata.sources.storage import Files, partition_value

HEADER = "order_id,product_id,quantity,unit_price_brl,order_timestamp,customer_email,status"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path.parent)


def test_landing_path():
    template = "/landing/{yyyy}/{MM}/{dd}/"
    assert landing.landing_path(template, date(2025, 5, 7)) == "/landing/2025/05/07/"
    assert landing.days_between(date(2025, 2, 27), date(2025, 3, 1)) == [date(2025, 2, 27), date(2025, 2, 28), date(2025, 3, 1)]


def test_landing_paths_can_skip_absent_days(spark, tmp_path):
    for day in (1, 3):
        put(tmp_path / f"2025/05/{day:02d}/f.csv", HEADER)
    template = f"{tmp_path}/{{yyyy}}/{{MM}}/{{dd}}/"
    days = landing.days_between(date(2025, 5, 1), date(2025, 5, 4))
    assert len(landing.landing_paths(spark, template, days)) == 4
    assert landing.landing_paths(spark, template, days, skip_missing=True) == [f"{tmp_path}/2025/05/01/", f"{tmp_path}/2025/05/03/"]
    monthly = f"{tmp_path}/{{yyyy}}/{{MM}}"
    assert landing.landing_paths(spark, monthly, days, skip_missing=True) == [f"{tmp_path}/2025/05"]


def test_csv_gets_the_contract_types(spark, tmp_path):
    path = put(tmp_path / "d/f.csv", f"{HEADER}\nO1,P1,3,10.5,2025-05-05T23:30:00Z,a@x,completed\nO2,P1,2,,2025-05-05T01:00:00+02:00,,pending\n")
    df = landing.read_files(spark, path, "csv", CONTRACT.schema("landing"))
    assert df.schema.simpleString() == CONTRACT.schema("landing").simpleString()
    assert rows(df) == [
        ("O1", "P1", 3, Decimal("10.50"), datetime(2025, 5, 5, 23, 30), "a@x", "completed"),
        ("O2", "P1", 2, None, datetime(2025, 5, 4, 23, 0), None, "pending"),
    ]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = put(tmp_path / "d/f.csv", "status,quantity,order_id,extra\ncompleted,3,O1,x\n")
    df = landing.read_files(spark, path, "csv", CONTRACT.schema("landing"))
    assert rows(df, "order_id", "quantity", "status", "extra") == [("O1", 3, "completed", "x")]


def test_csv_file_with_another_header_fails_and_never_misaligns(spark, tmp_path):
    put(tmp_path / "d/a.csv", "order_id,status\nO1,completed\n")
    path = put(tmp_path / "d/b.csv", "status,order_id\ncompleted,O2\n")
    with pytest.raises(Exception, match="header"):
        landing.read_files(spark, path, "csv", CONTRACT.schema("landing")).collect()


def test_bad_cells_become_null_and_the_line_is_kept(spark, tmp_path):
    path = put(tmp_path / "d/f.csv", "order_id,quantity\nO1,three\nO2,2\n")
    df = landing.read_files(spark, path, "csv", CONTRACT.schema("landing"), corrupt_column="_bad")
    assert rows(df) == [("O1", None, "O1,three"), ("O2", 2, None)]


def test_json_and_inference(spark, tmp_path):
    path = put(tmp_path / "d/f.json", '{"order_id": "O1", "quantity": 2}\n{"order_id": "O2", "quantity": "many"}\n')
    df = landing.read_files(spark, path, "json", "order_id string, quantity int", corrupt_column="_bad")
    assert rows(df, "order_id", "quantity") == [("O1", 2), ("O2", None)]
    assert dict(landing.read_files(spark, path, "json").dtypes)["quantity"] == "string"
    csv = put(tmp_path / "c/f.csv", "a,b\n1,x\n")
    assert landing.read_files(spark, csv, "csv").dtypes == [("a", "int"), ("b", "string")]


def test_errors(spark, tmp_path):
    schema = CONTRACT.schema("landing")
    for file_format in ("csv", "json", "parquet"):
        with pytest.raises(FileNotFoundError):
            landing.read_files(spark, str(tmp_path / "nowhere"), file_format, schema)
    (tmp_path / "empty").mkdir()
    with pytest.raises(OSError):
        landing.read_files(spark, str(tmp_path / "empty"), "parquet")
    with pytest.raises(ValueError, match="xml"):
        landing.read_files(spark, str(tmp_path), "xml", schema)


def test_files_of_many_headers_are_read_by_name(spark, tmp_path):
    for k in range(40):
        names = ["order_id", "status"] if k % 2 else ["status", "order_id"]
        values = {"order_id": f"O{k}", "status": "completed"}
        blank = "\n  \n" if k % 5 == 0 else ""
        put(tmp_path / f"d/a b%20{k}.csv", f"{blank}{','.join(names)}\n{','.join(values[name] for name in names)}\n")
    (tmp_path / "d/packed.csv.gz").write_bytes(gzip.compress(b"status,order_id\ncompleted,O40\n"))
    put(tmp_path / "d/empty.csv", "")
    put(tmp_path / "d/blank.csv", "\n \n")
    put(tmp_path / "d/_hidden.csv", "other\n1\n")
    folder = put(tmp_path / "d/wide.csv", "order_id,extra\n" + "O99,x\n" * 50_000)
    spark.sparkContext.setJobGroup("headers", "first lines")
    found = landing.first_lines(spark, Files(spark).glob(f"{folder}/[a-z]*"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) == 0
    assert len(found) == 42 and {line for _, line in found} == {"order_id,status", "status,order_id", "order_id,extra"}
    df = landing.read_mixed(spark, [folder], CONTRACT.schema("landing"), "raw")
    few = df.where("order_id != 'O99'")
    assert sorted(rows(few, "order_id", "status")) == sorted((f"O{k}", "completed") for k in range(41))
    assert df.where("order_id = 'O99' and extra = 'x' and status is null").count() == 50_000
    assert landing.read_mixed(spark, [str(tmp_path / "d/empty.csv")], CONTRACT.schema("landing"), "raw").collect() == []


def test_header_only_is_empty(spark, tmp_path):
    path = put(tmp_path / "d/f.csv", HEADER + "\n")
    assert landing.read_files(spark, path, "csv", CONTRACT.schema("landing")).isEmpty()


# The lake


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "a", 10), (1, "b", 20), (2, "a", 30)], "d int, k string, v int")


def test_writes_count_their_rows(spark, df, tmp_path):
    path = str(tmp_path / "t")
    assert lake.overwrite_table(df, path) == 3
    assert lake.append_rows(df, path) == 3
    assert spark.read.parquet(path).count() == 6
    assert lake.overwrite_table(df.where("v > 10"), path) == 2
    assert rows(spark.read.parquet(path), "v") == [(20,), (30,)]


def test_an_empty_write_counts_zero(spark, df, tmp_path):
    assert lake.overwrite_table(df.where("v > 99"), str(tmp_path / "t")) == 0
    assert lake.overwrite_partitions(df.where("false"), str(tmp_path / "p"), ["d"]) == 0


def test_partitions_in_the_batch_are_replaced_and_others_kept(spark, df, tmp_path):
    path = str(tmp_path / "t")
    lake.overwrite_partitions(df, path, ["d"])
    assert lake.overwrite_partitions(spark.createDataFrame([(2, "c", 99), (3, "c", 1)], df.schema), path, ["d"]) == 2
    assert rows(spark.read.parquet(path), "d", "v") == [(1, 10), (1, 20), (2, 99), (3, 1)]


def test_partition_columns_must_be_there(df, tmp_path):
    with pytest.raises(ValueError, match="order_date"):
        lake.overwrite_partitions(df, str(tmp_path / "t"), ["order_date"])


@pytest.mark.parametrize("hot", [False, True])
def test_a_slice_is_replaced_with_its_inner_partitions(spark, df, tmp_path, hot):
    path = str(tmp_path / "t")
    bulk = (df["k"] == "a") if hot else None
    for day in ("2025-05-05", "2025-05-06"):
        assert lake.overwrite_slice(df, path, {"load": day}, ["k"], bulk) == 3
    assert lake.overwrite_slice(df.where("k = 'b'"), path, {"load": "2025-05-06"}, ["k"], bulk) == 1
    found = spark.read.parquet(path).selectExpr("CAST(load AS STRING)", "k", "v")
    assert rows(found) == [("2025-05-05", "a", 10), ("2025-05-05", "a", 30), ("2025-05-05", "b", 20), ("2025-05-06", "b", 20)]


def test_rows_without_the_bulk_value_are_not_lost(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    assert lake.overwrite_slice(df, str(tmp_path / "t"), {"load": "1"}, ["k"], df["k"] == "a") == 3


def test_a_partition_value_is_written_by_one_task(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8).selectExpr("id % 5 AS d", "id")
    lake.overwrite_partitions(df, str(tmp_path / "t"), ["d"])
    assert len(list((tmp_path / "t").glob("d=*/part-*.parquet"))) == 5


def test_read_slices_lists_and_reads_only_them(spark, df, tmp_path):
    path = str(tmp_path / "t")
    lake.overwrite_partitions(df, path, ["d"])
    found = lake.read_slices(spark, path, [{"d": "2"}])
    assert rows(found, "d", "v") == [(2, 30)]
    assert all("d=2" in name for name in found.inputFiles())


def test_table_metrics(spark):
    df = spark.createDataFrame([("2025-05-05 10:00:00",), ("2025-05-04 10:00:00",), (None,)], "ts string")
    assert rows(lake.table_metrics(df, "t", "ts")) == [("t", 3, date(2025, 5, 5))]
    assert rows(lake.table_metrics(df.where("false"), "t", "ts")) == [("t", 0, None)]


# Storage and session


def test_files(spark, tmp_path):
    put(tmp_path / "a=1/f", "x")
    files = Files(spark)
    assert files.exists(str(tmp_path / "a=1")) and not files.exists(str(tmp_path / "a=2"))
    (path,) = files.glob(f"{tmp_path}/a=*")
    assert partition_value(path, "a") == "1"
    assert files.glob(f"{tmp_path}/b=*") == []
    files.delete(path)
    files.delete(path)
    assert not (tmp_path / "a=1").exists()
    assert partition_value("/a/a=1/b/a=2%3A5/f", "a") == "2:5"
    for path in ("/t/a=1", "/b/a=1"):
        with pytest.raises(ValueError):
            partition_value(path, "b")


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = scratch_dir(spark, "x")
    assert path.startswith(shared_dir(spark) + "/")
    assert path != scratch_dir(spark, "x")
    spark.range(1).write.parquet(path)
    clear_scratch()
    assert not Files(spark).exists(path)


def test_shuffle_partitions_follow_the_size(spark, settings):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst"]
    settings(**{name.replace(".", "__"): spark.conf.get(name) for name in names})
    tune_for(spark, 1024**4)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4096"
    tune_for(spark, 1)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
