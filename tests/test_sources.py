"""CSV headers and missing values, and the number of buckets of a table."""

import pytest
from pyspark.sql import functions as F

from meterload.config import Config
from meterload.sources.csv import read_readings
from meterload.sources.tables import read_entities, read_entity, read_table, write_table

CFG = Config(sensors=("air1", "solar", "grid"))


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def values(df):
    return sorted((r.dataid, r.air1, r.solar, r.grid) for r in df.collect())


def test_columns_follow_the_header_of_their_folder(spark, tmp_path):
    write(tmp_path / "a", "1.csv", "dataid,local_15min,air1,solar,grid\n1,2018-06-01 00:00:00-05,1.5,2,3\n")
    write(tmp_path / "b", "1.csv", "solar,x,grid,air1,local_15min,dataid\n2,9,NaN,1.5,2018-06-01 00:00:00-05,2\n")
    assert values(read_readings(spark, f"{tmp_path}/*/*.csv", CFG)) == [(1, 1.5, 2.0, 3.0), (2, 1.5, 2.0, None)]


def test_files_of_one_folder_may_have_different_headers(spark, tmp_path):
    write(tmp_path / "a", "1.csv", "dataid,local_15min,air1,solar,grid\n1,2018-06-01 00:00:00-05,1.5,2,NA\n\n")
    write(tmp_path / "a", "2.csv", 'dataid,local_15min,solar,"a,b",air1,grid\n2,2018-06-01 00:00:00-05,2,"x,y",1.5,\n')
    write(tmp_path / "a", "3.csv", "")
    write(tmp_path / "a", "4.csv", "dataid,local_15min,air1,solar,grid\r\n3,2018-06-01 00:00:00-05,7,8\r\n")
    got = values(read_readings(spark, f"{tmp_path}/a/*.csv", CFG))
    assert got == [(1, 1.5, 2.0, None), (2, 1.5, 2.0, None), (3, 7.0, 8.0, None)]


def test_a_large_file_is_read_in_several_splits(spark, tmp_path):
    rows = "".join(f"{i},2018-06-01 00:00:00-05,{i}.5,1,2\n" for i in range(20_000))
    write(tmp_path / "a", "1.csv", "dataid,local_15min,air1,solar,grid\n" + rows)
    write(tmp_path / "a", "2.csv", "local_15min,dataid,solar,air1,grid\n2018-06-01 00:00:00-05,-1,1,-0.5,2\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100KB")
    try:
        df = read_readings(spark, f"{tmp_path}/a/*.csv", CFG)
        assert df.count() == 20_001 and df.where("air1 <> dataid + 0.5").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_missing_column_and_a_text_that_is_no_number_fail(spark, tmp_path):
    write(tmp_path / "a", "1.csv", "dataid,local_15min,air1,solar\n1,2018-06-01 00:00:00-05,1,2\n")
    with pytest.raises(ValueError, match="grid"):
        read_readings(spark, f"{tmp_path}/a/*.csv", CFG)
    write(tmp_path / "b", "1.csv", "dataid,local_15min,air1,solar,grid\n1,2018-06-01 00:00:00-05,oops,2,3\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_readings(spark, f"{tmp_path}/b/*.csv", CFG).collect()


@pytest.mark.parametrize("buckets", [1, 8, 256])
def test_reads_of_entities_know_the_number_of_buckets(spark, tmp_path, buckets):
    rows = spark.range(40).select((F.col("id") % 10).alias("dataid"), (F.col("id") / 10).cast("int").alias("index"))
    write_table(rows, f"{tmp_path}/t", "dataid", buckets=buckets)
    for value in range(10):
        assert read_entity(spark, f"{tmp_path}/t", "dataid", value).count() == 4
    assert read_entities(spark, f"{tmp_path}/t", "dataid", [1, 5, 77]).count() == 8
    assert read_table(spark, f"{tmp_path}/t").columns == ["dataid", "index"]


def test_appending_another_layout_is_refused(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("dataid"), F.lit(1).alias("index"))
    write_table(rows, f"{tmp_path}/t", "dataid", buckets=8)
    write_table(rows, f"{tmp_path}/t", "dataid", buckets=8, mode="append")
    assert read_table(spark, f"{tmp_path}/t").count() == 20
    for layout, buckets in (("bucket", 4), ("entity", 8)):
        with pytest.raises(ValueError, match="laid out"):
            write_table(rows, f"{tmp_path}/t", "dataid", layout, "append", buckets)
    write_table(rows, f"{tmp_path}/new", "dataid", mode="append")
    assert read_table(spark, f"{tmp_path}/new").count() == 10
