"""Trees of small files on a local file system: as Spark writes and reads them, without a cost per file on the driver."""

import glob
import gzip
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meterload.sources import local
from meterload.sources.csv import read_training_logs, write_tree
from meterload.sources.schema import TRAINING_LOG

HEADER = "epoch,loss,root_mean_squared_error\n"


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def same_as_spark(spark, path):
    want = spark.read.option("header", True).schema(TRAINING_LOG).csv(path)
    return rows(read_training_logs(spark, path)) == rows(want.select(*TRAINING_LOG.names, "_metadata.file_path"))


def content(root):
    """Lines by folder, and the names of folders as they are."""
    found = {}
    for file in glob.glob(f"{root}/**/part-*", recursive=True):
        with open(file, newline="") as f:
            found.setdefault(os.path.relpath(os.path.dirname(file), root), []).append(f.read())
    return {k: sorted("".join(v).split("\n")) for k, v in found.items()}


def test_many_files_need_no_more_tasks_and_no_sidecars(spark, tmp_path):
    logs = spark.range(600).selectExpr(
        "CAST(id % 300 AS STRING) AS household", "'car1' AS appliance", "CAST(id DIV 300 AS INT) AS epoch",
        "id / 8D AS loss", "id / 4D AS root_mean_squared_error")
    write_tree(logs, f"{tmp_path}/t", ["household", "appliance"])
    names = [n for _, _, files in os.walk(f"{tmp_path}/t") for n in files]
    assert len(names) == 301 and "_SUCCESS" in names and not [n for n in names if n.startswith(".")]
    back = read_training_logs(spark, f"{tmp_path}/t/household=*/appliance=*/*.csv")
    assert back.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.regexp_extract("path", r"household=(\d+)/appliance=car1/part-", 1)
    assert sorted(map(tuple, back.select(path, "epoch", "mae", "rmse").collect())) == sorted(
        (str(i % 300), i // 300, i / 8, i / 4) for i in range(600))


def test_a_tree_is_written_as_spark_writes_it(spark, tmp_path):
    keys = [None, "", "a", "a b", "x/y=%z", "ü:{[^'\"\\", "1"]
    texts = [None, "", "plain", ' led "quoted", \\ and, more', "ü ", " two "]
    made = [(a, b, t, i, i / 3, None) for i, (a, b, t) in enumerate(
        (a, b, t) for a in keys for b in (1, None) for t in texts for _ in range(2))]
    df = spark.createDataFrame(made, "k STRING, n INT, text STRING, `id, no` INT, part DOUBLE, day DATE")
    df = df.withColumn("day", F.date_add(F.lit("2024-01-01"), F.col("id, no")))
    write_tree(df, f"{tmp_path}/ours", ["k", "n"])
    df.repartition(4, "k", "n").write.partitionBy("k", "n").option("header", True).csv(f"{tmp_path}/spark")
    got, want = content(f"{tmp_path}/ours"), content(f"{tmp_path}/spark")
    # Spark's writer deals NULL and "" to different tasks, which give their common folder two files with headers.
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(set(v)) for k, v in want.items()}
    assert sum(len(v) for v in got.values()) - len(got) * 2 == len(made)
    one = df.select("k", "text")
    write_tree(one, f"{tmp_path}/ours1", ["k"])
    one.repartition(4, "k").write.partitionBy("k").option("header", True).csv(f"{tmp_path}/spark1")
    assert {k: set(v) for k, v in content(f"{tmp_path}/ours1").items()} == {
        k: set(v) for k, v in content(f"{tmp_path}/spark1").items()}


def test_a_key_of_many_batches_is_one_file(spark, tmp_path):
    df = spark.range(45_000).selectExpr("CAST(id DIV 40000 AS STRING) AS k", "id")
    write_tree(df, f"{tmp_path}/t", ["k"])
    got = content(f"{tmp_path}/t")
    assert {k: len(v) for k, v in got.items()} == {"k=0": 40_002, "k=1": 5_002}
    assert len(glob.glob(f"{tmp_path}/t/k=*/*")) == 2


def test_an_empty_tree_an_old_one_and_a_failed_one(spark, tmp_path):
    write_tree(spark.range(0).selectExpr("id AS k", "id AS v"), f"{tmp_path}/none", ["k"])
    assert os.listdir(f"{tmp_path}/none") == ["_SUCCESS"]
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_tree(spark.range(3).selectExpr("id AS k", "id AS v"), f"{tmp_path}/none", ["k"])
    bad = spark.range(300).selectExpr("id AS k", "IF(id = 299, raise_error('no'), id) AS v")
    with pytest.raises(Exception, match="no"):
        write_tree(bad, f"{tmp_path}/bad", ["k"])
    assert not os.path.exists(f"{tmp_path}/bad")


def odd_tree(folder):
    for name, data in {
        "a 1/x=1/log.csv": HEADER + "0,1.5,2\n1,,3\n",
        "a 1/x=2/log.csv": HEADER.replace("\n", "\r\n") + "0,1.5,2\r\n\r\n  \r\n2,2.5,NaN\r\n",
        "a%2/x=1/log.csv": "﻿" + HEADER + "5,oops,1\n6,1\n7,1,2,3\n\n",
        "aü+(;&/x=1/log.csv": "\n \n" + HEADER + '"8","1.5","2"\n' + HEADER + "9,1,1",
        "a3/x=1/log.csv": "", "a3/x=2/log.csv": HEADER, "a3/x=3/.log.csv": HEADER + "1,1,1\n",
        "a3/x=4/_log.csv": HEADER + "1,1,1\n", "a3/x=5/_k=log.csv": HEADER + "4,4,4\n", "a3/log.csv": HEADER + "3,3,3\n",
        "a3/x=6/y/log.csv": HEADER + "1,1,1\n", "a3/x=7/log.txt": HEADER + "1,1,1\n", "a3/x=8/log.csv": HEADER + "1,1,1\r2,2,2\r",
        "b/x=1/log.csv": HEADER + "1,1,1\n", "a4": "x",
    }.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data.encode())


def test_logs_are_read_as_spark_reads_them(spark, tmp_path):
    odd_tree(tmp_path)
    for pattern in ("a*/x=*/*.csv", "a?/x=?/*log.csv", "a3/x=*/*.csv", "*/log.csv", "a3/*", "{a3,b}/x=*/*.csv", "a[3]/x=[1-8]/*.csv"):
        assert same_as_spark(spark, f"{tmp_path}/{pattern}"), pattern
    assert same_as_spark(spark, f"{tmp_path}/b/x=1/log.csv") and same_as_spark(spark, f"file://{tmp_path}/a3/x=*/*.csv")
    assert local.list_files(spark, f"{tmp_path}/a*/x=*/*.csv") is not None
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_training_logs(spark, f"{tmp_path}/a*/y=*/*.csv")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_training_logs(spark, f"{tmp_path}/none/y=*/*.csv")
    both = [f"{tmp_path}/a3/x=*/*.csv", f"{tmp_path}/b/x=*/*.csv"]
    assert read_training_logs(spark, both).count() == 4


def test_packed_files_are_left_to_spark(spark, tmp_path):
    for i, name in enumerate(("log.csv", "log.csv.gz")):
        (tmp_path / f"x={i}").mkdir()
        data = (HEADER + f"{i},1,2\n").encode()
        (tmp_path / f"x={i}" / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    assert local.list_files(spark, f"{tmp_path}/x=*/log*") is None
    assert sorted(r["epoch"] for r in read_training_logs(spark, f"{tmp_path}/x=*/log*").collect()) == [0, 1]


def test_blocks_of_a_file_share_out_its_lines(spark, tmp_path, monkeypatch):
    lines = [f"{i},{'1' * (i % 7 + 1)},2" for i in range(40)]
    for end in ("\n", "\r\n", "\n\n"):
        (tmp_path / "log.csv").write_bytes((HEADER.strip() + end + end.join(lines)).encode())
        size = os.path.getsize(tmp_path / "log.csv")
        for block in (1, 3, 10, 64, size, 10 * size):
            parts = [local._chunks(str(tmp_path / "log.csv"), s, min(s + block, size)) for s in range(0, size, block)]
            assert [x.decode() for part in parts for chunk in part for x in chunk] == lines
    monkeypatch.setattr(local, "BLOCK", 50)
    assert local.list_files(spark, f"{tmp_path}/*.csv").count() > 5
    assert same_as_spark(spark, f"{tmp_path}/*.csv")
