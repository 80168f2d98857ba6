"""User aggregates against pandas, hot keys, NULL keys, and functions of files."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterload.operators import hooks

#: Mean and longest text, from counts, sums and maxima.
SPREAD = hooks.UserAggregate(
    chunk=lambda g: pd.DataFrame({"n": g["v"].count(), "s": g["v"].sum(), "longest": g["t"].max()}),
    agg=lambda g: pd.DataFrame({"n": g["n"].sum(), "s": g["s"].sum(), "longest": g["longest"].max()}),
    finalize=lambda f: pd.DataFrame({"mean": f["s"] / f["n"].where(f["n"] > 0), "longest": f["longest"]}),
    state="n LONG, s DOUBLE, longest STRING", result="mean DOUBLE, longest STRING")


def table(spark, n=4000, hot=0.4):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        key = 7 if rng.random() < hot else rng.choice([None, *range(300)])
        rows.append((key, rng.choice(["a", None, "b"]), float(rng.randrange(100)), f"t{rng.randrange(1000):04d}"))
    return rows, spark.createDataFrame(rows, "k long, part string, v double, t string").repartition(13)


@pytest.mark.parametrize("keys", [["k"], ["k", "part"]])
@pytest.mark.parametrize("levels, fan_in, held", [(2, 64, 50_000), (1, 3, 10), (3, 2, 7), (0, 64, 1)])
def test_user_aggregate_equals_pandas(spark, monkeypatch, keys, levels, fan_in, held):
    monkeypatch.setattr(hooks, "FAN_IN", fan_in)
    monkeypatch.setattr(hooks, "HELD", held)
    rows, df = table(spark, 1500)
    got = {tuple(r[k] for k in keys): (r["mean"], r.longest) for r in hooks.user_aggregate(df, keys, ["v", "t"], SPREAD, levels).collect()}
    want = {}
    for k, part, v, t in rows:
        want.setdefault((k, part)[:len(keys)], []).append((v, t))
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key][0] == pytest.approx(sum(v for v, _ in values) / len(values))
        assert got[key][1] == max(t for _, t in values)


def test_a_hot_key_leaves_a_task_as_one_state(spark):
    """Rows that cross between tasks: states only, at most one per key and task."""
    _, df = table(spark, 6000, hot=1.0)
    seen = spark.sparkContext.accumulator(0)

    def counted(groups):
        seen.add(len(groups.obj))
        return SPREAD.agg(groups)

    watched = hooks.UserAggregate(SPREAD.chunk, counted, SPREAD.finalize, SPREAD.state, SPREAD.result)
    out = hooks.user_aggregate(df, ["k"], ["v", "t"], watched).collect()
    assert len(out) == 1 and seen.value < 13 * 6


def test_no_keys_no_rows_and_wrong_functions(spark):
    rows, df = table(spark, 300)
    out = hooks.user_aggregate(df, [], ["v", "t"], SPREAD).collect()
    assert len(out) == 1 and out[0]["mean"] == pytest.approx(sum(r[2] for r in rows) / len(rows))
    assert hooks.user_aggregate(df.where("v < 0"), ["k"], ["v", "t"], SPREAD).collect() == []
    bad = hooks.UserAggregate(lambda g: g["v"].sum(), SPREAD.agg, SPREAD.finalize, SPREAD.state, SPREAD.result)
    with pytest.raises(Exception, match="one row per group"):
        hooks.user_aggregate(df, ["k"], ["v", "t"], bad).collect()


def test_map_files_gives_each_file_its_path(spark, tmp_path):
    for home in ("a", "b"):
        (tmp_path / f"home={home}").mkdir()
        (tmp_path / f"home={home}" / "x.csv").write_text("".join(f"{i}\n" for i in range(5)))
    df = spark.read.text(f"{tmp_path}/*/x.csv").select("value", F.col("_metadata.file_path").alias("path")).coalesce(1)

    def named(rows, path):
        assert list(rows.columns) == ["value"] and len(rows) <= 5
        return rows.assign(home=path.split("home=")[1][0], n=rows["value"].astype(int))

    out = hooks.map_files(df, named, "home STRING, n LONG")
    assert sorted(map(tuple, out.collect())) == [(h, i) for h in "ab" for i in range(5)]
    assert hooks.map_files(df.where("value = 'none'"), named, "home STRING, n LONG").collect() == []


def test_map_files_gathers_the_rows_of_a_file(spark):
    """Rows of files lie mixed in the table; the function still runs about once per file, not once per row."""
    rows = [(f"home={i % 7}", i) for i in range(700)]
    df = spark.createDataFrame(rows, "path STRING, value LONG")

    def counted(frame, path):
        return pd.DataFrame({"path": [path], "n": [len(frame)], "total": [frame["value"].sum()]})

    out = hooks.map_files(df, counted, "path STRING, n LONG, total LONG").collect()
    assert len(out) < 100 and sum(r["n"] for r in out) == 700
    totals = {}
    for r in out:
        totals[r["path"]] = totals.get(r["path"], 0) + r["total"]
    assert totals == {f"home={k}": sum(i for i in range(700) if i % 7 == k) for k in range(7)}
