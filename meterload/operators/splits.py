"""Train, validation and test windows. A window is named by the index of its first input row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.config import Config


def _range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, max(first, last + 1)).select(F.col("id").cast("int").alias("win"))


def test_windows(spark: SparkSession, cfg: Config) -> DataFrame:
    return _range(spark, cfg.test_start, cfg.last_window)


def train_windows(spark: SparkSession, cfg: Config) -> DataFrame:
    return _range(spark, 1, cfg.last_train_window)


def split_windows(spark: SparkSession, cfg: Config) -> DataFrame:
    """(split, win): chronological, no window crosses the boundary."""
    train = train_windows(spark, cfg).select(F.lit("train").alias("split"), "win")
    test = test_windows(spark, cfg).select(F.lit("test").alias("split"), "win")
    return train.unionByName(test)


def fold_bounds(cfg: Config, folds: int | None = None) -> list[tuple[int, int]]:
    """First and last window of each fold. Folds are contiguous, differ by at most one row, and
    give up their last windows so that none reaches into the next fold."""
    folds = cfg.folds if folds is None else folds
    share, extra = divmod(cfg.boundary, folds)
    bounds, start = [], 1
    for i in range(folds):
        size = share + (1 if i < extra else 0)
        bounds.append((start, start + size - cfg.span))
        start += size
    return bounds


def kfold_windows(spark: SparkSession, cfg: Config, folds: int | None = None) -> DataFrame:
    """(fold, role, win): each fold validates once and trains with the windows of all others."""
    bounds = fold_bounds(cfg, folds)
    owner = F.lit(None).cast("int")
    for i, (first, last) in enumerate(bounds):
        owner = F.when(F.col("win").between(first, last), F.lit(i)).otherwise(owner)
    windows = _range(spark, 1, cfg.boundary).withColumn("_owner", owner).where("_owner IS NOT NULL")
    fold = F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1)))
    roles = windows.withColumn("fold", fold)
    role = F.when(F.col("fold") == F.col("_owner"), "validation").otherwise("train")
    return roles.select("fold", role.alias("role"), "win")


def holdout(win: Column, cfg: Config, seed: int = 0, method: str = "hash") -> Column:
    """TRUE for about `val_fraction` of the windows. Decided per window, so every task and every
    retry agrees: by an MD5 of seed and window, or by arithmetic ("modulo")."""
    percent = round(cfg.val_fraction * 100)
    if method == "hash":
        digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), win.cast("string")))
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100)) < percent
    return F.pmod(win.cast("bigint") * 7919 + seed, F.lit(100)) < percent


def validation_holdout(spark: SparkSession, cfg: Config, seed: int = 0, method: str = "hash") -> DataFrame:
    """(split, win) over the training windows: "validation" or "train"."""
    split = F.when(holdout(F.col("win"), cfg, seed, method), "validation").otherwise("train")
    return train_windows(spark, cfg).select(split.alias("split"), "win")
