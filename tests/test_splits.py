from meterload.config import SENSORS, Config
from meterload.operators import splits

DAY = dict(step_seconds=3600)


def span(df, *cols):
    return df.selectExpr("min(win)", "max(win)", "count(*)").first()


def test_default_sizes():
    cfg = Config()
    assert cfg.n_steps == 8832 and cfg.boundary == 7065
    assert (cfg.test_start, cfg.last_window, cfg.last_train_window) == (7066, 8497, 6730)
    assert len(SENSORS) == 75 and len(set(SENSORS)) == 75
    assert len(cfg.appliances) == 74 and len(cfg.consumers) == 71
    assert cfg.active_generators == ("battery1", "solar", "solar2")


def test_default_split(spark):
    cfg = Config()
    assert tuple(span(splits.train_windows(spark, cfg))) == (1, 6730, 6730)
    assert tuple(span(splits.test_windows(spark, cfg))) == (7066, 8497, 1432)


def test_train_outputs_end_at_boundary_and_test_at_last_row():
    cfg = Config()
    assert cfg.last_train_window + cfg.span - 1 == cfg.boundary
    assert cfg.last_window + cfg.span - 1 == cfg.n_steps


def test_three_folds(spark):
    cfg = Config()
    assert splits.fold_bounds(cfg, 3) == [(1, 2020), (2356, 4375), (4711, 6730)]
    rows = splits.kfold_windows(spark, cfg, 3).groupBy("fold", "role").count().collect()
    counts = {(r["fold"], r["role"]): r["count"] for r in rows}
    assert all(counts[f, "validation"] == 2020 and counts[f, "train"] == 4040 for f in range(3))


def test_uneven_folds_give_the_first_ones_the_extra_row():
    cfg = Config(input_size=2, output_size=1)
    sizes = [last - first + cfg.span for first, last in splits.fold_bounds(cfg, 7)]
    assert sum(sizes) == cfg.boundary
    assert sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) == 1


def test_holdout_is_stable_and_near_its_share(spark):
    cfg = Config()
    for method in ("hash", "modulo"):
        first = splits.validation_holdout(spark, cfg, seed=3, method=method)
        share = first.where("split = 'validation'").count() / 6730
        assert abs(share - 0.2) < 0.02
        again = splits.validation_holdout(spark, cfg, seed=3, method=method).repartition(7)
        assert first.exceptAll(again).count() == 0
