"""Tables and models out: what a failed write leaves, what a rewrite replaces, what a saved model refuses."""

import datetime as dt
from dataclasses import replace

import pytest
from conftest import SMALL, day
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, QTY, ForecastConfig, lag_names
from tidecast.operators import daily, maintained
from tidecast.plans import jobs
from tidecast.plans.catalog import QUERIES
from tidecast.sources import loader, models, sinks, tables

CFG = ForecastConfig()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture
def broken(spark):
    """A frame whose tasks fail after some rows have been written."""
    return spark.range(100).withColumn("id", F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("bigint")))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_write_leaves_the_table_as_it_was(spark, broken, tmp_path, fmt):
    path = str(tmp_path / "table")
    with pytest.raises(Exception, match="broken"):
        sinks.save_table(broken, path, fmt=fmt)
    assert list(tmp_path.iterdir()) == []
    sinks.save_table(spark.range(5), path, fmt=fmt)
    with pytest.raises(Exception, match="broken"):
        sinks.save_table(broken, path, fmt=fmt)
    assert spark.read.schema("id bigint").option("header", True).format(fmt).load(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_table_may_be_replaced_by_what_was_read_from_it(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.save_table(spark.range(5), path)
    sinks.save_table(spark.read.parquet(path).where("id > 2"), path + "/")
    assert rows_of(spark.read.parquet(path)) == [(3,), (4,)]


def test_one_split_is_rewritten_and_the_others_stay(spark, broken, tmp_path):
    path = str(tmp_path / "splits")
    rows = spark.createDataFrame([(1, "train"), (2, "train"), (3, "valid"), (4, "test")], "qty int, split string")
    sinks.save_splits(rows, path)
    sinks.replace_splits(spark.createDataFrame([(9, "train")], "qty int, split string"), path)
    with pytest.raises(Exception, match="broken"):
        sinks.replace_splits(broken.select(F.col("id").cast("int").alias("qty"), F.lit("valid").alias("split")), path)
    assert rows_of(spark.read.parquet(path), "qty", "split") == [(3, "valid"), (4, "test"), (9, "train")]


def test_csv_cells_come_back_as_they_were(spark, tmp_path):
    cells = ['6" boot, brown', '"quoted"', "back\\slash\\", 'ends with \\"', "", None, " space ", "ünï,cödé", "'single'"]
    rows = spark.createDataFrame(list(enumerate(cells)), "id bigint, name string")
    sinks.save_table(rows, str(tmp_path / "t"), fmt="csv")
    again = loader.read_csv(spark, str(tmp_path / "t"), {"id": "bigint"})
    assert rows_of(again.where("name is not null")) == [(k, c) for k, c in enumerate(cells) if c]
    assert rows_of(again.where("name is null"), "id") == [(4,), (5,)]


def _items(spark, rows):
    return spark.createDataFrame([(c, dt.datetime.combine(day(d), dt.time(5))) for c, d in rows], f"{CENTER} bigint, created_at timestamp")


def test_maintained_demand_equals_that_of_all_facts(spark, tmp_path):
    path = str(tmp_path / "kept")
    loads = {"2024-01-01": [(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-01")], "2024-01-02": [(1, "2024-01-02"), (1, "2024-01-01"), (None, "2024-01-02")], "late": [(2, "2023-12-30")]}
    assert maintained.loads(spark, path) == []
    for name, rows in loads.items():
        maintained.ingest(_items(spark, rows), path, name)
    maintained.ingest(_items(spark, loads["late"]), path, "late")  # once more
    want = rows_of(daily.daily_demand(_items(spark, [r for rows in loads.values() for r in rows])).select(CENTER, DATE, QTY))
    assert rows_of(maintained.maintained_demand(spark, path), CENTER, DATE, QTY) == want
    assert maintained.loads(spark, path) == ["2024-01-01", "2024-01-02", "late"]
    maintained.compact(spark, path)
    assert maintained.loads(spark, path) == ["base"] and rows_of(maintained.maintained_demand(spark, path), CENTER, DATE, QTY) == want
    maintained.ingest(_items(spark, [(2, "2023-12-30")]), path, "more")
    assert dict(((c, d), q) for c, d, q in rows_of(maintained.maintained_demand(spark, path), CENTER, DATE, QTY))[2, day("2023-12-30")] == 2
    for bad in ("base", "a/b", ""):
        with pytest.raises(ValueError):
            maintained.ingest(_items(spark, []), path, bad)


def test_a_new_load_reads_its_own_facts_only(spark, tmp_path):
    """What a load writes is its own partition; the plan that merges reads counts, not facts."""
    items = tables.order_items(spark, SMALL, "created_at", CENTER)
    for name, rows in (("a", daily.before(items, "created_at", day("1998-01-01"))), ("b", daily.since(items, "created_at", day("1998-01-01")))):
        maintained.ingest(rows, str(tmp_path / "kept"), name)
    merged = maintained.maintained_demand(spark, str(tmp_path / "kept"))
    assert "lineitem" not in merged._jdf.queryExecution().toString()
    assert rows_of(merged, CENTER, DATE, QTY) == rows_of(daily.daily_demand(items), CENTER, DATE, QTY)


def test_facts_are_summed_before_any_dimension_is_joined(spark):
    """In the plan of sales by category the partial sums over products lie under both joins with dimensions."""
    plan = QUERIES["demand_by_category"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [k for k, line in enumerate(plan.splitlines()) if "Join LeftOuter" in line]
    sums = [k for k, line in enumerate(plan.splitlines()) if "Aggregate [product_id" in line]
    parts = [k for k, line in enumerate(plan.splitlines()) if "part.parquet" in line or "p_partkey" in line]
    assert len(sums) == 1 and parts and sums[0] > joins[0] and any(k > sums[0] for k in joins)


def _save(spark, root, cfg, value=1.0, fail=False):
    def write(folder):
        sinks.save_linear(spark.createDataFrame([(1, 5, [value], [[value]])], f"{CENTER} bigint, n_rows bigint, intercepts array<double>, weights array<array<double>>"), f"{folder}/model")
        if fail:
            raise OSError("disk full")
    return models.publish(spark, root, models.Manifest.of(jobs.LINEAR, cfg, lag_names(cfg.lags)), write)


def test_versions_of_a_model_are_kept_and_failed_saves_are_none(spark, tmp_path):
    root, cfg = str(tmp_path / "model"), replace(CFG, lags=1, horizons=1)
    with pytest.raises(FileNotFoundError):
        jobs.load_best(spark, root)
    assert _save(spark, root, cfg, 1.0) == 1
    with pytest.raises(OSError):
        _save(spark, root, cfg, 2.0, fail=True)
    assert jobs.load_best(spark, root, cfg)[1].coefficients.first().intercepts == [1.0]
    assert _save(spark, root, cfg, 3.0) == 2
    assert [jobs.load_best(spark, root, version=v)[1].coefficients.first().intercepts for v in (1, 2, None)] == [[1.0], [3.0], [3.0]]
    with pytest.raises(FileNotFoundError):
        jobs.load_best(spark, root, version=7)


@pytest.mark.parametrize("other", [{"lags": 2}, {"horizons": 3}, {"series": (CENTER, "product_id")}, {"state_holidays": ()}, {"per_split": True}, {"year_freq_fit_on": "split"}])
def test_a_saved_model_refuses_other_settings(spark, tmp_path, other):
    root, cfg = str(tmp_path / "model"), replace(CFG, lags=1, horizons=1)
    _save(spark, root, cfg)
    wrong = replace(cfg, **other)
    with pytest.raises(models.ConfigMismatch, match=next(iter(other))):
        jobs.load_best(spark, root, wrong)
    name, model = jobs.load_best(spark, root)
    frame = spark.createDataFrame([(1, day("2024-02-03"), 4, 2, 7)], f"{CENTER} bigint, {DATE} date, {QTY} bigint, `{QTY}_D-1` bigint, `y_D+1` bigint")
    with pytest.raises(models.ConfigMismatch, match=next(iter(other))):
        jobs.batch_predict(frame, model, wrong)
    # What does not shape features or targets may differ.
    predictions, errors = jobs.batch_predict(frame, model, replace(cfg, valid_from=dt.date(2023, 1, 1), centers=(1,)))
    assert name == jobs.LINEAR and predictions.first()["y_D+1"] == 3.0 and errors.first().n == 1


def test_a_changed_manifest_is_noticed(spark, tmp_path):
    root, cfg = str(tmp_path / "model"), replace(CFG, lags=1, horizons=1)
    _save(spark, root, cfg)
    changed = models.manifests(spark, root).withColumn("lags", F.lit(9)).collect()
    spark.createDataFrame(changed, models.SCHEMA).write.mode("overwrite").parquet(f"{root}/v000001/manifest")
    with pytest.raises(ValueError, match="hash"):
        jobs.load_best(spark, root)
