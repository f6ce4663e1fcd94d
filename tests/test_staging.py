import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
import pytest
from conftest import SMALL

from tidecast.staging import drop_staged, dropping_staged, shared_folder, stage, unstage


def test_staged_rows_come_back_until_dropped(spark):
    staged = stage(spark.range(5).withColumnRenamed("id", "qty_D-1"))
    assert staged.columns == ["qty_D-1"] and staged.count() == 5
    path = Path(staged.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and str(path).startswith(shared_folder(spark).removeprefix("file:"))
    assert drop_staged(spark) >= 1 and not path.exists()
    assert drop_staged(spark) == 0


def test_one_staged_table_goes_alone(spark):
    drop_staged(spark)
    one, two = stage(spark.range(2)), stage(spark.range(3))
    path = Path(one.inputFiles()[0].removeprefix("file://")).parent
    unstage(one)
    assert not path.exists() and two.count() == 3 and drop_staged(spark) == 1


def test_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.schema == contract.queries()["features_qty_lags"](spark, SMALL).schema and df.count() > 0


def test_a_block_drops_only_what_it_staged(spark):
    kept = stage(spark.range(3))
    with dropping_staged(spark):
        inner = stage(spark.range(4))
        path = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
    assert not path.exists() and kept.count() == 3
    assert drop_staged(spark) >= 1


def test_tables_of_a_database_keep_their_buckets(spark):
    from tidecast.sources import sinks, tables

    spark.sql("CREATE DATABASE IF NOT EXISTS star")
    try:
        for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
            sinks.save_bucketed(tables.table(spark, SMALL, name), f"star.{name}", (key,), 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = tables.order_items(spark, "star", "created_at")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == tables.order_items(spark, SMALL, "created_at").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE star CASCADE")


@pytest.mark.parametrize("missing", ["xxhash", "zstandard", "regex", "corpus_pipeline", "tidecast.llm"])
def test_entry_points_do_without_the_optional_part(missing):
    """In a process of its own, where the module cannot be imported."""
    code = f"""
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name={missing!r})
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
from tidecast.plans.catalog import QUERIES
assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()) - len(QUERIES))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(contract.__file__).parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"
