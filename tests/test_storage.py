"""Where intermediate tables go, and that they can be released."""

from types import SimpleNamespace

import pytest

from evalspark import storage


def session(master, **conf):
    settings = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)), sparkContext=SimpleNamespace(master=master))


def test_the_shared_folder_is_the_one_named():
    assert storage.shared_dir(session("spark://m:7077", spark_checkpoint_dir="hdfs://n/tmp/")) == "hdfs://n/tmp"
    assert storage.shared_dir(session("local[2]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_evalspark"
    assert storage.shared_dir(session("spark://m:7077", spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_evalspark"


@pytest.mark.parametrize("warehouse", ["file:/w", "/w"])
def test_a_folder_of_one_machine_is_refused_on_a_cluster(warehouse):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session("yarn", spark_sql_warehouse_dir=warehouse))


def test_released_tables_are_gone(spark):
    table = storage.materialize(spark.range(3), "numbers")
    assert table.count() == 3
    storage.release(spark)
    with pytest.raises(Exception):
        table.count()
